"""Parquet reads for an audit: pruned columns, NUL bytes replaced and reported, runs with their sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

NUL = "\x00"
REPORT_KEYS = ("model_key", "prompt_id", "repetition")


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, S.StringType)]


def n_nul(c: str) -> Column:
    return F.length(c) - F.length(F.replace(F.col(f"`{c}`"), F.lit(NUL), F.lit("")))


def without_lists(df: DataFrame) -> DataFrame:
    """Without array columns (token ids), so that the scan never reads them."""
    return df.select(*(F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, S.ArrayType)))


def replace_nul(df: DataFrame) -> DataFrame:
    """NUL as U+FFFD in all texts, and audit_has_nul, audit_n_nul, audit_nul_in_metric_text, audit_nul_columns."""
    names = _strings(df)
    counts = {c: F.coalesce(n_nul(c), F.lit(0)) for c in names}
    total = sum(counts.values(), F.lit(0))
    metric = [counts[c] > 0 for c in ("prompt", "generation") if c in counts]
    hit = F.lit(False)
    for m in metric:
        hit = hit | m
    flags = {
        "audit_n_nul": total,
        "audit_has_nul": total > 0,
        "audit_nul_in_metric_text": hit,
        "audit_nul_columns": F.nullif(F.concat_ws(";", *(F.when(n > 0, c) for c, n in counts.items())), F.lit("")),
    }
    df = df.withColumns(flags)
    return df.withColumns({c: F.replace(F.col(f"`{c}`"), F.lit(NUL), F.lit("�")) for c in names})


def nul_report(df: DataFrame) -> DataFrame:
    """One row a text with a NUL: its keys, column, the count, the original bytes in hex, and the text shown."""
    keys = [c for c in REPORT_KEYS if c in df.columns]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in _strings(df)))
    long = df.select(*keys, F.inline(cells)).where(F.contains("value", F.lit(NUL)))
    return long.select(*keys, "column", n_nul("value").alias("n_nul"), F.lower(F.hex(F.encode("value", "utf-8"))).alias("hex"), F.replace(F.col("value"), F.lit(NUL), F.lit("�")).alias("display"))


def read_audit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The table for auditing and its NUL report. The file is only read."""
    raw = without_lists(spark.read.parquet(path))
    return replace_nul(raw), nul_report(raw)


def read_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All generations.parquet below a run's folder: data, nul_report, files, metadata, completeness.

    The folder above a file names its model; a row of another model is an error. metadata.json beside
    it may give expected_records and repetitions.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(folder)
    raw = raw.withColumn("__path", F.col("_metadata.file_path"))
    # a table written by Spark is a folder of that name, one written by others a file
    named = F.regexp_extract("__path", r"([^/]+)/generations\.parquet(?:/[^/]*)?$", 1)
    raw = raw.where(named != "").withColumn("__model", named)
    checked = F.when(F.col("model_key").eqNullSafe(F.col("__model")), F.col("model_key")).otherwise(F.raise_error(F.concat(F.lit("model_key is not the folder: "), F.col("__path"))))
    data = raw.withColumn("model_key", checked)
    files = raw.groupBy("__model", "__path").agg(F.count("*").alias("n_records")).toDF("model_key", "path", "n_records")
    body = without_lists(data.drop("__path", "__model"))
    meta = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="metadata.json")
    meta = meta.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metadata\.json$", 1).alias("model_key"), F.from_json("value", "expected_records long, repetitions long, status string").alias("m")).select("model_key", "m.*")
    seen = body.groupBy("model_key").agg(F.count("*").alias("observed_records"), F.max("repetition").alias("observed_repetitions"))
    done = seen.join(meta, "model_key", "left").select("model_key", "observed_records", "expected_records", "observed_repetitions", F.col("repetitions").alias("expected_repetitions"), (F.col("observed_records") == F.col("expected_records")).alias("complete"))
    return {"data": replace_nul(body), "nul_report": nul_report(body), "files": files, "metadata": meta, "completeness": done}
