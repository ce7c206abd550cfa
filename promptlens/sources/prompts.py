"""Nested prompt files ({category: {subject: [prompt]}}) to tables and back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NESTED = "map<string,map<string,array<string>>>"


def domain_from_filename(name: Column) -> Column:
    """The file's stem without a closing _prompt."""
    stem = F.regexp_extract(name, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.regexp_replace(stem, "_prompt$", "")


def read_nested(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, category, subject, prompt_index (from 0), prompt and place (order in the file), one row a prompt.

    A file that is no such object is an error. Files are read whole, one row each, by any file system.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), "value")
    parsed = raw.withColumn("m", F.from_json("value", NESTED, {"mode": "FAILFAST"}))
    one = parsed.select("source_file", F.posexplode("m").alias("c", "category", "subjects"))
    two = one.select("source_file", "c", "category", F.posexplode("subjects").alias("s", "subject", "prompts"))
    return two.select("source_file", "category", "subject", F.posexplode("prompts").alias("prompt_index", "prompt"), F.struct("c", "s").alias("place"))


def prompt_table(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """dominio, categoria, entita, prompt of one file. A missing file is Spark's own error."""
    return read_nested(spark, path).select(F.lit(domain).alias("dominio"), F.col("category").alias("categoria"), F.col("subject").alias("entita"), "prompt")


def all_prompts(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame:
    """The tables of several files (domain: file name) in one scan; a file that is not there is an error."""
    rows = read_nested(spark, [f"{folder}/{name}" for name in files.values()])
    # one file name may serve several domains
    named = spark.createDataFrame([(d, n) for d, n in files.items()], "dominio string, source_file string")
    return rows.join(F.broadcast(named), "source_file").select("dominio", F.col("category").alias("categoria"), F.col("subject").alias("entita"), "prompt")


def json_list(*parts: Column) -> Column:
    """Compact JSON of a list of texts and numbers."""
    one = lambda p: F.regexp_extract(F.to_json(F.array(p)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("["), F.concat_ws(",", *(one(p) for p in parts)), F.lit("]"))


def stable_prompt_id(source_file: Column, category: Column, subject: Column, prompt_index: Column, prompt: Column) -> Column:
    """The first 20 hex digits of the SHA-256 of what a prompt is and where it stands."""
    return F.substring(F.sha2(json_list(source_file, category, subject, prompt_index.cast("long"), prompt), 256), 1, 20)


def sha256_json(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys, on the driver."""
    import hashlib

    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def record_id(model_key: Column, prompt_id: Column, repetition: Column) -> Column:
    return F.format_string("%s:%s:r%03d", model_key, prompt_id, repetition)


def occurrences(rows: DataFrame, repetitions: int, limit: int | None = None) -> DataFrame:
    """Each prompt once for each repetition, with its ids and orders; limit is the first N prompts.

    dataset_row counts prompts through the sorted files; record_order has the repetitions innermost.
    Rows are numbered by file first, so that no sort gathers all files in one task.
    """
    if repetitions < 1 or (limit is not None and limit < 1):
        raise ValueError("repetitions and limit are positive")
    by_file = Window.partitionBy("source_file").orderBy("place", "prompt_index")
    numbered = rows.withColumn("at", F.row_number().over(by_file))
    sizes = rows.groupBy("source_file").agg(F.count("*").alias("n"))  # one row a file
    starts = sizes.select("source_file", F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    out = numbered.join(F.broadcast(starts), "source_file").withColumn("dataset_row", F.col("start") + F.col("at"))
    if limit is not None:
        out = out.where(F.col("dataset_row") <= limit)
    out = out.withColumn("prompt", F.when(F.col("prompt").isNull(), F.raise_error(F.lit("a prompt is null"))).otherwise(F.col("prompt")))
    out = out.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    pid = stable_prompt_id(F.col("source_file"), F.col("category"), F.col("subject"), F.col("prompt_index"), F.col("prompt"))
    return out.select(
        pid.alias("prompt_id"), ((F.col("dataset_row") - 1) * repetitions + F.col("repetition")).cast("long").alias("record_order"), F.col("dataset_row").cast("long").alias("dataset_row"), "source_file",
        domain_from_filename(F.col("source_file")).alias("domain"), "category", "subject", F.col("prompt_index").cast("long").alias("prompt_index"), "prompt", F.col("repetition").cast("long").alias("repetition"),
    )


def nested_json(records: DataFrame, text: str = "generation") -> DataFrame:
    """source_file, repetition and value: the continuations as a nested object like the input, nulls kept.

    One object is one file of the input, so a group is as large as a prompt file, not as the corpus.
    """
    by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    item = F.struct("prompt_index", F.col(text).alias("t"))
    lists = records.groupBy("repetition", "source_file", "category", "subject").agg(F.min("record_order").alias("o"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]).alias("v"))
    subjects = lists.groupBy("repetition", "source_file", "category").agg(F.min("o").alias("o"), F.transform(F.array_sort(F.collect_list(F.struct("o", "subject", "v")), by_order), lambda x: F.struct(x["subject"], x["v"])).alias("v"))
    files = subjects.groupBy("repetition", "source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "category", F.map_from_entries("v").alias("v"))), by_order), lambda x: F.struct(x["category"], x["v"])).alias("v"))
    return files.select("repetition", "source_file", F.to_json(F.map_from_entries("v"), {"ignoreNullFields": "false"}).alias("value"))
