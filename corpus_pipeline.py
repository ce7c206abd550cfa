"""A corpus pipeline: each stage works on all that its predecessor kept, and its decisions take effect.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Null or empty texts fail the quality rules; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm import bpe, jaccard, mixing, quality
from promptlens.llm.queries import vocabulary
from promptlens.llm.substring import doubling_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the label model's posterior accept."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur more than once, cut at whole characters.

    The ids of one id's rows may differ in text, so the cleaned text comes back with the row itself.
    """
    cleaned = doubling_dedup(docs.select(*COLUMNS), characters=True, carry=("lang", "source"))
    text = F.col("kept").cast("string")
    return cleaned.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.repeated(mixing.systematic_mix(docs.select(*COLUMNS))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the text's token ids and their number, and whether they decode to what was encoded."""
    out = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary(), decoded="decoded")
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Expectation-maximisation and byte-pair merges are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
