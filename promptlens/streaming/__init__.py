"""Continuations as they arrive: the row-wise audit over a stream of records.

Only what a row shows by itself is flagged here; repeated keys need the whole table and stay with
the batch audit. Progress and resuming are the checkpoint's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptlens.operators.prepare import prepare_texts


def prepared_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of new Parquet files below a folder with their preparation status and full text."""
    return prepare_texts(spark.readStream.schema(schema).parquet(path))


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Append to a Parquet table; what is there is processed, then the query ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
