"""Connected components over edge tables, and where to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> None:
    """See that checkpoints have a folder: the shared one that the session names, or in local mode one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder and read from there."""
    ready(df.sparkSession)
    return df.checkpoint()


def forget(df: DataFrame) -> DataFrame:
    """The same rows, of a size that Spark takes as unknown.

    Spark estimates a join's size as the product of its sides', and checkpoints keep the estimate: in a
    loop its digits multiply with each round, until the number alone fills the driver.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


#: Places that the neighbours of a node are dealt to.
SALTS = 8


def _meet(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """(v, m): every neighbour v of u with m, the least of u's neighbours."""
    dealt = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(dealt, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id and component (its smallest reachable id) for each end of the edges (a, b: long).

    Alternating large and small stars: in each round every node links its larger neighbours, then its
    smaller ones and itself, to the smallest of them. Neighbours are reduced to a minimum before they
    are shuffled, and each minimum meets a node's neighbours in SALTS places, so that a node of high
    degree is dealt. Null ends and loops are left out; no edges
    give no rows.
    """
    links = forget(cut(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()))
    state = None
    for _ in range(most_rounds):
        both = links.select("u", "v").union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _meet(both.where("v > u"), least)
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _meet(large, least).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        links = forget(cut(small))
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
