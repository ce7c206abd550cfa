"""Mixing sources to target weights by systematic sampling.

A source's target is a share of all words; no document is taken more than `cap` times. Each document
expects target / size of its source copies. Within a source the expected copies are summed up in a
fixed order, one offset is added, and a document is emitted once for each whole number that its
stretch crosses, so every document gets the floor or the ceiling of its expectation.

Distribution: the order is by size, so that long and short documents are taken alike. Documents are
dealt to cells by the leading bits of their size, and within them by a hash of their id; they are
counted by (source, cell) and ranked inside a cell; the counts of earlier cells give each cell its
start. No source is gathered in one task, however large.

Edge cases: a null text has size 0; a null source is a source of its own, the last; a source without
words has target 0 and is not taken; rows that repeat an id are documents of their own, and those
that repeat a size too are ordered by a hash of all their columns, so that reruns agree; other columns
stay, whatever their names, but for those that the operator adds; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.graph import cut, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Cells for sizes that agree in length and leading bits; an octave of sizes has 8 times as many.
CELLS = 4096


def unit(text: Column) -> Column:
    """A number in [0, 1) from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def _cell(size: Column, chance: Column) -> Column:
    """The number of a size's cell: sizes in different cells are in the cells' order."""
    bits = F.length(F.bin(size))
    lead = F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).bitwiseAND(F.lit(7).cast("long"))
    return ((bits * 8 + lead) * CELLS + F.floor(chance * CELLS)).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target for (source, source_size): one row a source, so small.

    Sources by code point, null last, weigh `weights` in turn. With every target below its cap the
    targets are in proportion to the weights; those that reach it stop there. Ordered by the cap for
    each unit of weight, a first stretch of sources is capped; the rest share what is left.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = (
        sizes.withColumn("weight", w)
        .withColumn("all_size", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # what a unit of weight gets if exactly the earlier sources are capped
        .withColumn("level", (F.lit(share) * F.col("all_size") - F.lit(cap) * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size"))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("weight_before").alias("k"), F.col("level").alias("level")))).over(every))
    )
    capped = F.col("final").isNull() | (F.col("weight_before") < F.col("final.k"))
    target = F.when(capped, F.lit(cap) * F.col("source_size")).otherwise(F.col("final.level") * F.col("weight"))
    return full.select("source", "source_size", target.cast("double").alias("target"))


def systematic_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """All columns, and size, source_size, target, copies, taken (words, copies counted)."""
    added = ("size", "source_size", "target", "copies", "taken")
    base = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in added))
    names = base.columns
    tie = F.xxhash64(*(F.col(f"`{f.name}`") for f in base.schema.fields if "map" not in f.dataType.simpleString()))
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    small = base.select(
        F.col(f"`{source_col}`").alias("source"), size.alias("size"), _cell(size, unit(F.concat(F.lit(seed), name))).alias("cell"), F.col(f"`{id_col}`").alias("id"), tie.alias("tie"), F.struct(*(base[f"`{c}`"] for c in names)).alias("row")
    )
    # written: the words are counted here once, and once more where documents are ranked
    cells = cut(small.groupBy("source", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, share, cap).withColumn("offset", unit(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit(""))))).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # a cell's start: what is in earlier octave parts of its source, few of them, and earlier cells of its own
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = cells.groupBy("source", F.floor(F.col("cell") / CELLS).alias("part")).agg(F.sum("n").alias("n")).select(F.col("source").alias("of"), F.col("part").alias("whole"), before(["source"], "part").alias("earlier"))
    own = cells.withColumn("part", F.floor(F.col("cell") / CELLS)).withColumn("inner", before(["source", "part"], "cell"))
    starts = own.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("whole"))).select("source", "cell", (F.col("inner") + F.col("earlier")).alias("start"))
    plan = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("source"), "cell", "start", "source_size", "target", "offset", "rate")
    inside = Window.partitionBy("source", "cell").orderBy("size", "id", "tie")
    ranked = small.withColumn("at", F.row_number().over(inside)).alias("d")
    p = plan.alias("p")
    upto = F.col("start") + F.col("at")
    copies = F.floor(upto * F.col("rate") + F.col("offset")) - F.floor((upto - 1) * F.col("rate") + F.col("offset"))
    out = ranked.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.cell") == F.col("p.cell")))
    return out.select("row.*", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def repeated(df: DataFrame) -> DataFrame:
    """Each row as often as its copies say; sequence(1, 0) would count down, so rows without copies go first."""
    (name,) = unused(df, "copy")
    return df.where(F.col("copies") > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(name) if "copies" in df.columns else df
