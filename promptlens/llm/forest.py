"""Embedding near-duplicates by a forest of random-projection trees with spill.

Each label has its own trees. A node splits along a random direction where fewest of a bounded sample of its
vectors are near, between their quarters; a vector within a margin of the split goes to both sides. The margin follows the angle
that a link allows: projections of two linked vectors differ by a normal amount of known width, and
few differ by more than twice the margin. A node of at most `leaf` vectors is a leaf; so is one
that a split would not make smaller, as nearly all of its vectors lie within the margin: a dense
cluster. Vectors are compared exactly within their leaves; what one tree parts, another keeps.

Distribution. Trees grow in rounds of a few levels: nodes are counted, samples of the full ones are
fitted in a task each, and their vectors are placed. Directions come from the node's number, so only
thresholds travel: they are broadcast while they are few, else joined. Nothing reaches the driver but
counts. A leaf of more than BLOCK vectors is compared in blocks, each pair of blocks by itself. A pair
counts in the smallest leaf that both share, so links are counted once; only a spanning forest of
each block's links is sent on. Equal vectors are one node and are expanded at the end.

Edge cases: a vector that is null, empty, zero, or holds a null or non-finite component, and one
with a null label, links with nothing and is kept; vectors of different lengths are never compared;
rows that repeat an id are vectors of their own; an empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.arrowtext import U, mix
from promptlens.llm.graph import components, cut, forget

#: Vectors of a leaf; trees; margin in deviations of a linked pair's difference; sample of a node; levels of a round.
LEAF, TREES, MARGIN, SAMPLE, LEVELS = 48, 3, 0.5, 1_024, 6
#: Vectors of a block; the share of vectors on both sides from which a split saves no comparisons; bytes of thresholds to broadcast.
BLOCK, DENSE, BROADCAST = 1_024, 0.3, 32 << 20
#: In place of a threshold: the node is a leaf, to be split on if it is full; the node is a dense leaf.
STOP, WHOLE = float("nan"), float("inf")


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def direction(group: int, place: int, width: int) -> np.ndarray:
    x = np.random.default_rng([group & (2**63 - 1), place]).standard_normal(width)
    return x / np.linalg.norm(x)


def margin(least: float, width: int) -> float:
    """MARGIN deviations of the difference between the projections of two vectors whose cosine is `least`."""
    return MARGIN * sqrt(2 - 2 * least) / sqrt(width)


def fit(unit: np.ndarray, group: int, total: int, least: float, leaf: int) -> list[float]:
    """Thresholds of a node's next levels, in heap order (children of i: 2i + 1 and 2i + 2), from a sample of its vectors."""
    near, levels = margin(least, unit.shape[1]), min(LEVELS, ceil(log2(total / leaf)))
    out, held = [], {0: np.arange(len(unit))}
    for i in range(2**levels - 1):
        at = held.pop(i, None)
        if at is None or len(at) < 8 or len(at) * total <= leaf * len(unit):
            out.append(STOP)
            continue
        x = unit[at] @ direction(group, i, unit.shape[1])
        # between the quarters, where fewest are near: a cluster is rather passed than cut
        line = np.sort(x)
        middle = line[len(line) // 4 : max(len(line) // 4 + 1, len(line) * 3 // 4)]
        mid = float(middle[np.argmin(np.searchsorted(line, middle + near) - np.searchsorted(line, middle - near))])
        left, right = x <= mid + near, x > mid - near
        if left.sum() + right.sum() - len(at) > DENSE * len(at):
            out.append(WHOLE)
            continue
        out.append(mid)
        held[2 * i + 1], held[2 * i + 2] = at[left], at[right]
    return out


def place(unit: np.ndarray, group: int, splits: list[float], least: float) -> Iterator[tuple[np.ndarray, int, bool]]:
    """Rows, place and density of each leaf that a node's splits lead to."""
    near, held = margin(least, unit.shape[1]), {0: np.arange(len(unit))}
    while held:
        i, at = held.popitem()
        split = splits[i] if i < len(splits) else STOP
        if np.isnan(split) or np.isinf(split):
            yield at, i, bool(np.isinf(split))
            continue
        x = unit[at] @ direction(group, i, unit.shape[1])
        for child, ok in ((2 * i + 1, x <= split + near), (2 * i + 2, x > split - near)):
            if ok.any():
                held[child] = at[ok]


def _fitted(least: float, leaf: int):
    def run(table: pa.Table) -> pa.Table:
        group, total = table.column("g")[0].as_py(), table.column("n")[0].as_py()
        return pa.table({"g": pa.array([group], pa.int64()), "splits": pa.array([fit(_units(table.column("vector").combine_chunks()), group, total, least, leaf)], pa.list_(pa.float64()))})

    return run


def _placed(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, group, vector = batch.column("node"), batch.column("g").to_numpy(), batch.column("vector")
            order = np.argsort(group, kind="stable")
            rows, leaves, dense = [], [], []
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                g = int(group[at[0]])
                for part, i, whole in place(_units(vector.take(pa.array(at))), g, batch.column("splits")[int(at[0])].as_py(), least):
                    rows.append(at[part])
                    leaves.append(np.full(len(part), mix(np.array([g], np.int64).view(U) + U(2 * i + 1))[0]).view(np.int64))
                    dense.append(np.full(len(part), whole))
            if rows:
                yield pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(leaves)), pa.array(np.concatenate(dense))], ["node", "g", "dense"])

    return run


def grow(nodes: DataFrame, least: float, leaf: int, trees: int, sample: int, rounds: int = 64) -> DataFrame:
    """node and g: every leaf that each node's vector is in. nodes: node, label, vector."""
    vectors = nodes.select("node", "vector")
    roots = F.explode(F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64(t, F.col("label").cast("string"), F.size("vector"))))
    full, done = nodes.select("node", roots.alias("g"), F.lit(False).alias("dense")), []
    for _ in range(rounds):
        sizes = full.groupBy("g", "dense").agg(F.count("*").alias("n"))
        big = cut(sizes.where((F.col("n") > leaf) & ~F.col("dense")).select("g", "n"))
        count = big.count()
        done.append(full.join(big, "g", "left_anti").select("node", "g"))
        if not count:
            break
        # a node takes 8 bytes a threshold; beyond the bound the thresholds are shuffled
        near = F.broadcast if count * 8 * 2**LEVELS <= BROADCAST else lambda x: x
        open_ = full.join(near(big), "g")
        chosen = F.pmod(F.xxhash64(F.lit(3), "node", "g"), F.lit(1 << 20)) * F.col("n") < F.lit(sample << 20)
        splits = cut(open_.where(chosen).join(vectors, "node").groupBy("g").applyInArrow(_fitted(least, leaf), "g long, splits array<double>"))
        rest = open_.select("node", "g").join(vectors, "node").join(near(splits), "g")
        full = forget(cut(rest.mapInArrow(_placed(least), "node long, g long, dense boolean")))
    else:
        raise RuntimeError("the trees did not settle")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _compare(least: float):
    """Links within one pair of blocks of one leaf after another: for each node its new links and the root of its links there."""

    def block(key: tuple[int, int, int], table: pa.Table) -> pa.RecordBatch | None:
        group, i, j = key
        unit, many, node = _units(table.column("vector").combine_chunks()), table.column("many").to_numpy(), table.column("node").to_numpy()
        side = table.column("b").to_numpy()
        a, b = (np.arange(len(unit)),) * 2 if i == j else (np.flatnonzero(side == i), np.flatnonzero(side == j))
        x, y = np.nonzero(unit[a] @ unit[b].T >= least)
        x, y = a[x], b[y]
        if i == j:
            x, y = x[y > x], y[y > x]
        if not len(x):
            return None
        # not counted here if both share a smaller leaf
        lists = table.column("leaves").combine_chunks()
        leaf, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(unit)), lists.value_lengths().to_numpy())
        name, leaf = np.unique(leaf, return_inverse=True)
        held = np.zeros((len(unit), len(name)), np.float32)
        held[owner, leaf] = name[leaf] < group
        held = held[:, held.sum(axis=0) > 1]
        fresh = (held[a] @ held[b].T == 0)[np.searchsorted(a, x), np.searchsorted(b, y)]
        links = np.bincount(x[fresh], weights=many[y[fresh]], minlength=len(unit)) + np.bincount(y[fresh], weights=many[x[fresh]], minlength=len(unit))
        root = np.arange(len(unit))
        while len(x):
            rx, ry = root[x], root[y]
            differ = rx != ry
            x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
            np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
            while (root[root] != root).any():
                root = root[root]
        some = np.flatnonzero((links > 0) | (root != np.arange(len(unit))))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[root[some]])], ["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:  # rows are sorted, so a pair of blocks is at hand at once
            names = np.stack([batch.column(c).to_numpy() for c in ("g", "i", "j")], 1)
            ends = [*(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1), len(names)] if len(names) else []
            lo = 0
            for hi in ends:
                now = tuple(int(v) for v in names[lo])
                if now != key and held:
                    out = block(key, pa.Table.from_batches(held))
                    if out is not None:
                        yield out
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
                lo = hi
        if held:
            out = block(key, pa.Table.from_batches(held))
            if out is not None:
                yield out

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, leaf: int = LEAF, trees: int = TREES, margin_sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; links join equal labels with cosine >= least."""
    spark = df.sparkSession
    # floats travel as they are; they are compared as doubles
    kind = "float" if df.select(F.col(f"`{vector_col}`")).schema[0].dataType.simpleString() == "array<float>" else "double"
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("raw"), F.col(f"`{label_col}`").alias("label"))
    good = F.coalesce(
        F.col("label").isNotNull() & (F.size("raw") > 0) & F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.array_max(F.transform("raw", F.abs)) > 0),
        F.lit(False),
    )
    # adding zero makes both zeros equal
    rows = base.withColumn("vector", F.when(good, F.transform("raw", lambda x: x + F.lit(0.0).cast(kind))))
    key = F.struct("label", "vector")
    # the fingerprint names a node; two of its kind keep apart what one would not
    named = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), key))).withColumn("other", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(2), F.col("vector"), F.col("label"))))
    nodes = cut(named.where("node is not null").groupBy("node", "other").agg(F.count("*").alias("many"), F.min("id").alias("first"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    leaves = cut(grow(nodes, least, leaf, trees, margin_sample))
    # written, so that Spark can split the rows of a large leaf as they meet its size
    sizes = cut(leaves.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    held = leaves.join(sizes, "g").groupBy("node").agg(F.array_sort(F.collect_set("g")).alias("leaves"), F.collect_set(F.struct("g", "n")).alias("at"))
    rows = nodes.select("node", "many", "vector").join(held, "node").select("node", "many", "vector", "leaves", F.explode("at").alias("at"))
    rows = rows.select("node", "many", "vector", "leaves", "at.g", F.ceil(F.col("at.n") / BLOCK).cast("int").alias("nb")).withColumn("b", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("i", F.least("b", "x")).withColumn("j", F.greatest("b", "x"))
    work = rows.select("node", "many", "vector", "leaves", "g", "i", "j", "b").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    found = cut(work.mapInArrow(_compare(least), "node long, links long, root long"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "other", "many", "first").join(links, "node", "left").join(groups, "node", "left").withColumn("g", F.coalesce("component", "node"))
    lead = known.groupBy("g").agg(F.min("first").alias("least"))
    known = known.join(lead, "g").select("node", "other", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least")
    out = named.select("id", "node", "other").join(known, ["node", "other"], "left")
    component = F.when(F.col("node").isNotNull(), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
