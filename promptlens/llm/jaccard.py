"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Equal sets are one node. Similar nodes are partitioned into
groups: each joins the hub that shares most of its lowest-hashed shingles. The matrix holds, for each
group, the union of its members' prefix shingles. A node's overlap with a group's union bounds its
overlap with every member; only groups whose bound reaches what a link needs are opened, the node's
own among them. An opened group's members are compared exactly with the nodes that opened it, in
blocks of bounded size; a block sends on a spanning forest of its links, never all pairs.

The prefix. A link of x and y needs |x & y| >= need(x, y) = ceil(p (|x| + |y|) / (100 + p)) for p per
cent. Shingles of all documents are in one order (by hash), and a prefix holds the first
n - ceil(p n / 100) + s(n), with s(n) = max(1, floor(n / 20)). Of two sets, the one whose prefix ends
first misses at most rest(n) = n - |prefix| shared shingles, so the prefixes share at least
need(x, y) - max(rest(x), rest(y)), which is never below 1. Shingles beyond the prefix, and prefix
shingles that only one node holds, need not be shuffled or joined.

Common shingles, those of many groups, are not joined: a node takes all of its own for shared and its
bound on the others falls by their number. A node whose bound would fall below 1 opens no groups this
way; others still open its group. What is left, pairs of such nodes, goes through the same join again
with all their shingles in order of frequency, so that their prefixes hold the rarest first.

Edge cases: a null or blank text has the empty set and links with nothing; fewer words than a
shingle count as one shingle; rows that repeat an id are documents of their own, as are rows with a
null id (their component is the smallest id they reach, or null). Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.llm.arrowtext import U, frugal, lowered, mix, runs, signed, spans, trimmed, word_values, words
from promptlens.llm.graph import components, cut, unused

#: Hubs that a shingle offers; the most nodes on a side of a block; bits of the filter on nodes.
HUBS, BLOCK, FILTER_BITS = 2, 512, 1 << 26
#: Shingles of more groups than this are counted as shared without being joined.
COMMON = 32


class Sets:
    """The shingle sets of a chunk's rows: values sorted within each row, and each row's offset."""

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int):
        rows = len(off) - 1
        data = lowered(data)
        start, end, first = words(data, off)
        word = word_values(data, start, end)
        row = np.repeat(np.arange(rows), np.diff(first))
        key = runs(word, width)
        ok = np.flatnonzero(row[: len(key)] == row[width - 1 :][: len(key)]) if len(key) else np.zeros(0, np.int64)
        # fewer words than a shingle: the whole sequence, among the runs of its own length
        value, owner = [key[ok]], [row[ok]]
        for n in range(1, width):
            few = np.flatnonzero(np.diff(first) == n)
            if len(few):
                value.append(runs(word, n)[first[few]])
                owner.append(few)
        value, owner = np.concatenate(value), np.concatenate(owner)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = value[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(rows + 1))
        self.size = np.diff(self.first)
        sums = np.concatenate(([U(0)], np.cumsum(mix(self.values))))[self.first]
        other = np.concatenate(([U(0)], np.cumsum(mix(self.values ^ U(0x5851F42D4C957F2D)))))[self.first]
        self.node = signed(mix((sums[1:] - sums[:-1]) + mix((other[1:] - other[:-1]) + self.size.astype(U))))


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _spare(n: Column | np.ndarray) -> Column | np.ndarray:
    """s(n): the shared prefix shingles that a link needs."""
    return np.maximum(1, n // 20) if isinstance(n, np.ndarray) else F.greatest(F.lit(1), F.floor(n / 20))


def _map(width: int, percent: int, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in spans(batch.column("text")):
                s = Sets(data, off, width)
                if what == "nodes":
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(s.size), pa.array(s.node)], ["id", "n", "node"])
                    continue
                size = s.size
                take = np.minimum(size, size - _need(size, percent) + _spare(size))
                place = np.arange(len(s.values)) - s.first[s.owner]
                at = np.flatnonzero(place < take[s.owner])
                row = s.owner[at]
                yield pa.RecordBatch.from_arrays([pa.array(signed(s.values[at])), pa.array(s.node[row]), pa.array(size[row])], ["token", "node", "n"])

    return trimmed(run)


def _rest(n: Column, percent: int) -> Column:
    """Shingles beyond the prefix."""
    return n - F.least(n, n - F.ceil(n * percent / 100) + _spare(n))


def _bound(n: Column, m: Column, percent: int) -> Column:
    """How many prefix shingles sets of n and m share at least if they are linked."""
    return F.ceil((n + m) * percent / F.lit(100 + percent)) - F.greatest(_rest(n, percent), _rest(m, percent))


def _least(n: Column, low: Column, high: Column, percent: int) -> Column:
    """The smallest bound for a partner of low to high shingles: it is at one end of the sizes that can be linked.

    Rounding may move a bound between the ends by one.
    """
    m, k = F.greatest(low, F.ceil(n * percent / 100)), F.least(high, F.floor(n * 100 / F.lit(percent)))
    return F.greatest(F.lit(1), F.least(_bound(n, m, percent), _bound(n, k, percent)) - 1)


def _active(rows: DataFrame, percent: int) -> DataFrame:
    """Prefix rows of nodes that can still be linked: enough of their shingles are shared."""
    by_token, by_node = Window.partitionBy("token"), Window.partitionBy("node")
    n = F.col("n")
    for _ in range(2):
        rows = rows.withColumn("c", F.count("*").over(by_node)).where(F.col("c") >= _least(n, F.lit(1), n * 2 + 2, percent)).drop("c")
        rows = rows.withColumn("c", F.count("*").over(by_token)).where("c > 1").drop("c")
    return rows


def _groups(rows: DataFrame, percent: int) -> DataFrame:
    """node and g: the hub that shares most of the node's prefix, the node itself if none shares a third of it.

    A shingle offers as hubs the lowest-hashed holder of each of HUBS classes, so that partial
    aggregation keeps one row a class however many hold it.
    """
    hub = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("b"), F.col("n").alias("nb"))
    offered = rows.groupBy("token", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(HUBS))).agg(F.min(hub).alias("hub")).select("token", "hub.*").drop("h")
    n, m = F.col("n"), F.col("nb")
    met = rows.join(offered, "token").where((100 * n >= percent * m) & (100 * m >= percent * n))
    score = met.groupBy("node", "n", "b", "nb").agg(F.count("*").alias("o")).where(3 * F.col("o") >= n - _rest(n, percent))
    best = score.groupBy("node").agg(F.max(F.struct("o", -F.col("b"), "b")).alias("x")).select("node", F.col("x.b").alias("g"))
    return rows.select("node", "n").distinct().join(best, "node", "left").select("node", "n", F.coalesce("g", "node").alias("g"))


def _about(groups: DataFrame) -> DataFrame:
    """node, g, and the group's size, least and greatest member. Both sides are written first, so that Spark can split a large group's nodes."""
    about = cut(groups.groupBy("g").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high")))
    return cut(groups.join(about, "g").select("node", "g", "members", "low", "high"))


def _held(rows: DataFrame, about: DataFrame) -> DataFrame:
    """Prefix rows with their node's group and what is known about it, and the groups of their token."""
    held = rows.join(about, "node")
    spread = held.select("token", "g").distinct().groupBy("token").agg(F.count("*").alias("groups"))
    # few rows are left, and each later plan begins with them
    return cut(held.join(spread.where("groups > 1"), "token"))


def _met(query: DataFrame, held: DataFrame, percent: int, which: Column, spared: Column) -> DataFrame:
    """(a, gb): nodes with the groups whose unions share enough with them; spared: shingles taken for shared unseen."""
    matrix = held.select("token", F.col("g").alias("gb"), F.col("members").alias("mb"), F.col("low").alias("lb"), F.col("high").alias("hb")).distinct()
    n = F.col("n")
    fits = (100 * F.col("hb") >= percent * n) & (100 * n >= percent * F.col("lb"))
    shared = query.select("token", F.col("node").alias("a"), "n", "g", "members", spared.alias("spared")).join(matrix, "token").where(which & fits)
    shared = shared.groupBy("a", "n", "spared", "gb", "lb", "hb").agg(F.count("*").alias("o"))
    return cut(shared.where(F.col("o") + F.col("spared") >= _least(n, F.col("lb"), F.col("hb"), percent)).select("a", "gb"))


def _opened(rows: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, gb): nodes with the groups they open; groups of two or more open themselves."""
    about = _about(groups)
    own = about.where("members > 1").select(F.col("node").alias("a"), F.col("g").alias("gb"))
    held = _held(rows, about)
    common = held.groupBy("node", "n").agg(F.count_if(F.col("groups") > COMMON).alias("common"))
    n = F.col("n")
    full = _least(n, F.lit(1), n * 2 + 2, percent) <= F.col("common")
    rare = held.where(F.col("groups") <= COMMON)
    query = rare.join(common.where(~full).select("node", "common"), "node")
    first = _met(query, rare, percent, F.col("g") != F.col("gb"), F.col("common"))
    # the nodes that hold too many common shingles, among each other
    left = cut(common.where(full).select("node", "n"))
    some = cut(sets.join(left, "node").select("node", "n", F.explode("tokens").alias("token")))
    counted = some.join(some.groupBy("token").agg(F.count("*").alias("c")), "token")
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "token"))
    prefix = counted.withColumn("r", place).where((F.col("r") <= n - _rest(n, percent)) & (F.col("c") > 1)).select("token", "node", "n")
    again = _held(prefix, _about(groups.join(left.select("node"), "node", "left_semi")))
    smaller = (F.col("members") < F.col("mb")) | ((F.col("members") == F.col("mb")) & (F.col("g") < F.col("gb")))
    return own.union(first).union(_met(again, again, percent, smaller, F.lit(0)))


def _blocks(opened: DataFrame, groups: DataFrame) -> DataFrame:
    """node, block, asks: who stands on which side of which block of a group and the nodes that opened it."""
    asking = opened.groupBy("gb").agg(F.count("*").alias("asking"))
    sizes = groups.groupBy("g").agg(F.count("*").alias("members")).join(asking, F.col("g") == F.col("gb")).drop("gb")
    cuts = cut(sizes.select("g", F.ceil(F.col("members") / BLOCK).cast("int").alias("nm"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("nq")))
    deal = lambda c, n: F.pmod(F.xxhash64(F.lit(5), c), n).cast("int")
    ask = opened.join(cuts, F.col("gb") == F.col("g")).select(F.col("a").alias("node"), "g", deal("a", F.col("nq")).alias("q"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"), F.lit(True).alias("asks"))
    stand = groups.join(cuts, "g").select("node", "g", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), deal("node", F.col("nm")).alias("m"), F.lit(False).alias("asks"))
    return ask.unionByName(stand).select("node", F.xxhash64("g", "q", "m").alias("block"), "asks")


def _compare(percent: int):
    """Spanning forests of the exact links in the blocks of one partition."""

    def forest(tokens: list[np.ndarray], asks: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, int]]:
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(a) or not len(b):
            return
        size = np.array([len(t) for t in tokens])
        flat = np.concatenate(tokens)
        owner = np.repeat(np.arange(len(tokens)), size)
        _, place, n = np.unique(flat, return_inverse=True, return_counts=True)
        keep = n[place] > 1
        _, place = np.unique(place[keep], return_inverse=True)
        owner = owner[keep]
        side = np.zeros(len(tokens), np.int64)
        side[a], side[b] = np.arange(len(a)), np.arange(len(b))
        same = np.zeros((len(a), len(b)), np.float32)
        width = int(place.max()) + 1 if len(place) else 0
        # dense pieces of the token axis: products of small matrices count the shared tokens
        step = max(1, (1 << 22) // max(1, len(tokens)))
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        for lo in range(0, width, step):
            i, j = np.searchsorted(place, (lo, lo + step))
            o, p, q = owner[i:j], place[i:j] - lo, asks[owner[i:j]]
            left, right = np.zeros((len(a), min(step, width - lo)), np.float32), np.zeros((len(b), min(step, width - lo)), np.float32)
            left[side[o[q]], p[q]] = 1
            right[side[o[~q]], p[~q]] = 1
            same += left @ right.T
        same = same.astype(np.int64)
        linked = (100 * same >= percent * (size[a][:, None] + size[b][None, :] - same)) & (node[a][:, None] != node[b][None, :])
        # the forest, row by row: each row joins what its links hold together
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for i in range(len(a)):
            x = int(node[a[i]])
            for y in node[b[np.flatnonzero(linked[i])]].tolist():
                rx, ry = find(x), find(y)
                if rx != ry:
                    root[rx] = ry
                    yield x, y

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = table.column("block").to_numpy()
        asks, node = table.column("asks").to_numpy(zero_copy_only=False), table.column("node").to_numpy()
        lists = table.column("tokens").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.argsort(block, kind="stable")
        ends = np.flatnonzero(np.append(block[order][1:] != block[order][:-1], True)) + 1 if len(order) else []
        pairs, lo = [], 0
        for hi in ends:
            rows = order[lo:hi]
            lo = hi
            pairs += forest([flat[off[r] : off[r + 1]] for r in rows], asks[rows], node[rows])
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _filter(nodes: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A Bloom filter of two probes over nodes, of a fixed size whatever their number: at most bits / 64 numbers reach the driver."""
    word = lambda h: F.shiftrightunsigned(F.col(h), 6).alias("w")
    probes = nodes.select(F.explode(F.array(F.pmod("node", F.lit(bits)), F.pmod(F.shiftrightunsigned("node", 32), F.lit(bits)))).alias("h"))
    words_ = probes.select(word("h"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, np.int64)
    got = words_.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.tobytes()


def _passes(node: np.ndarray, held: np.ndarray) -> np.ndarray:
    bits = len(held) * 64
    ok = np.ones(len(node), bool)
    for h in (np.mod(node, bits), np.mod((node.view(U) >> U(32)).view(np.int64), bits)):
        ok &= (held[h >> 6] >> (h & 63)) & 1 == 1
    return ok


def _sets(docs: DataFrame, active: DataFrame, width: int, percent: int) -> DataFrame:
    """node and tokens of the active nodes, each once. A filter on nodes keeps other texts' sets from being shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(active))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.int64)
        for batch in batches:
            for _, _, data, off in spans(batch.column("text")):
                s = Sets(data, off, width)
                ok = np.flatnonzero(_passes(s.node, bits))
                if len(ok):
                    full = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), pa.array(signed(s.values))).take(pa.array(ok))
                    yield pa.RecordBatch.from_arrays([pa.array(s.node[ok]), full], ["node", "tokens"])

    full = docs.select("text").mapInArrow(trimmed(run), "node long, tokens array<long>")
    return full.join(active, "node", "left_semi").groupBy("node").agg(F.first("tokens").alias("tokens"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, node (equal sets share it), group (linked nodes share it), component_id (smallest id reachable by links).

    Two documents are linked when 100 * |intersection| >= percent * |union|.
    """
    frugal(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    nodes = cut(docs.mapInArrow(_map(width, percent, "nodes"), f"id {kind}, n long, node long"))
    # exact copies share a node: the duplicates of a token within a node are dropped as they meet
    prefix = docs.select("text").mapInArrow(_map(width, percent, "prefix"), "token long, node long, n long")
    token = Window.partitionBy("token")
    shared = prefix.withColumn("lo", F.min("node").over(token)).withColumn("hi", F.max("node").over(token)).where("lo <> hi").drop("lo", "hi").distinct()
    rows = cut(_active(shared, percent))
    active = rows.select("node").distinct()
    groups = cut(_groups(rows, percent))
    sets = cut(_sets(docs, active, width, percent))
    work = _blocks(_opened(rows, groups, sets, percent), groups)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    filled = work.join(sets, "node").withColumn("part", F.pmod("block", F.lit(parts)))
    links = filled.groupBy("part").applyInArrow(_compare(percent), "a long, b long")
    groups = components(links).select(F.col("id").alias("node"), F.col("component").alias("g"))
    joined = nodes.join(groups, "node", "left").withColumn("g", F.coalesce("g", "node"))
    # the empty set is a node that many documents share but that links nothing
    by_group = joined.where("n > 0").groupBy("g").agg(F.min("id").alias("least"))
    out = joined.join(by_group, "g", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node", F.col("g").alias("group"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, all columns, without all but one of each group of linked documents.

    The smallest id stays, a null id only if there is no other. Rows without a word are in no group.
    """
    found = jaccard_components(df, id_col, text_col, width, percent).where("n_shingles > 0")
    first = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`").alias("id"), "node")
    node, size, of, row = unused(df, "node", "n", "of", "row")
    stays = found.groupBy("group").agg(F.min(first).alias("s")).select(F.col("s.id").alias(of), F.col("s.node").alias("at"))
    names, at = [*df.columns, node, size], df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in spans(batch.column(at)):
                s = Sets(data, off, width)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(s.node), pa.array(s.size)], names)

    schema = T.StructType([*df.schema.fields, T.StructField(node, T.LongType()), T.StructField(size, T.LongType())])
    marked = df.mapInArrow(trimmed(run), schema)
    grouped = marked.where(F.col(size) > 0).join(stays, marked[f"`{id_col}`"].eqNullSafe(stays[of]) & (marked[node] == stays["at"])).select(*(marked[f"`{c}`"] for c in names))
    # rows that repeat an id and a set: the first by all columns, so that reruns agree
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    one = grouped.groupBy(F.col(f"`{id_col}`"), node).agg(F.min(whole).alias(row)).select(f"{row}.*")
    return one.unionByName(marked.where(F.col(size) == 0).select(*(F.col(f"`{c}`") for c in df.columns)))
