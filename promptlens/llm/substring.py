"""Exact repeated-substring removal: relative Lempel-Ziv parsing over words, prefix doubling over bytes.

Both operators index the corpus with the content-defined blocks of `blocks.py`. Only anchors (a few
per hundred items) travel for all text; single windows travel for the blocks where copies begin and
end. The text itself is shuffled once by its id and that exchange is read again by each pass.

Groups. Rows that share an anchor, a block or a window meet by it. Anchors that hold more than a
partition's share of all rows are found on a sample of documents first; their rows are counted before
they are shuffled, and the counts are joined back, where Spark splits a key of many rows. What is hot
changes no result.

Edge cases, for both: a null or empty text has no items, is never changed and yields empty output.
A null id is a document like any other (for `rlz_dedup`: later than all others, so never a source).
Rows that repeat an id count as documents of their own, equally early. Other columns are ignored,
whatever their names, and so are names of the columns given. An empty table gives an empty result.

Fingerprints have 61 bits, modulo a prime; blocks compare two of them, windows one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.arrowtext import Prefix, U, byte_values, frugal, mix, signed, spans, spread, trimmed, word_values, words
from promptlens.llm.blocks import Blocks
from promptlens.llm.graph import cut

#: One document in so many is looked at for hot anchors; an anchor is hot above this share of a partition's rows.
SAMPLED, HOT = 64, 1.0


class Chunk:
    """Some rows' items (words or bytes), as fingerprints."""

    def __init__(self, unit: str, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        if unit == "word":
            self.start, self.end, self.first = words(data, off)
            self.values = word_values(data, self.start, self.end)
        else:
            self.first = off
            self.values = byte_values(data)
        self.prefix = Prefix(self.values, small=unit == "byte")

    def kept(self, unit: str, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that stay, with one space between words, and each row's offset in them."""
        stay = np.flatnonzero(~gone)
        count = np.searchsorted(stay, self.first)
        if unit == "byte":
            return self.data[stay], count
        lo, hi = self.start[stay], self.end[stay]
        out = np.append(self.data, np.uint8(32))[spread(lo, hi + 1)]
        ends = np.cumsum(hi - lo + 1)
        out[ends - 1] = 32
        return out, np.concatenate(([0], ends))[count]


def _arrays(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """A list column's rows lo..hi as one array of uint64 and each value's row, counted from lo."""
    col = batch.column(name).slice(lo, hi - lo)
    size = np.nan_to_num(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U), np.repeat(np.arange(hi - lo), size)


def _in_row(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each (row, key), its place among the wanted (row, key) pairs, or -1."""
    spot = U(0x9E3779B97F4A7C15)
    have, need = mix(keys + rows.astype(U) * spot), mix(wanted + of.astype(U) * spot)
    order = np.argsort(need)
    at = np.searchsorted(need[order], have)
    at[at == len(order)] = 0
    return np.where(need[order][at] == have, order[at], -1) if len(order) else np.full(len(have), -1)


def _anchors(unit: str, width: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row's distinct blocks, and how often it holds each."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in spans(batch.column("text")):
                chunk = Chunk(unit, data, off)
                b = Blocks(chunk.values, chunk.prefix, chunk.first, width, gram)
                if not len(b):
                    continue
                _, at, n = np.unique(b.keys(), return_index=True, return_counts=True)
                ids = batch.column("id").slice(lo, hi - lo).take(pa.array(b.row[at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(b.anchor[at])), pa.array(signed(b.mark[at])), pa.array(n)], ["id", "anchor", "mark", "n"])

    return trimmed(run)


def _asked_blocks(batch: pa.RecordBatch, lo: int, hi: int, chunk: Chunk, width: int, gram: int) -> tuple[Blocks, np.ndarray, np.ndarray]:
    """A chunk's blocks, those of them that its rows' marks ask for, and each one's place among the marks."""
    b = Blocks(chunk.values, chunk.prefix, chunk.first, width, gram)
    at = _in_row(b.mark, b.row, *_arrays(batch, "marks", lo, hi))
    pick = np.flatnonzero(at >= 0)
    return b, pick, at[pick]


def _windows(unit: str, width: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All windows of the opened blocks; over bytes, those that the block's reach leaves in question."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in spans(batch.column("text")):
                chunk = Chunk(unit, data, off)
                b, pick, at = _asked_blocks(batch, lo, hi, chunk, width, gram)
                many, _ = _arrays(batch, "many", lo, hi)
                begin, end = b.lo[pick], b.hi[pick]
                if unit == "byte":
                    left, _ = _arrays(batch, "left", lo, hi)
                    right, _ = _arrays(batch, "right", lo, hi)
                    begin = np.maximum(begin, b.place[pick] - left[at].astype(np.int64))
                    end = np.minimum(end, b.place[pick] + gram + right[at].astype(np.int64) - width)
                    # a repeated block inside one row is opened once: all its windows count many times
                    some = np.flatnonzero(begin <= end)
                    _, once = np.unique(mix(b.mark[pick[some]] + b.row[pick[some]].astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
                    pick, at, begin, end = (x[some[once]] for x in (pick, at, begin, end))
                if not len(pick):
                    continue
                s, size = spread(begin, end + 1), end - begin + 1
                key = chunk.prefix.slices(s, s + width)
                row, n = np.repeat(b.row[pick], size), np.repeat(many[at].astype(np.int64), size)
                _, first, inverse = np.unique(mix(key + row.astype(U) * U(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
                total = np.bincount(inverse, weights=n).astype(np.int64)
                single = np.bincount(inverse, weights=n == 1) > 0
                ids = batch.column("id").slice(lo, hi - lo).take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(signed(key[first])), pa.array(total), pa.array(single)], ["id", "window", "n", "single"])

    return trimmed(run)


def levels(width: int, gram: int) -> list[int]:
    """The bytes by which an anchor is lengthened to a side: each twice those before, the last up to a whole window."""
    return sorted({max(1, (width - gram) >> k) for k in range(4)})


def _stretches(width: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each opened block and side, its anchor's name and those of the stretches by which each round lengthens it, as far as its windows reach."""
    far = levels(width, gram)

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in spans(batch.column("text")):
                chunk = Chunk("byte", data, off)
                b, pick, at = _asked_blocks(batch, lo, hi, chunk, width, gram)
                _, once = np.unique(mix(b.mark[pick] + b.row[pick].astype(U) * U(0x9E3779B97F4A7C15)), return_index=True)
                pick, at = pick[once], at[once]
                if not len(pick):
                    continue
                many, _ = _arrays(batch, "many", lo, hi)
                place = b.place[pick]
                room = place - b.lo[pick], b.hi[pick] + width - place - gram
                for side in (0, 1):
                    reach = np.searchsorted(far, room[side], "right")
                    some = np.flatnonzero(reach)
                    p, names = place[some], np.zeros((len(some), len(far)), U)
                    for k, (near, to) in enumerate(zip([0, *far], far, strict=False)):
                        ok = np.flatnonzero(reach[some] > k)
                        ends = (p[ok] - to, p[ok] - near) if side == 0 else (p[ok] + gram + near, p[ok] + gram + to)
                        names[ok, k] = chunk.prefix.slices(*ends)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(reach[some]))).astype(np.int32)), pa.array(signed(names[np.arange(len(far)) < reach[some][:, None]])))
                    ids = batch.column("id").slice(lo, hi - lo).take(pa.array(b.row[pick[some]]))
                    columns = [ids, pa.array(signed(b.mark[pick[some]])), pa.array(many[at[some]].astype(np.int64)), pa.array(np.full(len(some), side, np.int32)), pa.array(signed(b.anchor[pick[some]])), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "n", "side", "rank", "names"])

    return trimmed(run)


def factors(begin: np.ndarray, end: np.ndarray, source: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse: begin, end, source and row of each factor.

    begin and end are runs of windows that some reference block holds, in order, each with its source
    and row. A factor takes in one run after another as long as the next begins where the last ended
    and its source is the same; so it covers its windows' items, `width` of them at least.
    """
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != end[:-1] + 1) | (row[1:] != row[:-1]) | (source[1:] != source[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(begin)) - 1 if len(at) else at
    return begin[at], end[last] + width, source[at], row[at]


def _final(unit: str, width: int, gram: int, characters: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in spans(batch.column("text")):
                chunk = Chunk(unit, data, off)
                total, rows = int(chunk.first[-1]), hi - lo
                b = Blocks(chunk.values, chunk.prefix, chunk.first, width, gram)
                at = _in_row(b.mark, b.row, *_arrays(batch, "marks", lo, hi))
                known = np.flatnonzero(at >= 0)
                # windows in question stand in blocks that are not known as a whole: where factors begin and end
                wanted, of = _arrays(batch, "windows", lo, hi)
                open_ = np.flatnonzero(at < 0)
                open_ = open_[np.isin(b.row[open_], of)]
                size = b.hi[open_] - b.lo[open_] + 1
                s, s_row = spread(b.lo[open_], b.hi[open_] + 1), np.repeat(b.row[open_], size)
                hit = _in_row(chunk.prefix.slices(s, s + width), s_row, wanted, of)
                s, s_row, hit = s[hit >= 0], s_row[hit >= 0], hit[hit >= 0]
                block_source, window_source = (_arrays(batch, c, lo, hi)[0] for c in ("mark_sources", "window_sources"))
                runs_ = np.concatenate([b.lo[known], s]), np.concatenate([b.hi[known], s]), np.concatenate([block_source[at[known]], window_source[hit]]), np.concatenate([b.row[known], s_row])
                order = np.argsort(runs_[0], kind="stable")
                begin, end, source, row = factors(*(x[order] for x in runs_), width)
                step = np.zeros(total + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, end, -1)
                gone = np.cumsum(step[:-1]) > 0
                if characters and total:
                    # a character goes only if all its bytes do
                    heads = np.union1d(np.flatnonzero((chunk.data & 0xC0) != 0x80), [0])
                    gone = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, total)))
                # a span begins where a removed item follows a kept one or the row's beginning
                before, after = np.zeros(total, bool), np.zeros(total, bool)
                before[1:], after[:-1] = gone[:-1], gone[1:]
                before[chunk.first[:-1][chunk.first[:-1] < total]] = False
                last = chunk.first[1:] - 1
                after[last[last >= 0]] = False
                span_begin, span_end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
                out, ends = chunk.kept(unit, gone)
                sums = np.concatenate(([0], np.cumsum(gone)))[chunk.first]
                per, base = np.searchsorted(span_begin, chunk.first), chunk.first[:-1]
                raw, kept, found = out.tobytes(), [], []
                for i in range(rows):
                    kept.append(raw[ends[i] : ends[i + 1] - (unit == "word" and ends[i + 1] > ends[i])])
                    found.append(np.stack([span_begin[per[i] : per[i + 1]] - base[i], span_end[per[i] : per[i + 1]] - base[i]], 1).ravel())
                columns = {
                    "id": batch.column("id").slice(lo, rows),
                    "n_items": pa.array(np.diff(chunk.first)),
                    "n_removed": pa.array(np.diff(sums)),
                    "n_spans": pa.array(np.diff(per)),
                    "spans": pa.array(found, pa.list_(pa.int64())),
                    "kept": pa.array(kept, pa.binary()),
                }
                columns |= {c: batch.column(c).slice(lo, rows) for c in batch.schema.names if c.startswith("held_")}
                if unit == "word":
                    lines = pa.StructArray.from_arrays([pa.array(x) for x in (begin - base[row], end - base[row], signed(source))], ["begin", "end", "source"])
                    columns["factors"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), lines)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return trimmed(run)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"])


def _gathered(rows: DataFrame, keys: list[str], facts: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """rows and facts about all that share the keys, and the facts alone: gathered first, so that rows of a hot key can be split as they meet them."""
    known = cut(rows.groupBy(*keys).agg(*(f.alias(k) for k, f in facts.items())))
    return rows.join(known, keys), known


def _beside(rows: DataFrame, keys: list[str], facts: dict[str, Column]) -> DataFrame:
    """rows and facts about all that share the keys, where no key is hot: one exchange."""
    return rows.withColumns({k: f.over(Window.partitionBy(*keys)) for k, f in facts.items()})


def hot_anchors(docs: DataFrame, unit: str, width: int, gram: int, sampled: int = SAMPLED, least: int = 16) -> DataFrame | None:
    """Anchors that hold more than HOT of a partition's rows in a sample of documents: at most partitions / HOT of them."""
    kind = docs.schema["id"].dataType.simpleString()
    some = docs.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(sampled)) == 0).mapInArrow(_anchors(unit, width, gram), f"id {kind}, anchor long, mark long, n long")
    counts = some.groupBy("anchor").agg(F.count("*").alias("c"))
    share = HOT / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = counts.where(F.col("c") >= least).crossJoin(F.broadcast(counts.agg(F.sum("c").alias("all")))).where(F.col("c") > F.col("all") * share)
    rows = [r["anchor"] for r in found.select("anchor").collect()]
    return docs.sparkSession.createDataFrame([(a,) for a in rows], "anchor long") if rows else None


def _index(docs: DataFrame, unit: str, width: int, gram: int, hot: DataFrame | None) -> DataFrame:
    """Blocks by document that are not alone: their copies, their first holder, whether other blocks share the anchor."""
    kind = docs.schema["id"].dataType.simpleString()
    anchors = docs.mapInArrow(_anchors(unit, width, gram), f"id {kind}, anchor long, mark long, n long")
    ends = {"low": F.min("mark"), "high": F.max("mark")}
    block = ["anchor", "mark"], {"many": F.sum("n"), "first": F.min("id")}
    if hot is not None:
        anchors, often = anchors.join(F.broadcast(hot), "anchor", "left_anti"), cut(anchors.join(F.broadcast(hot), "anchor", "left_semi"))
    # the exchange by anchor serves both groupings
    rows = _beside(_beside(anchors, ["anchor"], ends), *block).withColumn("hot", F.lit(False))
    if hot is not None:
        found, blocks = _gathered(often, *block)
        sides = blocks.groupBy("anchor").agg(*(f.alias(k) for k, f in ends.items()))
        rows = rows.unionByName(found.join(F.broadcast(sides), "anchor").withColumn("hot", F.lit(True)))
    rows = rows.withColumn("opened", F.col("low") != F.col("high"))
    return cut(rows.where("many > 1 or opened").select("id", "mark", "many", "first", "opened", "hot"))


def _asked(rows: DataFrame) -> DataFrame:
    """Blocks to be opened, by the document that speaks for all its copies: their earliest holder, or those without an id."""
    return rows.where(F.col("opened") & F.col("id").eqNullSafe(F.col("first"))).select("id", "mark", "many", F.col("hot").cast("long").alias("hot"))


def _lists(asked: DataFrame, *names: str) -> DataFrame:
    """Each document's blocks to be opened, as lists of one order."""
    return asked.groupBy("id").agg(F.collect_list(F.struct(*names)).alias("asked")).select("id", *(F.col(f"asked.{c}").cast("array<long>").alias("marks" if c == "mark" else c) for c in names))


def _looked_up(docs: DataFrame, asked: DataFrame, names: tuple[str, ...], run: Callable, facts: dict[str, Column], hot: bool) -> DataFrame:
    """The windows that asked blocks leave in question, and facts about all equal ones. Equal windows share an anchor, so both are hot or none."""

    def windows(some: DataFrame) -> DataFrame:
        lists = _lists(some, *names)
        kind = docs.schema["id"].dataType.simpleString()
        return docs.join(lists, _same(docs, lists)).drop(lists["id"]).mapInArrow(run, f"id {kind}, window long, n long, single boolean")

    if not hot:
        return _beside(windows(asked), ["window"], facts)
    return _beside(windows(asked.where("hot = 0")), ["window"], facts).unionByName(_gathered(windows(asked.where("hot = 1")), ["window"], facts)[0])


def _result(docs: DataFrame, flags: DataFrame, run: Callable, extra: str = "") -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()
    held = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name.startswith("held_"))
    block, window = (F.filter("found", lambda x: x[c].isNotNull()) for c in ("mark", "window"))
    flags = flags.groupBy("id").agg(F.collect_list(F.struct("mark", "window", "source")).alias("found"))
    flags = flags.select("id", block["mark"].alias("marks"), block["source"].alias("mark_sources"), window["window"].alias("windows"), window["source"].alias("window_sources"))
    joined = docs.join(flags, _same(docs, flags), "left").drop(flags["id"])
    return joined.mapInArrow(run, f"id {kind}, n_items long, n_removed long, n_spans long, spans array<long>, kept binary{held}{extra}")


def rlz_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 16, sampled: int = SAMPLED, least: int = 16) -> DataFrame:
    """Relative Lempel-Ziv parsing: remove words that an earlier document (a smaller id) holds as well.

    Every block of every document is a reference block, indexed with its first holder. A document is
    factored greedily from left to right against that index: a factor runs on as long as the next
    block is held by the same earlier document. Where a block is not held as a whole, factors begin
    or end inside it: its windows are looked up one by one, against those of all blocks that share its
    anchor, and lengthen the factor or make one of their own. Factors, of `window` words at least,
    are what is removed. Windows that straddle two factors are windows of such blocks, so a word goes
    exactly when a window that covers it also starts in an earlier document.

    Returns id, n_items (words), n_removed, n_spans, spans (begin and end word of each removed run,
    flat), kept (bytes: the remaining words with one space between), factors (begin, end, source).
    """
    frugal(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if docs.schema["id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("rlz_dedup orders documents by an integer id")
    docs = docs.withColumn("id", F.col("id").cast("long"))
    hot = hot_anchors(docs, "word", window, gram, sampled, least)
    rows = _index(docs, "word", window, gram, hot)
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    part = _looked_up(docs, _asked(rows), ("mark", "many"), _windows("word", window, gram), {"first": F.min("id")}, hot is not None).where(later)
    none = F.lit(None).cast("long")
    flags = rows.where(later).select("id", "mark", none.alias("window"), F.col("first").alias("source")).union(part.select("id", none, "window", "first"))
    out = _result(docs, flags, _final("word", window, gram), ", factors array<struct<begin:long,end:long,source:long>>")
    return out.withColumnRenamed("id", id_col)


def rounds(positions: DataFrame, far: list[int], hot: bool = False) -> list[DataFrame]:
    """Prefix doubling from ranked positions: each round's rows with their new rank and how many positions share it.

    positions: id, mark, n (copies), side, rank, names (of the stretches that each round adds).
    In round j those whose side reaches far[j] are sorted by (rank, name of the next stretch). The
    smallest position of each such pair is the pair's rank. Positions of a unique rank go no further.
    """
    out = []
    for j in range(len(far)):
        here = positions.where(F.size("names") > j).withColumns({"old": F.col("rank"), "name": F.element_at("names", j + 1)}).drop("rank")
        by = ["side", "old", "name"], {"all": F.sum("n"), "rank": F.min(F.xxhash64("id", "mark"))}
        ranked = cut(_gathered(here, *by)[0]) if hot else _beside(here, *by)
        out.append(ranked)
        positions = ranked.where("all > 1").drop("old", "name", "all")
    return out


def doubling_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 64, characters: bool = False, carry: tuple[str, ...] = (), sampled: int = SAMPLED, least: int = 16) -> DataFrame:
    """Prefix doubling: remove every byte of a `window`-byte string that occurs more than once anywhere.

    Positions are the anchors of `blocks.py`: equal windows hold equal anchors at equal places, so no
    other position needs a rank. A first ranking, by their `gram` bytes, drops unique ones; a ranking
    by whole blocks settles those that repeat past the threshold. The others are ranked in rounds (see
    `rounds`) by pairs of their rank and the name of the stretch at a growing offset, to either side,
    until their rank is unique or a whole window is reached. What is unique bounds how far windows
    around the position can repeat; those still in question get their last rank at full length.
    Copies lose all occurrences, the first included.

    Returns id, n_items (bytes), n_removed, n_spans, spans (flat begins and ends), kept (bytes).
    With `characters`, a run gives up the parts of characters at its ends, so kept stays valid UTF-8.
    `carry` names further columns of each row to return.
    """
    frugal(df.sparkSession)
    # every pass reads the same columns, so that one exchange of the texts serves them all
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"held_{i}") for i, c in enumerate(carry)))
    kind = docs.schema["id"].dataType.simpleString()
    slim = docs.select("id", "text")
    hot = hot_anchors(slim, "byte", window, gram, sampled, least)
    rows = _index(slim, "byte", window, gram, hot)
    opened = _asked(rows)
    asked = _lists(opened, "mark", "many")
    text = docs.join(asked, _same(docs, asked)).drop(asked["id"])
    positions = text.mapInArrow(_stretches(window, gram), f"id {kind}, mark long, n long, side int, rank long, names array<long>")
    far, rest, none = levels(window, gram), window - gram, F.lit(None).cast("long")
    # how far windows can repeat to the left and right of each opened block's anchor
    reach = opened.select("id", "mark", "many", "hot", F.lit(rest).alias("left"), F.lit(rest).alias("right"))
    for to, ranked in zip(far, rounds(positions, far, hot is not None), strict=True):
        ends = [F.when(F.col("side") == side, to - 1).alias(name) for side, name in enumerate(("left", "right"))]
        reach = reach.unionByName(ranked.where("all = 1").select("id", "mark", none.alias("many"), none.alias("hot"), *ends))
    reach = reach.groupBy("id", "mark").agg(F.max("many").alias("many"), F.max("hot").alias("hot"), F.min("left").alias("left"), F.min("right").alias("right"))
    reach = reach.where(F.col("left") + F.col("right") >= rest)
    part = _looked_up(docs, reach, ("mark", "many", "left", "right"), _windows("byte", window, gram), {"all": F.sum("n")}, hot is not None).where(F.col("single") & (F.col("all") > 1))
    nobody = F.lit(0).cast("long")
    flags = rows.where("many > 1").select("id", "mark", none.alias("window"), nobody.alias("source")).union(part.select("id", none, "window", nobody))
    out = _result(docs, flags, _final("byte", window, gram, characters))
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"held_{i}", c)
    return out.withColumnRenamed("id", id_col)
