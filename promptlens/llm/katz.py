"""Language-model scores by Katz backoff over word bigrams.

Counts are discounted by Good-Turing; what a context's seen successors give up goes to the others by
their unigram probability, with a weight that makes the context's probabilities sum to one exactly.
A token is evaluated recursively: a stored bigram has its discounted probability, any other the
context's backoff weight times the unigram's, and an unknown word the unigram mass left for words
never seen. Bigrams below a count of `least` are counted but not stored, and their mass is backed off
as well; with least=1, as op6 has it, every bigram is stored.

Distribution. Words travel as 56-bit fingerprints. Each chunk of texts is packed into one blob for
each partition of the contexts: contexts, their successors, and how often training texts have each pair.
The rows where the pairs stand go to the chunk's own place. All are shuffled once and read by all branches
of one plan: count statistics, the words that end bigrams, the facts, and the scoring. A partition counts its bigrams, meets
its words' unigram counts, and answers each blob with facts, in the blob's order: a context's count and weight, a pair's count.
The chunk adds up its rows from them, so what travels follows the text, however many partitions there are. Backoff weights
are worked out and sent only for contexts with a pair that is not stored. Contexts of more tokens than a partition's mean
are dealt over all partitions by their successors; what they hold in all is added to each. A context is never a row a token: equal
pairs of a chunk are one entry. Each branch holds one partition or chunk at a time; `partitions` grows with
the corpus.

Edge cases: a null or empty text is one end token; a null id counts as the empty string for the
split; rows that repeat an id are scored one by one; an empty table gives an empty result; with no
training text, every token is unknown and has the whole unseen mass (log 0 is never taken).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.arrowtext import U, frugal, lowered, mix, spans, trimmed, word_values, words
from promptlens.llm.graph import cut

BEGIN, END = U(0x0101010101010100 & (2**56 - 1)), U(0x0202020202020200 & (2**56 - 1))
#: Counts up to this are discounted.
CUT = 5
#: Bytes of text in a chunk; training tokens for each partition of the contexts, from which their number follows.
CHUNK, TOKENS = 8 << 20, 1_000_000
_X = "p long, b long, i int, heads binary, sizes binary, tails binary, seen binary, times binary, rows binary, ids binary"
_ROWS = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_FACTS = "p long, i int, counts binary, scales binary, alphas binary, seen binary, factors binary"


def discounts(n: dict[int, int], k: int = CUT) -> list[float]:
    """Katz's factor for counts 1..k, from how many items occur r times; 0.5 less where Good-Turing has none."""
    top = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - top) / (1 - top) if n.get(r) and top < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def in_training(doc_id: object) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


def _tokens(data: np.ndarray, off: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, the row of each, and each row's number of words; fingerprints are made for about limit bytes at a time."""
    ids, counts, lo, n = [], [], 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        low = lowered(data[off[lo] : off[hi]])
        start, end, first = words(low, off[lo : hi + 1] - off[lo])
        ids.append(word_values(low, start, end) >> U(8))
        counts.append(np.diff(first))
        lo = hi
    each = np.concatenate(counts)
    return np.concatenate(ids), np.repeat(np.arange(n), each), each


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list, np.ndarray]]:
    ids = batch.column("id").to_pylist()
    train = np.array([in_training(x) for x in ids], bool)
    for lo, hi, data, off in spans(batch.column("text"), CHUNK):
        for a in range(0, hi - lo, 60_000):
            b = min(a + 60_000, hi - lo)
            yield lo + a, lo + b, data[off[a] : off[b]], off[a : b + 1] - off[a], ids, train[lo + a : lo + b]


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off, _, train in _chunks(batch):
            word, row, _ = _tokens(data, off)
            ids, n = np.unique(word[train[row]], return_counts=True)
            ids, n = np.append(ids, END), np.append(n, train.sum())
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)[n > 0]), pa.array(n[n > 0])], ["w", "c"])


def _seven(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: their upper bytes are alike."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _spread_out(x: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(x[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(x[4:], n * width, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _from_seven(x: bytes) -> np.ndarray:
    raw = np.frombuffer(x, np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view(U).ravel()


def _home(head: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of a context: rising with its id."""
    return ((head >> U(24)) * U(partitions)) >> U(32)


class _Pairs:
    """Tokens sorted by partition, context and successor; without p, a context's own partition. train: the token's row is learnt from."""

    def __init__(self, head: np.ndarray, tail: np.ndarray, rows: np.ndarray, train: np.ndarray, p: np.ndarray | None, partitions: int):
        order = np.lexsort((tail, head) if p is None else (tail, head, p))
        head, tail, train = head[order], tail[order], train[order]
        p = _home(head, partitions) if p is None else p[order]
        new_head = np.ones(len(head), bool)
        new_head[1:] = (head[1:] != head[:-1]) | (p[1:] != p[:-1])
        new = new_head.copy()
        new[1:] |= tail[1:] != tail[:-1]
        at, head_at = np.flatnonzero(new), np.flatnonzero(new_head)
        pair_of = np.searchsorted(at, head_at)
        self.rows, self.heads, self.tails = rows[order].astype(np.uint16), head[head_at], tail[at]
        self.times = np.diff(np.append(at, len(head))).astype(np.uint32)
        self.seen = np.add.reduceat(train.astype(np.uint32), at, dtype=np.uint32) if len(at) else np.zeros(0, np.uint32)
        self.sizes = np.diff(np.append(pair_of, len(at))).astype(np.uint32)
        self.cuts = np.searchsorted(p[head_at], np.arange(partitions + 1).astype(U))
        self.pair_cuts = np.append(pair_of, len(at))[self.cuts]

    def blobs(self) -> Iterator[tuple[int, dict[str, bytes]]]:
        for i in np.flatnonzero(self.cuts[1:] > self.cuts[:-1]).tolist():
            h, p = slice(self.cuts[i], self.cuts[i + 1]), slice(self.pair_cuts[i], self.pair_cuts[i + 1])
            yield i, {"heads": _squeezed(self.heads[h]), "sizes": _squeezed(self.sizes[h]), "tails": _seven(self.tails[p]), "seen": _squeezed(self.seen[p])}


def _own(sets: list[_Pairs], least: int) -> dict[str, bytes]:
    """What a chunk keeps: where its pairs stand, and for pairs that may not be stored, where the successor is a context (for an end, where the begin is: it occurs as often)."""
    heads, tails, seen = (np.concatenate([getattr(x, k) for x in sets]) for k in ("heads", "tails", "seen"))
    doubt = seen < least
    order = np.argsort(heads, kind="stable")
    want = np.where(tails[doubt] == END, BEGIN, tails[doubt])
    spots = order[np.searchsorted(heads[order], want)].astype(np.uint32)
    columns = {"heads": np.flatnonzero(heads == BEGIN).astype(np.uint32), "tails": spots, "seen": np.packbits(doubt)}
    columns |= {k: np.concatenate([getattr(x, k) for x in sets]) for k in ("sizes", "times", "rows")}
    return {k: _squeezed(v) for k, v in columns.items()}


def _pack(partitions: int, hot: np.ndarray, least: int):
    """Blobs of a chunk's pairs by the context's partition, numbered by i; the rest, with its rows' ids, at a negative p of its own.

    The pairs of a hot context are dealt over all partitions by context and successor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, data, off, ids, train in _chunks(batch):
                word, _, n = _tokens(data, off)
                rows = np.repeat(np.arange(hi - lo), n + 1)
                ends = np.cumsum(n + 1) - 1
                head, tail = np.full(len(rows), BEGIN), np.full(len(rows), END)
                inner = np.ones(len(rows), bool)
                inner[ends] = False
                tail[inner] = word
                inner = np.ones(len(rows), bool)
                inner[ends - n] = False
                head[inner] = word
                b = (part << 32) + serial
                serial += 1
                out = {k.split()[0]: [] for k in _X.split(", ")}
                learnt = train[rows]
                spread = np.isin(head, hot) if len(hot) else np.zeros(len(head), bool)
                cold = ~spread
                sets = [_Pairs(head[cold], tail[cold], rows[cold], learnt[cold], None, partitions)]
                if spread.any():
                    h, t = head[spread], tail[spread]
                    sets.append(_Pairs(h, t, rows[spread], learnt[spread], ((mix(h + mix(t)) >> U(32)) * U(partitions)) >> U(32), partitions))
                blobs = [{"p": i, "b": b, "i": k * partitions + i} | columns for k, x in enumerate(sets) for i, columns in x.blobs()]
                texts = json.dumps([ids[lo:hi], n.tolist()]).encode()
                for columns in [{"p": -1 - b, "b": b, "i": -1, "ids": texts} | _own(sets, least), *blobs]:
                    for name in out:
                        out[name].append(columns.get(name))
                kinds = {"p": pa.int64(), "b": pa.int64(), "i": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()], list(out))

    return run


class _Part:
    """One partition's blobs, put together."""

    def __init__(self, table: pa.Table):
        get = lambda k, kind: [_spread_out(x.as_py(), kind) for x in table.column(k)]
        heads = get("heads", U)
        sizes = np.concatenate(get("sizes", np.uint32)).astype(np.int64)
        #: The contexts of each blob, and of each entry which of them it has.
        self.heads, self.which = np.concatenate(heads), np.repeat(np.arange(len(sizes)), sizes)
        self.head = self.heads[self.which]
        self.tail = np.concatenate([_from_seven(x.as_py()) for x in table.column("tails")])
        #: Occurrences of each entry in training rows.
        seen = get("seen", np.uint32)
        self.seen = np.concatenate(seen).astype(np.int64)
        self.head_cuts, self.cuts = (np.cumsum([0, *map(len, x)]) for x in (heads, seen))
        self.key = mix(self.head + mix(self.tail))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One entry of each distinct pair, its training count, and the pair of each entry."""
        order = np.argsort(self.key)
        key = self.key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at, pair = np.flatnonzero(new), np.empty(len(key), np.int64)
        pair[order] = np.cumsum(new) - 1
        return order[at], np.add.reduceat(self.seen[order], at) if len(at) else np.zeros(0, np.int64), pair

    def backed_off(self, at: np.ndarray, n: np.ndarray, least: int, hot: np.ndarray) -> np.ndarray:
        """Which pairs are stored and share a context, not a hot one, with a pair that is not: its backoff weight needs them."""
        head, stored = self.head[at], n >= least
        return stored & np.isin(head, head[~stored]) & ~np.isin(head, hot)


def _blank(fields: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.table({k: pa.array([], kinds[kind]) for k, kind in (x.split() for x in fields.split(", "))})


def _partitions(fields: str, f):
    """f for partitions; for what chunks keep, nothing."""

    def run(table: pa.Table) -> pa.Table:
        return f(table) if table.column("p")[0].as_py() >= 0 else _blank(fields)

    return run


def _statistics(table: pa.Table) -> pa.Table:
    _, n, _ = _Part(table).counts()
    n = np.bincount(np.minimum(n, CUT + 2), minlength=CUT + 3)[1 : CUT + 2]
    return pa.table({"r": pa.array(np.arange(1, CUT + 2)), "n": pa.array(n)})


def _successors(least: int, hot: np.ndarray):
    """The words that end a partition's bigrams whose contexts back off, each once: their unigram counts come back to it."""

    def run(table: pa.Table) -> pa.Table:
        part = _Part(table)
        at, n, _ = part.counts()
        w = np.unique(part.tail[at[part.backed_off(at, n, least, hot)]])
        return pa.table({"p": pa.array(np.full(len(w), table.column("p")[0].as_py(), np.int64)), "w": pa.array(w.view(np.int64))})

    return run


def _hot_bigrams(least: int, hot: np.ndarray):
    """The stored bigrams of hot contexts, which stand in all partitions."""

    def run(table: pa.Table) -> pa.Table:
        part = _Part(table)
        at, n, _ = part.counts()
        some = (n >= least) & np.isin(part.head[at], hot)
        return pa.table({"h": pa.array(part.head[at[some]].view(np.int64)), "w": pa.array(part.tail[at[some]].view(np.int64)), "c": pa.array(n[some])})

    return run


def _low(c: np.ndarray, uni: list[float], most: float, total: int, unseen: float) -> np.ndarray:
    """Unigram probabilities by count."""
    d = np.array([0.0, *uni, most])[np.minimum(c, CUT + 1)]
    return np.where(c > 0, d * c / max(total, 1), unseen)


def _facts(uni: list[float], most_: float, hot: np.ndarray, hot_count: np.ndarray, total: int, unseen: float, least: int):
    """For each blob of a partition: its contexts' counts, factors and backoff weights, and its pairs' counts.

    words_ has the unigram counts of _successors; besides, without a count, the bigrams' discounts, and what hot contexts hold in all partitions: counts and probability.
    """

    def run(table: pa.Table, words_: pa.Table) -> pa.Table:
        if not table.num_rows or table.column("p")[0].as_py() < 0:
            return _blank(_FACTS)
        part = _Part(table)
        own = words_.column("c").is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        facts = words_.filter(pa.array(~own)).to_pylist()
        words_ = words_.filter(pa.array(own))
        factor, hot_held = np.ones(CUT + 2), {x["w"]: x["x"] for x in facts if x["w"] >= 0}
        for x in facts:
            if -CUT <= x["w"] < 0:
                factor[-x["w"]] = x["x"]
        hot_mass = {-x["w"] - CUT - 1: x["x"] for x in facts if x["w"] < -CUT}
        hot_h = np.array(list(hot_held), np.int64).view(U)
        hot_mass, hot_held = np.array([hot_mass[h] for h in hot_held], float), np.array(list(hot_held.values()), float)
        at, c, pair = part.counts()
        heads, of = np.unique(part.head, return_inverse=True)
        count = np.bincount(of, weights=part.seen, minlength=len(heads)).astype(np.int64)
        known_hot = np.searchsorted(hot, heads) if len(hot) else np.zeros(len(heads), np.int64)
        known_hot[known_hot == len(hot)] = 0
        is_hot = hot[known_hot] == heads if len(hot) else np.zeros(len(heads), bool)
        count[is_hot] = hot_count[known_hot[is_hot]]
        g, stored = of[at], c >= least
        star = np.where(stored, factor[np.minimum(c, CUT + 1)] * c, 0.0) / np.maximum(count[g], 1)
        kept = np.bincount(g, weights=star, minlength=len(heads)).astype(float)
        back = part.backed_off(at, c, least, hot)
        word, w = words_.column("w").to_numpy().view(U), part.tail[at[back]]
        order = np.argsort(word)
        cw = words_.column("c").to_numpy()[order[np.searchsorted(word[order], w)]] if len(w) else np.zeros(0, np.int64)
        mass = np.bincount(g[back], weights=_low(cw, uni, most_, total, unseen), minlength=len(heads)).astype(float)
        if len(hot_h):
            order_h = np.argsort(hot_h)
            spot = np.searchsorted(hot_h[order_h], heads)
            spot[spot == len(order_h)] = 0
            spot = order_h[spot]
            here = hot_h[spot] == heads
            kept[here], mass[here] = hot_held[spot[here]] / np.maximum(count[here], 1), hot_mass[spot[here]]
        # a context whose successors give nothing up keeps one part in count + 1 for the others
        most = 1 - 1 / (count + 1.0)
        scale = np.where(kept > most, most / np.maximum(kept, 1e-300), 1.0)
        alpha = np.log10(np.maximum((1 - kept * scale) / np.maximum(1 - mass, 1e-12), 1e-300))
        alpha[kept == 0] = 0.0
        held, context, times = c[pair], np.searchsorted(heads, part.heads), factor.tobytes()
        out = {k.split()[0]: [] for k in _FACTS.split(", ")}
        for j, (b, i) in enumerate(zip(table.column("b").to_pylist(), table.column("i").to_pylist(), strict=True)):
            mine, entries = context[part.head_cuts[j] : part.head_cuts[j + 1]], slice(part.cuts[j], part.cuts[j + 1])
            off = np.unique(part.which[entries][held[entries] < least])  # contexts that back off in this blob
            row = (-1 - b, i, _squeezed(count[mine]), _squeezed(scale[mine]), _squeezed(alpha[context[off]]), _squeezed(held[entries]), times)
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
        return pa.table({k: pa.array(v, _blank(_FACTS).schema.field(k).type) for k, v in out.items()})

    return run


def _gather(uni: list[float], most: float, total: int, distinct: int, unseen: float, end_count: int, least: int):
    """A chunk's rows, from what it kept and the facts of its blobs."""

    def run(own: pa.Table, facts: pa.Table) -> pa.Table:
        if not own.num_rows or own.column("p")[0].as_py() >= 0:
            return _blank(_ROWS)
        get = lambda k, kind: _spread_out(own.column(k)[0].as_py(), kind)
        facts = facts.sort_by("i")
        all_ = lambda k, kind: np.concatenate([_spread_out(x.as_py(), kind) for x in facts.column(k)])
        count, scale, held, factor = all_("counts", np.int64), all_("scales", float), all_("seen", np.int64), np.frombuffer(facts.column("factors")[0].as_py(), float)
        of = np.repeat(np.arange(len(count)), get("sizes", np.uint32))
        times, rows = get("times", np.uint32), get("rows", np.uint16)
        ids, words_ = json.loads(own.column("ids")[0].as_py())
        stored = held >= least
        entry = np.zeros(len(held))
        h, c = of[stored], held[stored]
        entry[stored] = np.log10(factor[np.minimum(c, CUT + 1)] * c / np.maximum(count[h], 1) * scale[h])
        alpha, off = np.zeros(len(count)), of[~stored]
        alpha[np.unique(off)] = all_("alphas", float)
        spot = np.zeros(len(held), np.int64)
        spot[np.unpackbits(get("seen", np.uint8), count=len(held)).astype(bool)] = get("tails", np.uint32)
        entry[~stored] = alpha[off] + np.log10(_low(count[spot[~stored]], uni, most, total, unseen))
        real = np.ones(len(count), bool)
        real[get("heads", np.uint32)] = False
        base = np.where(real, np.log10((count + 0.1) / (total + 0.1 * (distinct + 1))), 0.0)
        base, score, known = (np.bincount(rows, weights=np.repeat(x, times), minlength=len(ids)) for x in (base[of], entry, (real & (count > 0))[of].astype(float)))
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([not in_training(x) for x in ids]),
            pa.array(np.array(words_, np.int64) + 1),
            pa.array(np.rint(known).astype(np.int64) + (end_count > 0)),
            pa.array(np.full(len(ids), total)),
            pa.array(base + np.log10((end_count + 0.1) / (total + 0.1 * (distinct + 1)))),
            pa.array(score),
        ]
        return pa.table(columns, ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def katz_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, partitions: int | None = None, hot_share: float | None = None) -> DataFrame:
    """Scores of all texts by a model of those whose crc32(id) mod 10 is not 0.

    Returns id (long), held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and
    score (log10 probability). least: the count from which a bigram is stored.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    uni = cut(docs.mapInArrow(trimmed(_unigrams), "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    few = {r["r"]: r for r in uni.groupBy(F.least("c", F.lit(CUT + 2)).alias("r")).agg(F.count("*").alias("n"), F.sum("c").alias("all")).collect()}
    total, distinct = sum(r["all"] for r in few.values()), sum(r["n"] for r in few.values())
    partitions = partitions or max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TOKENS))
    ends = uni.where(F.col("w") == int(END)).first()
    ends = ends["c"] if ends else 0
    # the sum of counts over CUT + 1 is undiscounted
    d1 = discounts({r: few[r]["n"] for r in few if r <= CUT + 1})
    given = sum((d1[r - 1] if r <= CUT else 1.0) * few[r]["all"] for r in few)
    # where nothing is discounted, one part in total + 1 is left for unknown words
    shrink = 1.0 if given < total or not total else total / (total + 1)
    unseen = 1 - shrink * given / total if total else 1.0
    d1 = [shrink * d for d in d1]
    low = F.element_at(F.array(*map(F.lit, [*d1, shrink])), F.least("c", F.lit(CUT + 1)).cast("int")) * F.col("c") / F.lit(max(total, 1))

    # contexts of more tokens than a partition's mean, at most as many as partitions
    most = total * (hot_share or 1 / partitions)
    often = {int(r["w"]): r["c"] for r in uni.where((F.col("c") > most) & (F.col("w") != int(END))).collect()}
    if ends > most:
        often[int(BEGIN)] = ends
    hot = np.array(sorted(often), np.int64)
    hot_count = np.array([often[int(h)] for h in hot], np.int64)
    packed = docs.mapInArrow(trimmed(_pack(partitions, hot.view(U), least)), _X)
    by_part = packed.groupBy("p")
    stats = by_part.applyInArrow(_partitions("r long, n long", _statistics), "r long, n long").groupBy("r").agg(F.sum("n").alias("n"))
    # six numbers, as one row: broadcast to the table's rows
    n = [F.coalesce(F.max(F.when(F.col("r") == r, F.col("n"))), F.lit(0)).alias(f"n{r}") for r in range(1, CUT + 2)]
    line = stats.agg(*n).select(F.array(*(f"n{r}" for r in range(1, CUT + 2))).alias("n"))
    line = line.select(_discount_column(F.col("n")).alias("d"))
    # counts travel, not probabilities: they are small numbers; the discounts go to each partition once
    every, none = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(partitions - 1).cast("long"))).alias("p"), F.lit(None).cast("long").alias("c")
    table = by_part.applyInArrow(_partitions("p long, w long", _successors(least, hot.view(U))), "p long, w long").join(uni, "w").select("p", "w", "c", F.lit(None).cast("double").alias("x"))
    # in place of a word: -r, with the factor of counts r
    table = table.unionByName(line.select(F.posexplode("d").alias("r", "x")).select(every, (-F.col("r") - 1).cast("long").alias("w"), none, "x"))
    if often:
        star = F.element_at(F.concat("d", F.array(F.lit(1.0))), F.least("c", F.lit(CUT + 1)).cast("int")) * F.col("c")
        held = by_part.applyInArrow(_partitions("h long, w long, c long", _hot_bigrams(least, hot.view(U))), "h long, w long, c long").crossJoin(F.broadcast(line)).select("h", "w", star.alias("held")).join(uni.select("w", low.alias("pw")), "w")
        held = held.groupBy("h").agg(F.sum("pw").alias("mass"), F.sum("held").alias("held"))
        # two rows for a hot context: h with its counts, and a number below those of the factors with its probability
        both = F.explode(F.array(F.struct(F.col("h").alias("w"), F.col("held").alias("x")), F.struct((-F.col("h") - CUT - 1).alias("w"), F.col("mass").alias("x")))).alias("f")
        table = table.unionByName(held.select("h", both).select(every, "f.w", none, "f.x"))
    facts = by_part.cogroup(table.groupBy("p")).applyInArrow(_facts(d1, shrink, hot.view(U), hot_count, total, unseen, least), _FACTS)
    out = by_part.cogroup(facts.groupBy("p")).applyInArrow(_gather(d1, shrink, total, distinct, unseen, ends, least), _ROWS)
    return out.withColumnRenamed("id", id_col)


def _discount_column(n):
    """discounts() as a column, over the array of n_1 .. n_(CUT + 1)."""
    at = lambda r: F.element_at(n, r).cast("double")
    top = F.when(at(1) > 0, (CUT + 1) * at(CUT + 1) / F.greatest(at(1), F.lit(1.0))).otherwise(F.lit(1.0))
    each = []
    for r in range(1, CUT + 1):
        d = F.when((at(r) > 0) & (top < 1), ((r + 1) * at(r + 1) / (r * F.greatest(at(r), F.lit(1.0))) - top) / F.when(top < 1, 1 - top).otherwise(1.0))
        each.append(F.when((d > 0) & (d < 1), d).otherwise(F.lit((r - 0.5) / r)))
    return F.array(*each)
