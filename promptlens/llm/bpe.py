"""Byte-pair encoding with forced boundaries, and decoding.

Two bytes that never stand side by side inside any vocabulary token can never be merged, so every
such pair is a certain cut: the fragments on both sides are encoded on their own and concatenated.

A chunk's distinct words are found by their fingerprints, and compared by their bytes. Those that the
worker does not remember are split and normalised together, cut into fragments by one look at all
their byte pairs, and each distinct fragment goes through the merge rules once. What words became is
remembered in flat arrays (about 50 bytes a word), of at most CACHE words: the least lately used go.
Words of more than LONGEST bytes are encoded each time, not remembered. A worker's memory is bounded by
these and by CHUNK: ids become text inside Arrow, and freed memory goes back with each chunk. What is
remembered goes when the worker turns to another operator.

Edge cases: a null or empty text has no ids and decodes to the empty string. The strings of special
tokens in a text become their ids, as in the tokenizers library. Rows that repeat are encoded one by
one. Other columns stay as they are, whatever their names, except those named like the output. Texts
and words of any length are encoded whole. A file whose way of splitting texts is another one than
that of word_bpe_49k.json is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.llm.arrowtext import U, frugal, keeps, release, spans, spread, trimmed, word_values, words

#: Words that a worker remembers, and the most bytes of each; bytes of texts that are encoded together.
CACHE, LONGEST, CHUNK = 500_000, 64, 1 << 19
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
# How the vocabulary's file splits and normalises texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same pattern for lower-case printable ASCII and white space.
_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 ]+")
#: Stands between words that are split together; a word that holds it is split alone.
_MARK = "\ue000"


def _alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ForcedBoundaryBPE:
    """Encoder of one vocabulary file of the tokenizers library (BPE with word ends)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        # only what splits texts is kept of the library's tokenizer, not its model; that goes before the rest is built
        whole = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        del whole
        release()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if spec["normalizer"] != NORMALIZER or [x["type"] for x in split] != ["Split", "ByteLevel"] or split[0]["pattern"] != {"Regex": PATTERN} or split[1]["add_prefix_space"] or split[1]["use_regex"]:
            raise ValueError("the file splits or normalises texts in another way")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # the merge rules, once for fragments that end a word and once for the others
        self.ends = BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.suffix, cache_capacity=0) if self.suffix else BPE(vocab=vocab, merges=merges, cache_capacity=0)
        self.inside = BPE(vocab=vocab, merges=merges, cache_capacity=0)
        tokens = {i: t for t, i in vocab.items()}
        special = {}
        for t in spec["added_tokens"]:
            if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("only added tokens that match as they are can be handled")
            special[t["content"].encode()] = t["id"]
            tokens[t["id"]] = t["content"]
        #: The tokens by id.
        self.table = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.string())
        self.special = special
        self.at_special = re.compile(b"(" + b"|".join(map(re.escape, special)) + b")") if special else None
        self.shown = _alphabet()
        byte_of = {c: b for b, c in self.shown.items()}
        self.to_bytes, self.to_shown = {ord(c): b for c, b in byte_of.items()}, {b: c for b, c in self.shown.items()}
        #: Whether two bytes stand side by side inside some token.
        self.inner = np.zeros(65536, bool)
        for t in vocab:
            body = t.removesuffix(self.suffix) if self.suffix else t
            if all(c in byte_of for c in body):
                raw = [byte_of[c] for c in body]
                self.inner[[256 * a + b for a, b in zip(raw, raw[1:])]] = True
        self.mark = self._split(f"a {_MARK} a")[1]
        # what words became, sorted by fingerprint: place and size of their bytes and ids, when they were last met
        self.key = np.zeros(0, U)
        self.at = np.zeros((5, 0), np.int32)
        self.bytes, self.ids, self.clock = np.zeros(0, np.uint8), np.zeros(0, np.int32), 0

    def _split(self, text: str) -> list[str]:
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def _pieces(self, words_: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The pieces of words, in any order: their bytes one after another, each one's size and the number of its word."""
        size = np.array(list(map(len, words_)), np.int64)
        data = np.frombuffer(b"".join(words_), np.uint8)
        plain = np.logical_and.reduceat(_PLAIN[data], np.cumsum(size) - size) if len(size) else np.zeros(0, bool)
        out, sizes, owner = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if plain.any():
            found = _ASCII.findall(b" ".join([w for w, p in zip(words_, plain.tolist(), strict=True) if p]).lower())
            out += found
            sizes.append(np.array(list(map(len, found)), np.int64))
            owner.append(np.flatnonzero(plain)[np.searchsorted(np.cumsum(size[plain]), np.cumsum(sizes[-1]) - sizes[-1], "right")])
        other = np.flatnonzero(~plain)
        texts = [words_[i].decode("utf-8", "replace") for i in other.tolist()]
        alone = [k for k, t in enumerate(texts) if _MARK in t]
        together = np.setdiff1d(np.arange(len(texts)), alone)
        lines = [(other[[k]], self._split(texts[k])) for k in alone]
        if len(together):
            lines.append((other[together], self._split(f" {_MARK} ".join([texts[k] for k in together.tolist()]))))
        for of, pieces in lines:
            marks = np.array([p == self.mark for p in pieces], bool) if len(of) > 1 else np.zeros(len(pieces), bool)
            pieces = [p for p, m in zip(pieces, marks.tolist(), strict=True) if not m]
            out.append("".join(pieces).translate(self.to_bytes).encode("latin-1"))
            sizes.append(np.array(list(map(len, pieces)), np.int64))
            owner.append(of[np.cumsum(marks)[~marks]])
        return b"".join(out), np.concatenate(sizes), np.concatenate(owner)

    def cuts(self, piece: str) -> list[str]:
        """Fragments of one piece, in the vocabulary's characters."""
        raw = piece.translate(self.to_bytes).encode("latin-1")
        begin, end, _ = self.fragments(raw, np.array([len(raw)]))
        return [piece[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def fragments(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fragments of pieces: begin, end, whether it ends a piece. Two bytes that no token holds together are cut."""
        data = np.frombuffer(raw, np.uint8).astype(np.int64)
        start = np.ones(len(data), bool)
        start[1:] = ~self.inner[256 * data[:-1] + data[1:]]
        ends = np.cumsum(sizes)
        start[(ends - sizes)[sizes > 0]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data)) if len(begin) else begin
        return begin, end, np.isin(end, ends)

    def fragment(self, shown: str, last: bool) -> list[int]:
        """The ids of one fragment; the last of a piece carries the word end."""
        return [t.id for t in (self.ends if last else self.inside).tokenize(shown)]

    def fresh(self, words_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        parts, of = words_, np.arange(len(words_))
        if self.at_special and any(b"<|" in w for w in words_):  # stretches between special tokens, and those
            split = [[x for x in self.at_special.split(w) if x] if b"<|" in w else [w] for w in words_]
            parts, of = [x for line in split for x in line], np.repeat(of, list(map(len, split)))
        special = np.array([k for k, x in enumerate(parts) if x in self.special], np.int64)
        plain = np.setdiff1d(np.arange(len(parts)), special)
        raw, sizes, owner = self._pieces([parts[k] for k in plain.tolist()] if len(special) else parts)
        begin, end, last = self.fragments(raw, sizes)
        piece = np.searchsorted(np.cumsum(sizes), begin, "right")
        # equal fragments are encoded once
        data, shown = np.frombuffer(raw, np.uint8), raw.decode("latin-1").translate(self.to_shown)
        at, which = _distinct(data, begin, end, last)
        ids = [self.fragment(shown[a:b], z) for a, b, z in zip(begin[at].tolist(), end[at].tolist(), last[at].tolist(), strict=True)]
        count = np.array(list(map(len, ids)), np.int64)
        flat = np.array([x for f in ids for x in f], np.int32)
        starts = np.cumsum(count) - count
        part = plain[owner[piece]]
        # special tokens take their place among the fragments
        flat = np.append(flat, np.array([self.special[parts[k]] for k in special.tolist()], np.int32))
        starts = np.concatenate([starts[which], len(flat) - len(special) + np.arange(len(special))])
        count = np.concatenate([count[which], np.ones(len(special), np.int64)])
        part = np.concatenate([part, special])
        order = np.argsort(part, kind="stable")
        starts, count, part = starts[order], count[order], part[order]
        each = np.bincount(of[part], weights=count, minlength=len(words_)).astype(np.int64)
        return flat[spread(starts, starts + count)], each

    def _remember(self, key: np.ndarray, words_: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        if len(self.key) + len(key) > CACHE:
            keep = np.sort(np.argsort(-self.at[4], kind="stable")[: max(0, CACHE // 2 - len(key))])
            lo, n, ilo, m, seen = self.at[:, keep]
            self.bytes, self.ids = self.bytes[spread(lo, lo + n)], self.ids[spread(ilo, ilo + m)]
            self.key, self.at = self.key[keep], np.stack([np.cumsum(n) - n, n, np.cumsum(m) - m, m, seen]).astype(np.int32)
        n = np.array(list(map(len, words_)), np.int64)
        new = np.stack([len(self.bytes) + np.cumsum(n) - n, n, len(self.ids) + np.cumsum(size) - size, size, np.full(len(key), self.clock)]).astype(np.int32)
        order = np.argsort(key, kind="stable")
        spot = np.searchsorted(self.key, key[order])
        self.key, self.at = np.insert(self.key, spot, key[order]), np.insert(self.at, spot, new[:, order], axis=1)
        self.bytes, self.ids = np.append(self.bytes, np.frombuffer(b"".join(words_), np.uint8)), np.append(self.ids, ids)

    def chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of texts, and where each text's begin in them (one more entry than texts)."""
        start, end, first = words(data, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        self.clock += 1
        at, inverse = _distinct(data, start, end)
        lo, hi = start[at], end[at]
        key = word_values(data, lo, hi)
        spot = np.searchsorted(self.key, key)
        spot[spot == len(self.key)] = 0
        hit = np.zeros(len(lo), bool)
        if len(self.key):
            same = np.flatnonzero((self.key[spot] == key) & (self.at[1, spot] == hi - lo))
            hit[same] = _equal(data, lo[same], hi[same], self.bytes, self.at[0, spot[same]])
        begin, count = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        held = np.flatnonzero(hit)
        self.at[4, spot[held]] = self.clock
        begin[held], count[held] = self.at[2, spot[held]], self.at[3, spot[held]]
        pool, missing = self.ids, np.flatnonzero(~hit)
        if len(missing):
            raw = data.tobytes()
            lost = [raw[a:b] for a, b in zip(lo[missing].tolist(), hi[missing].tolist(), strict=True)]
            ids, size = self.fresh(lost)
            begin[missing], count[missing] = len(pool) + np.cumsum(size) - size, size
            pool = np.append(pool, ids)
            # a fingerprint has one place: of words that share one, one is remembered
            _, named = np.unique(key[missing], return_index=True)
            if len(self.key):
                named = named[self.key[spot[missing[named]]] != key[missing[named]]]
            named = named[(hi - lo)[missing[named]] <= LONGEST]
            if len(named) <= CACHE // 2:
                keep = np.zeros(len(missing), bool)
                keep[named] = True
                named = np.flatnonzero(keep)
                self._remember(key[missing[named]], [lost[i] for i in named.tolist()], ids[np.repeat(keep, size)], size[named])
        b, n = begin[inverse], count[inverse]
        return pool[spread(b, b + n)], np.concatenate(([0], np.cumsum(n)))[first]

    def encode(self, text: bytes) -> bytes:
        """One text's ids, as 32-bit numbers."""
        return self.chunk(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tobytes()

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens with one space between."""
        return " ".join(self.table.take(pa.array(ids, pa.int32())).to_pylist())

    def texts(self, lists: pa.ListArray) -> pa.Array:
        """What decode gives for each list of ids, without a Python object for each."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.table.take(lists.values)), " ")


def _equal(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether data[lo:hi] is other[at:at + hi - lo], for each."""
    if not len(lo):
        return np.zeros(0, bool)
    size = hi - lo
    same = data[spread(lo, hi)] == other[spread(at, at + size)]
    return np.logical_and.reduceat(same, np.cumsum(size) - size)


def _distinct(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One of each distinct slice (of a kind), and for every slice the number of its like. The bytes decide."""
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    name = word_values(data, lo, hi)
    if kind is not None:
        name = name ^ kind.astype(U)
    _, at, inverse = np.unique(name, return_index=True, return_inverse=True)
    same = hi - lo == (hi - lo)[at][inverse]
    if kind is not None:
        same &= kind == kind[at][inverse]
    # slices of one length up to eight bytes cannot share a fingerprint
    long = np.flatnonzero(same & (hi - lo > 8))
    same[long] = _equal(data, lo[long], hi[long], data, lo[at][inverse[long]])
    if not same.all():
        names: dict[tuple[bytes, bool], int] = {}
        for i in np.flatnonzero(~same).tolist():
            inverse[i] = names.setdefault((data[lo[i] : hi[i]].tobytes(), kind is not None and bool(kind[i])), len(at))
            if inverse[i] == len(at):
                at = np.append(at, i)
    return at, inverse


@lru_cache(maxsize=2)
def coder(path: str) -> ForcedBoundaryBPE:
    """The encoder of a file; a worker keeps it, and what it remembers, from task to task of this operator."""
    out = ForcedBoundaryBPE(path)
    release()  # the file as JSON
    return out


def _without_coders() -> bool:
    any_ = coder.cache_info().currsize > 0
    coder.cache_clear()
    return any_


keeps((__name__,), _without_coders)


def _beside(df: DataFrame, added: tuple[str, ...], name: str, value) -> tuple[DataFrame, T.StructType]:
    """The columns that stay, with value last under a name of its own; and the schema of those that stay."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    out = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in added), value.alias(name))
    return out, T.StructType(out.schema.fields[:-1])


def _encoded(path: str, names: list[str], decoded: bool):
    """Batches without their last column, the text, and with its ids and, if asked for, their decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for lo, hi, data, off in spans(batch.column(batch.num_columns - 1), CHUNK):
                values, ends = bpe.chunk(data, off)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                added = [lists, bpe.texts(lists)] if decoded else [lists]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *added], names)
                del values, ends, lists, added
                release()

    return run


def encode(df: DataFrame, path: str, text_col: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns, the text's ids (array of int) and, if decoded names a column, their decoded text."""
    frugal(df.sparkSession)
    source, schema = _beside(df, (ids, *([decoded] if decoded else [])), "raw", F.col(f"`{text_col}`").cast("string"))
    schema = schema.add(ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, "string")

    return source.mapInArrow(trimmed(_encoded(path, schema.names, decoded is not None)), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and the text of the ids; null ids give null."""
    source, schema = _beside(df, (out,), "raw", F.col(f"`{ids}`").cast("array<int>"))
    schema = schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return source.mapInArrow(trimmed(run), schema)
