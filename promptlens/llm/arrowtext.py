"""Vectorised text primitives over Arrow string buffers.

Everything here works on the UTF-8 bytes that Spark hands to Python, without building a Python
string per row: white space is found with a lookup table, words are fingerprinted eight bytes at a
time, and every slice of a sequence gets a polynomial fingerprint modulo 2**61 - 1 from prefix sums,
so a fingerprint of any length costs two lookups. The modulus is prime: for two given sequences of n
items that differ, at most n of the 2**61 bases give one fingerprint. (Modulo 2**64 there are
sequences, such as those of Thue and Morse, that no base tells apart; `Rolling` works that way and
is only used to choose places, never to tell contents apart.)
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

U = np.uint64
#: Bytes of rows that Spark hands to Python at once, so that neither side holds thousands of long texts.
BATCH = "8m"


def frugal(spark: SparkSession) -> None:
    """Keep the batches of this session small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


#: What a worker keeps from task to task: the modules whose tasks use it, and a function that drops it and says whether there was any.
_KEPT: list[tuple[tuple[str, ...], Callable[[], bool]]] = []


def keeps(modules: tuple[str, ...], drop: Callable[[], bool]) -> None:
    """Have what tasks of these modules keep in a worker dropped when a task of another one begins there."""
    _KEPT.append((modules, drop))


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def begin(module: str) -> None:
    """Drop what only tasks of other modules use."""
    if any([drop() for modules, drop in _KEPT if module not in modules]):
        release()


def trimmed(run: Callable) -> Callable:
    """A function over batches that gives memory back to the system: at its begin what other operators kept, at its end what it freed. Workers are kept between tasks."""
    module = run.__module__

    @wraps(run)
    def wrapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(module)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapper


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PRIME = (1 << 61) - 1
_P, _HALF, _LOW29, _PIECE = U(PRIME), U(0xFFFFFFFF), U((1 << 29) - 1), 1 << 14
_ODD, _BASE = 0x9E3779B97F4A7C15 | 1, 0x1D5C3F7A9B24E681
_BYTE = np.arange(1, 257).astype(U)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
#: Words of more bytes are fingerprinted one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> U(61))
    return x - _P * (x >= _P)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, of numbers below it: 2**61 counts as 1. Long arrays go in pieces that stay in the cache."""
    if len(a) > _PIECE:
        out = np.empty(len(a), U)
        for i in range(0, len(a), _PIECE):
            out[i : i + _PIECE] = product(a[i : i + _PIECE], b[i : i + _PIECE])
        return out
    a1, a0, b1, b0 = a >> U(32), a & _HALF, b >> U(32), b & _HALF
    cross, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(((a1 * b1) << U(3)) + (cross >> U(29)) + ((cross & _LOW29) << U(32)) + (low & _P) + (low >> U(61)))


def _grown(base: int, size: int, modulus: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1)."""
    out, n = np.ones(size, U), 1
    while n < size:
        step, take = U(pow(base, n, modulus)), min(n, size - n)
        out[n : n + take] = product(out[:take], np.full(take, step)) if modulus == PRIME else out[:take] * step
        n += take
    return out


_powers: dict[int, list[np.ndarray]] = {PRIME: [np.ones(1, U)] * 2, 2**64: [np.ones(1, U)] * 2}


def powers(n: int, modulus: int = PRIME) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    held = _powers[modulus]
    if len(held[0]) < n:
        base = _BASE if modulus == PRIME else _ODD
        size = max(n, 2 * len(held[0]), 1 << 16)
        held[:] = [_grown(b, size, modulus) for b in (base, pow(base, -1, modulus))]
    return held[0][:n], held[1][:n]


def _without_powers() -> bool:
    any_ = max(len(held[0]) for held in _powers.values()) > 1
    for held in _powers.values():
        held[:] = [np.ones(1, U)] * 2
    return any_


keeps(("promptlens.llm.blocks", "promptlens.llm.substring"), _without_powers)


class Prefix:
    """Fingerprints of all slices of a sequence of 64-bit values, modulo 2**61 - 1."""

    def __init__(self, values: np.ndarray, small: bool = False):
        """small: all values are below 512, so that sums of eight million products of them fit."""
        power, self.inverse = powers(len(values) + 1)
        self.high, self.low = np.zeros(len(values) + 1, U), np.zeros(len(values) + 1, U)
        if small and len(values) < 1 << 23:
            high, low = values * (power[:-1] >> U(32)), values * (power[:-1] & _HALF)
        else:
            terms = product(_reduced(values), power[:-1])
            high, low = terms >> U(32), terms & _HALF
        np.cumsum(high, out=self.high[1:])
        np.cumsum(low, out=self.low[1:])

    def slices(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        high, low = self.high[hi] - self.high[lo], self.low[hi] - self.low[lo]
        whole = _reduced((high >> U(29)) + ((high & _LOW29) << U(32)) + (low & _P) + (low >> U(61)))
        return mix(product(whole, self.inverse[lo]) + mix((hi - lo).astype(U)))

    def windows(self, width: int) -> np.ndarray:
        """Fingerprints of every run of width values."""
        at = np.arange(max(0, len(self.high) - width))
        return self.slices(at, at + width)


class Rolling:
    """Numbers of all runs of a sequence of values, cheaply: equal runs get equal numbers, but not the other way round."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = powers(len(values) + 1, 2**64)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        if len(self.sums) <= width:
            return np.zeros(0, U)
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])


def runs(values: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every run of a few values, one bijection after another."""
    n = max(0, len(values) - width + 1)
    out = np.full(n, mix(np.array([width], U))[0])
    for k in range(width):
        out = mix(out + values[k : k + n])
    return out


def spans(batch: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array at about limit bytes: first row, end row, bytes, offsets from 0.

    A row is never cut; null counts as empty.
    """
    if not pa.types.is_large_string(batch.type):
        batch = batch.cast(pa.large_string())
    if batch.null_count:
        batch = batch.fill_null("")
    n = len(batch)
    if not n:
        return
    _, offsets, data = batch.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, batch.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each row's first word (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = gap[:-1]
    after[:-1] = gap[1:]
    cut = off[1:-1]
    before[cut[cut < n]] = True
    after[cut[cut > 0] - 1] = True
    start, end = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    return start, end, np.searchsorted(start, off)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_values(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A fingerprint for each word: of its length and its bytes, eight at a time, each step a bijection.

    Words of one length of up to eight bytes never share one.
    """
    size = end - start
    lanes = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))
    out = mix(size.astype(U) * U(_ODD))
    out = mix(out ^ (lanes[start] & _MASK[np.minimum(size, 8)]))
    at, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        left = size[at] - k
        out[at] = mix(out[at] ^ (lanes[start[at] + k] & _MASK[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 8
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values, the place of its smallest, the leftmost of equals.

    Only the upper 32 bits are compared, whatever the length, so that equal runs agree everywhere.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    key = (values & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    padded = np.full(-(-n // width) * width, U(2**64 - 1))
    padded[:n] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return (least & U(0xFFFFFFFF)).astype(np.int64)


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Mask over window starts: those whose width items lie in one row; first: each row's first item and the end."""
    total = int(first[-1])
    ok = np.ones(max(0, total - width + 1), bool)
    # the last width-1 starts of each row would reach into the next one
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, np.maximum(first[:-1], first[1:] - width + 1), 1)
    np.add.at(step, first[1:], -1)
    return ok & (np.cumsum(step)[: len(ok)] == 0)


def covered(n: int, start: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n items lie in [start, start + width)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, start + width, -1)
    return np.cumsum(step[:-1]) > 0


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges lo..hi, ends left out."""
    size = hi - lo
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
