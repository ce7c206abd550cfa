"""Quality rules under weak supervision.

Rules look at counts of the whole text and vote good, bad, or abstain. Expectation-maximisation over
all documents' votes estimates how often each rule is right on good and on bad documents; a document
is kept when the posterior probability of good, given its votes, reaches a half. To abstain says
nothing. Votes are counted by pattern first, so that the model is fitted on one row for each of at
most 3 ** rules patterns.

Edge cases: a null or empty text has no words, all counts are 0 and it fails the base rule; a line
without a word is no line; with an empty table the model keeps its prior. Texts, words and lines of
any length are counted whole; rows that repeat are judged, and counted by the model, one by one. Other
columns stay, but for those named like the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.llm.arrowtext import SPACE, U, covered, frugal, mix, runs, spans, trimmed, word_values, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False
_SPOT = U(0x9E3779B97F4A7C15)
GRAM = 5


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[first])


def _counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """COUNTS for each row of a chunk."""
    rows = len(off) - 1
    start, end, first = words(data, off)
    solid = ~SPACE[data]
    heads = _HEAD[data] & solid
    # repeated windows of words
    key = runs(word_values(data, start, end), GRAM)
    row = np.repeat(np.arange(rows), np.diff(first))
    ok = np.flatnonzero(row[: len(key)] == row[GRAM - 1 :][: len(key)]) if len(key) else np.zeros(0, np.int64)
    name = mix(key[ok] + row[ok].astype(U) * _SPOT)
    _, inverse, n = np.unique(name, return_inverse=True, return_counts=True)
    again = covered(len(start), ok[n[inverse] > 1], GRAM)
    # lines that hold a word
    cut = np.union1d(np.flatnonzero(data == 10) + 1, off[:-1][np.diff(off) > 0])
    stop = np.append(cut[1:], len(data))
    wordy = np.searchsorted(start, stop) > np.searchsorted(start, cut)
    cut, stop = cut[wordy], stop[wordy]
    if len(cut):
        stop = stop - (data[stop - 1] == 10)
    line_row = np.searchsorted(off, cut, "right") - 1
    n_lines = np.bincount(line_row, minlength=rows)
    # the lines themselves are compared
    raw, ends = data.tobytes(), np.cumsum(n_lines)
    lines = [raw[i:j] for i, j in zip(cut.tolist(), stop.tolist(), strict=True)]
    distinct = np.array([len(set(lines[j - n : j])) for n, j in zip(n_lines.tolist(), ends.tolist(), strict=True)], np.int64)
    return [np.diff(first), _per_row(heads, off), _per_row(_SYMBOL[data], off), n_lines - distinct, _per_row(again, first), n_lines, _per_row(_LETTER[data] & heads, off)]


def text_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns but those named like a count, and the counts (long)."""
    frugal(df.sparkSession)
    source = df.drop(*COUNTS)
    at, names = source.columns.index(text_col), [*source.columns, *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in spans(batch.column(at)):
                kept = [c.slice(lo, hi - lo) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x.astype(np.int64)) for x in _counts(data, off))], names)

    schema = T.StructType([*source.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return source.mapInArrow(trimmed(run), schema)


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. Lengths never speak for a text, only against it."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    mean = c("word_chars") / n
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    never = F.lit(False)
    return {
        "length": vote(never, c("n_words") < 5),
        "word_length": vote(never, (mean < 1.5) | (mean > 20)),
        "symbols": vote(c("n_symbols") == 0, c("n_symbols") * 100 > c("n_words") * 10),
        "lines": vote(c("n_dup_lines") == 0, c("n_dup_lines") * 10 > lines * 3),
        "repeats": vote(c("n_repeat_words") == 0, c("n_repeat_words") * 100 > n * 20),
        "letters": vote(c("n_letters") * 100 >= c("word_chars") * 93, c("n_letters") * 100 < c("word_chars") * 80),
    }


@dataclass
class LabelModel:
    """Two-class model of rules that err independently: prior of good; chance of a bad and a good vote by class."""

    prior: float
    chance: np.ndarray  # class (bad, good) x rule x vote (bad, good) among those cast

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.chance)
        score = [(votes < 0) @ log[k, :, 0] + (votes > 0) @ log[k, :, 1] for k in (0, 1)]
        odds = score[0] - score[1] + np.log(1 - self.prior) - np.log(self.prior)
        return 1 / (1 + np.exp(np.clip(odds, -700, 700)))


def fit(votes: np.ndarray, counts: np.ndarray, strength: float = 1000.0, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and how often each occurs.

    It starts from, and is held to by as many imaginary documents as `strength` says, whatever the size
    of the corpus: 85 per cent good ones, rules that call them good 96 times in 100, and say either of
    bad ones. The more documents there are, the less they count.
    """
    k = votes.shape[1]
    start, share = np.tile(np.array([[[0.5, 0.5]], [[0.04, 0.96]]]), (1, k, 1)), 0.85
    model, total = LabelModel(share, start), counts.sum()
    weight = strength
    cast = np.stack([votes < 0, votes > 0], 2).astype(float)
    for _ in range(rounds if total else 0):
        good = model.posterior(votes)
        by_class = np.stack([(1 - good) * counts, good * counts])
        chance = np.einsum("cp,prv->crv", by_class, cast) + weight * start
        chance /= chance.sum(axis=2, keepdims=True)
        prior = float((by_class[1].sum() + weight * share) / (total + weight))
        moved = abs(prior - model.prior) + np.abs(chance - model.chance).max()
        model = LabelModel(prior, chance)
        if moved < 1e-10:
            break
    return model


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(df: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All columns, COUNTS, votes (array), base_failed, p_good (posterior) and kept.

    The patterns of votes, at most 3 ** 6, go to the driver, are weighed there and come back.
    """
    named = rules()
    counted = text_counts(df.drop("votes", "base_failed", "p_good", "kept"), text_col)
    voted = counted.withColumn("votes", F.array(*(v.cast("int") for v in named.values())))
    patterns = voted.groupBy("votes").count().collect()
    votes = np.array([r["votes"] for r in patterns], int).reshape(-1, len(named))
    model = fit(votes, np.array([r["count"] for r in patterns], float))
    posterior = model.posterior(votes) if len(votes) else []
    keys = [(list(map(int, v)), float(p)) for v, p in zip(votes, posterior, strict=True)]
    table = df.sparkSession.createDataFrame(keys, "votes array<int>, p_good double")
    out = voted.join(F.broadcast(table), "votes", "left").select(*counted.columns, "votes", "p_good")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
