"""That the factors and the ranks decide, and that hot anchors are counted on their own without changing a result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlens.llm import substring
from promptlens.llm.substring import doubling_dedup, factors, hot_anchors, levels, rlz_dedup, rounds
from tests.llm.test_substring import KEY, brute_bytes, brute_words, corpus


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def removed_by_factors(r):
    gone = set()
    for f in r.factors:
        gone |= set(range(f.begin, f.end))
    return gone


def test_removed_words_are_those_of_factors(spark):
    docs = corpus(4, "w")
    texts = {d: (t or "").encode().split() for d, t in docs if d is not None and d != 7}
    seen = 0
    for r in rlz_dedup(frame(spark, docs), window=8, gram=3).collect():
        assert len(removed_by_factors(r)) == r.n_removed and all(f.end - f.begin >= 8 for f in r.factors)
        assert sorted(f.begin for f in r.factors) == [f.begin for f in r.factors]
        if r.doc_id in texts:
            for f in r.factors:
                seen += 1
                assert f.source < r.doc_id
                if f.source != 7:  # each window of a factor stands in its source
                    whole, own = texts[f.source], texts[r.doc_id]
                    grams = {tuple(whole[i : i + 8]) for i in range(len(whole) - 7)}
                    assert all(tuple(own[i : i + 8]) in grams for i in range(f.begin, f.end - 7))
    assert seen > 20


def test_factors_run_on_over_one_source():
    begin, end, source, row = (np.array(x) for x in ([0, 4, 9, 20, 21], [3, 8, 12, 20, 25], [1, 1, 2, 2, 2], [0, 0, 0, 0, 1]))
    got = [x.tolist() for x in factors(begin, end, source, row, 5)]
    assert got == [[0, 9, 20, 21], [13, 17, 25, 30], [1, 2, 2, 2], [0, 0, 0, 1]]


def brute_ranks(docs, place, far, gram):
    """Prefix doubling over given positions: how many share the first gram bytes and those of the first j stretches."""
    out = []
    for j, to in enumerate(far):
        keys = [t[p : p + gram + to] if p + gram + to <= len(t) else None for t, p in zip(docs, place, strict=True)]
        out.append([None if k is None else keys.count(k) for k in keys])
    return out


def test_ranks_of_each_round(spark):
    """Positions and stretches by hand: ranks split where the texts do, unique ones go no further."""
    far, gram = levels(40, 8), 8
    texts = ["a" * 8 + tail for tail in ("b" * 32, "b" * 32, "b" * 31 + "c", "b" * 9 + "d" * 23, "b" * 3 + "e" * 29, "b" * 16 + "f" * 16, "b" * 16 + "f" * 16)]
    spans = [(a, b) for a, b in zip([0, *far], far)]
    name = lambda t: [hash(t[gram + a : gram + b]) % 2**40 for a, b in spans]
    rows = [(i, i, 1, 1, 77, name(t)) for i, t in enumerate(texts)]
    positions = spark.createDataFrame(rows, "id long, mark long, n long, side int, rank long, names array<long>")
    want = brute_ranks([t.encode() for t in texts], [0] * len(texts), far, gram)
    alive = set(range(len(texts)))
    for ranked, counts in zip(rounds(positions, far), want, strict=True):
        got = {r.id: r for r in ranked.collect()}
        assert set(got) == alive
        for i in got:
            assert got[i]["all"] == counts[i]
            assert all((got[i]["rank"] == got[k]["rank"]) == (texts[i][: gram + far[want.index(counts)]] == texts[k][: gram + far[want.index(counts)]]) for k in got)
        alive = {i for i in alive if counts[i] > 1}
    assert alive == {0, 1, 5, 6}


@pytest.mark.parametrize("share", [0.0, 0.02])
def test_hot_anchors_change_no_result(spark, monkeypatch, share):
    monkeypatch.setattr(substring, "HOT", share * 8)
    docs = corpus(5, "w") + [(200 + i, " ".join(f"q{k}" for k in range(14)) + f" tail{i % 9} more words") for i in range(40)]
    df = frame(spark, docs)
    ids = df.select(F.col("doc_id").alias("id"), "text")
    assert hot_anchors(ids, "word", 8, 3, 1, 1) is not None
    got = [(r.doc_id, r.n_items, r.n_removed, bytes(r.kept)) for r in rlz_dedup(df, window=8, gram=3, sampled=1, least=1).collect()]
    assert sorted(got, key=KEY) == sorted(brute_words(docs, 8), key=KEY)
    got = [(r.doc_id, r.n_items, r.n_removed, r.n_spans, bytes(r.kept)) for r in doubling_dedup(df, window=40, gram=8, sampled=1, least=1).collect()]
    assert sorted(got, key=KEY) == sorted(brute_bytes(docs, 40), key=KEY)


def test_emptied_factors_remove_nothing(spark, monkeypatch):
    """The decision is the factors': in process, without workers that hold the module's own."""
    import pyarrow as pa

    none = np.zeros(0, np.int64)
    text = " ".join(f"a{i}" for i in range(60))
    batch = pa.RecordBatch.from_pydict({"id": [2], "text": [text], "marks": pa.array([None], pa.list_(pa.int64())), "mark_sources": pa.array([None], pa.list_(pa.int64())), "windows": pa.array([None], pa.list_(pa.int64())), "window_sources": pa.array([None], pa.list_(pa.int64()))})
    chunk = next(substring.spans(batch.column("text")))
    c = substring.Chunk("word", chunk[2], chunk[3])
    b = substring.Blocks(c.values, c.prefix, c.first, 50, 16)
    batch = batch.set_column(2, "marks", pa.array([substring.signed(b.mark)], pa.list_(pa.int64()))).set_column(3, "mark_sources", pa.array([[1] * len(b)], pa.list_(pa.int64())))
    run = substring._final("word", 50, 16)
    assert [x.column("n_removed")[0].as_py() for x in run(iter([batch]))] == [60]
    monkeypatch.setattr(substring, "factors", lambda *_: (none, none, none.astype(np.uint64), none))
    assert [x.column("n_removed")[0].as_py() for x in run(iter([batch]))] == [0]


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, "a b", 1, "x"), (1, "a b", 1, "x"), (2, None, None, None)], "`the.id` long, `the.text` string, id int, hot string")
    assert sorted(r["n_items"] for r in rlz_dedup(df, "the.id", "the.text").collect()) == [0, 2, 2]
    assert sorted(r["n_items"] for r in doubling_dedup(df, "the.id", "the.text").collect()) == [0, 3, 3]
