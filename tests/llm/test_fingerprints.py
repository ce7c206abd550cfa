"""Sequences that polynomials modulo 2**64 cannot tell apart, whatever their base: Thue-Morse words and their complements."""

import numpy as np
import pytest

from promptlens.llm import quality
from promptlens.llm.arrowtext import PRIME, Prefix, byte_values, product, runs, word_values
from promptlens.llm.jaccard import jaccard_components
from promptlens.llm.katz import katz_scores
from promptlens.llm.substring import doubling_dedup, rlz_dedup
from tests.llm.test_substring import KEY, brute_bytes, brute_words


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def pair(n):
    return thue_morse(n), thue_morse(n, "b", "a")


def test_product():
    a = np.array([PRIME - 1, 1, 0, 12345678901234567, PRIME - 1], np.uint64)
    b = np.array([PRIME - 1, PRIME - 1, 7, 998877665544332211, 1], np.uint64)
    assert [int(x) for x in product(a, b)] == [int(x) * int(y) % PRIME for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 1024, 2048, 4096])
def test_words_and_slices(n):
    u, v = pair(n)
    data = np.frombuffer((u + v + u).encode(), np.uint8)
    lo, hi = np.arange(3) * n, np.arange(1, 4) * n
    for x in (word_values(data, lo, hi), Prefix(byte_values(data)).slices(lo, hi)):
        assert x[0] == x[2] != x[1]


def test_runs():
    v = np.array([1, 2, 3, 1, 2, 3, 3, 2, 1], np.uint64)
    x = runs(v, 3)
    assert x[0] == x[3] and len(set(x.tolist())) == 6 and len(runs(v[:2], 3)) == 0


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_operators_keep_them_apart(spark, n):
    u, v = pair(n)
    docs = [(1, " ".join([u] * 60)), (2, " ".join([v] * 60)), (3, u + " x y z"), (4, v + " x y z"), (5, f"{u}\n{v}\nfew words more that are long enough here"), (6, " ".join([u] * 60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(r.doc_id, r.n_items, r.n_removed, bytes(r.kept)) for r in rlz_dedup(df).collect()]
    assert sorted(got, key=KEY) == sorted(brute_words(docs, 50), key=KEY) and {r[0] for r in got if r[2]} == {6}
    got = [(r.doc_id, r.n_items, r.n_removed, r.n_spans, bytes(r.kept)) for r in doubling_dedup(df).collect()]
    assert sorted(got, key=KEY) == sorted(brute_bytes(docs, 200), key=KEY)
    got = {r.doc_id: r.component_id for r in jaccard_components(df, width=4, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}
    assert all(r.n_dup_lines == 0 for r in quality.judge(df).collect())
    known = {r.doc_id: r.n_known for r in katz_scores(spark.createDataFrame([(1, u), (2, u), (9, v), (10, v)], "doc_id long, text string")).collect()}
    trained = {d for d in (1, 2, 9, 10) if __import__("promptlens.llm.katz", fromlist=["x"]).in_training(d)}
    seen = {t for d, t in ((1, u), (2, u), (9, v), (10, v)) if d in trained}
    assert known == {d: (t in seen) + bool(trained) for d, t in ((1, u), (2, u), (9, v), (10, v))}
