import random

import pytest

from promptlens.llm.substring import doubling_dedup, rlz_dedup


def corpus(seed, kind):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本", " x"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [line(rng.randint(6, 40)) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = [line(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), line(rng.randint(0, 9))]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(40, docs[3][1]), (41, docs[3][1] + " tail"), (42, ""), (43, None), (44, "a " * 90), (45, "b" * 300), (46, "b" * 150), (47, "a " * 30)]
    docs += [(None, docs[5][1]), (7, docs[9][1]), (48, "Is " * 50 + "the. " * 50)]
    edited = docs[8][1].split(" ")
    for i in range(49, 60):
        e = list(edited)
        e[rng.randrange(len(e))] = "zz"
        docs.append((i, " ".join(e)))
    return docs


def brute_words(docs, w):
    first = {}
    key = lambda d: (d is None, d or 0)
    for d, t in docs:
        x = (t or "").encode().split()
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, d), d, key=key)
    out = []
    for d, t in docs:
        x = (t or "").encode().split()
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            m = first[tuple(x[i : i + w])]
            if m is not None and (d is None or m < d):
                gone[i : i + w] = [True] * w
        out.append((d, len(x), sum(gone), b" ".join(a for a, g in zip(x, gone) if not g)))
    return out


def brute_bytes(docs, w):
    seen = {}
    for _, t in docs:
        x = (t or "").encode()
        for i in range(len(x) - w + 1):
            seen[x[i : i + w]] = seen.get(x[i : i + w], 0) + 1
    out = []
    for d, t in docs:
        x = (t or "").encode()
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if seen[x[i : i + w]] > 1:
                gone[i : i + w] = [True] * w
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(x), sum(gone), runs, bytes(a for a, g in zip(x, gone) if not g)))
    return out


KEY = lambda r: tuple(repr(x) for x in r)


@pytest.mark.parametrize("seed,w,g", [(1, 8, 3), (2, 12, 4), (3, 5, 5)])
def test_words_match_brute_force(spark, seed, w, g):
    docs = corpus(seed, "w")
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, id string, anchor int")
    got = [(r.doc_id, r.n_items, r.n_removed, bytes(r.kept)) for r in rlz_dedup(df, window=w, gram=g).collect()]
    assert sorted(got, key=KEY) == sorted(brute_words(docs, w), key=KEY)


@pytest.mark.parametrize("seed,w,g", [(1, 60, 12), (2, 100, 20), (3, 40, 8)])
def test_bytes_match_brute_force(spark, seed, w, g):
    docs = corpus(seed, "b")
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, id string, mark int")
    got = [(r.doc_id, r.n_items, r.n_removed, r.n_spans, bytes(r.kept)) for r in doubling_dedup(df, window=w, gram=g).collect()]
    assert sorted(got, key=KEY) == sorted(brute_bytes(docs, w), key=KEY)


def test_factors_and_spans(spark):
    text = " ".join(f"a{i}" for i in range(100))
    df = spark.createDataFrame([(1, text), (2, "x y " + text + " z")], "doc_id long, text string")
    r = {x.doc_id: x for x in rlz_dedup(df).collect()}
    assert r[1].n_removed == 0 and r[2].spans == [2, 102] and bytes(r[2].kept) == b"x y z"
    assert all(f.source == 1 and f.begin >= 2 and f.end <= 102 for f in r[2].factors)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rlz_dedup(df).count() == 0 and doubling_dedup(df).count() == 0
