import random

import pytest

from promptlens.llm import jaccard
from promptlens.llm.graph import components
from promptlens.llm.jaccard import jaccard_components


def shingles(t, k):
    w = [x.decode() for x in (t or "").encode().split()]
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in w]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, k, p):
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= p * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=repr)


@pytest.mark.parametrize("seed,k,p,common,block", [(1, 4, 85, 32, 512), (2, 2, 70, 1, 3), (3, 5, 80, 2, 7), (4, 4, 85, 0, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, k, p, common, block):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "é", "A", "a"]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    common = line(30)
    docs = []
    for c in range(6):
        base = line(rng.choice([3, 12, 40, 150]))
        for _ in range(25):
            e = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                e[rng.randrange(len(e))] = rng.choice(vocab)
            docs.append(e)
    for _ in range(60):
        docs.append(line(rng.randint(1, 60)) + (common if rng.random() < 0.5 else []))
    docs = [(i, rng.choice([" ", "\n"]).join(x)) for i, x in enumerate(docs)]
    docs += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "two w"), (None, docs[0][1]), (None, "lonely text stands here by itself"), (3, docs[60][1]), (506, docs[30][1].upper())]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, node int, id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, width=k, percent=p).collect()), key=repr)
    assert got == brute(docs, k, p)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 180)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(300, 300), (None, 4)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[x] == min(seen)
    assert set(got) == set(near)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
