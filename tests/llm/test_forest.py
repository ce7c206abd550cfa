import numpy as np
import pytest

from promptlens.llm.forest import near_duplicates


def vectors(seed, n=400, d=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    rows = [(int(i), [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(base)]
    k = n
    for i in range(0, 60):
        for _ in range(i % 5):
            v = base[i] + rng.standard_normal(d) * 0.12 * rng.random()
            rows.append((k, [float(np.float32(x)) for x in v], i % 3))
            k += 1
    rows += [(k + j, rows[5][1], rows[5][2]) for j in range(30)]
    k += 30
    odd = [None, [], [0.0] * d, [-0.0] * d, [1.0] * (d - 1) + [None], [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, rows[5][1][:-1], [2 * x for x in rows[5][1]]]
    rows += [(k + j, v, rows[5][2]) for j, v in enumerate(odd)]
    k += len(odd)
    return [*rows, (k, rows[5][1], None), (None, rows[7][1], rows[7][2]), (3, rows[9][1], rows[9][2])]


def brute(rows, least):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    lead = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            lead[find(i)] = min(lead.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], lead.get(find(i)), r[0] == lead.get(find(i)) or (r[0] is None and find(i) not in lead)) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("seed,leaf", [(1, 2048), (2, 60)])
def test_matches_brute_force(spark, seed, leaf):
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(4)
    got = sorted((tuple(r) for r in near_duplicates(df, least=0.93, leaf=leaf).collect()), key=repr)
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows], 0.93)
    if leaf > 1000:
        assert got == want
    else:  # recall over links
        assert len(got) == len(want) and sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
        assert all(g[1] <= w[1] for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1])), strict=True))


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
