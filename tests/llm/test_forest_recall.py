"""Recall at production parameters, over brute force: many vectors of one label, dense clusters, the tables' own."""

import numpy as np
import pytest

from promptlens.llm.forest import LEAF, grow, near_duplicates


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(rng, n, d=64):
    """Vectors of one label with planted neighbours at all cosines from 0.9 on."""
    base = unit(rng.standard_normal((n, d)))
    near = base[: n // 4] + rng.standard_normal((n // 4, d)) * rng.uniform(0.005, 0.06, (n // 4, 1))
    return np.concatenate([base, unit(near)])


def cone(rng, n, d=64):
    """A dense cluster: all pairs near cosine 0.95, many of them below 0.93."""
    centre = unit(rng.standard_normal((1, d)))
    return unit(centre + rng.standard_normal((n, d)) * np.sqrt((1 / 0.945 - 1) / d))


def counts(x, least=0.93, step=2000):
    x = x.astype(np.float32).astype(np.float64)
    x = unit(x)
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), step):
        out[lo : lo + step] = (x[lo : lo + step] @ x.T >= least).sum(axis=1) - 1
    return out


@pytest.mark.parametrize("kind", ["spread", "dense beside spread"])
def test_recall(spark, kind):
    rng = np.random.default_rng(11)
    x = spread(rng, 20_000) if kind == "spread" else np.concatenate([cone(rng, 1_500), spread(rng, 4_000)])
    x = x.astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(8)
    got = {r.vec_id: r.n_links for r in near_duplicates(rows, least=0.93).collect()}
    want = counts(x)
    have = np.array([got[i] for i in range(len(x))])
    assert (have <= want).all()
    assert want.sum() > 5_000 and have.sum() >= 0.99 * want.sum(), have.sum() / want.sum()


def test_leaves_are_small_unless_dense(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([spread(rng, 4_000), cone(rng, 600)])
    nodes = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "node long, label string, vector array<double>")
    leaves = grow(nodes, 0.93, LEAF, 2, 1024).toPandas()
    size = leaves.groupby("g").size()
    big = leaves[leaves.g.isin(size[size > LEAF].index)]
    assert set(leaves.node) == set(range(len(x)))
    # no leaf above twice the size without a good part of the cone
    share = (big.node >= 5_000).groupby(big.g).mean()
    assert len(size) > 100 and all(share[g] > 0.3 for g in size[size > 2 * LEAF].index), share
