"""Sizes that Spark estimates do not multiply from round to round."""

import numpy as np

from promptlens.llm.forest import grow
from promptlens.llm.graph import components


def bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(5).permutation(400).tolist()
    edges = spark.createDataFrame(list(zip(order[1:], order[:-1], strict=True)), "a long, b long")
    out = components(edges)
    assert bits(out) < 2_000
    assert sorted(map(tuple, out.collect())) == [(i, 0) for i in range(400)]


def test_trees_of_many_rounds(spark):
    x = np.random.default_rng(6).standard_normal((1_200, 8))
    nodes = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "node long, label string, vector array<double>")
    out = grow(nodes, 0.93, 8, 1, 64)
    assert bits(out) < 2_000
    assert {r.node for r in out.select("node").distinct().collect()} == set(range(1_200))
