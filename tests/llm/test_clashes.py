"""Columns of the input whose names the operators use themselves, ties and repeated rows."""

import pytest

from promptlens.llm import bpe, forest, html, jaccard, katz, mixing, quality, sharding
from promptlens.llm.queries import vocabulary

NAMES = ("node", "n", "of", "row", "__n", "__node", "at", "id", "g", "copy", "cell", "rate", "d", "p", "slot", "N")


def frame(spark, rows, extra=NAMES):
    lower, use = {"doc_id", "text", "source"}, []
    for n in extra:
        if n.lower() not in lower:
            lower.add(n.lower())
            use.append(n)
    return spark.createDataFrame([(*r, *range(len(use))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in use))


ROWS = [(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, "", None), (None, None, None)]


def test_keep_one(spark):
    df = frame(spark, ROWS)
    out = jaccard.keep_one(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, ""), (1, "a b c d e f"), (3, "")]


def test_others_keep_columns_and_rows(spark):
    df = frame(spark, ROWS)
    for out in (mixing.repeated(mixing.systematic_mix(df)), quality.judge(df.drop("n")), bpe.encode(df, vocabulary()), html.extract_text(df, "text", "out")):
        assert set(df.columns) - {"text", "n"} <= set(out.columns)
    assert quality.judge(df).count() == bpe.encode(df, vocabulary()).count() == sharding.assign_shards(df, "slot", ["a", "b"], 7).count() == len(ROWS)
    assert mixing.systematic_mix(df).count() == jaccard.jaccard_components(df).count() == katz.katz_scores(df).count() == len(ROWS)


def test_mixing_ties_are_settled_by_the_rows(spark):
    """Rows of one id and size that differ in their text: reruns take the same ones."""
    rows = [(7, f"w{i} x", "a") for i in range(40)] + [(i, "q " * 30, "b") for i in range(3)]
    took = lambda df: sorted((r.text, r.copies) for r in mixing.systematic_mix(df).collect())
    assert took(frame(spark, rows)) == took(frame(spark, rows[::-1]).repartition(5))


def test_mixing_keeps_a_column_named_copy(spark):
    out = mixing.repeated(mixing.systematic_mix(frame(spark, ROWS, ("copy",))))
    assert "copy" in out.columns


@pytest.mark.parametrize("name", ["node", "g", "vector", "raw"])
def test_forest(spark, name):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5), (2, [1.0, 0.0], 1, 5)], f"vec_id long, embedding array<double>, label int, `{name}` int")
    assert sorted(tuple(r) for r in forest.near_duplicates(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]
