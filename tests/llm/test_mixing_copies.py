import random
from collections import Counter

import corpus_pipeline as cp
import pytest

from promptlens.llm import mixing


def documents(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice("abbbc")) for i in range(1500)]
    return spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("share", [1.5, 0.6])
def test_each_row_occurs_as_often_as_it_has_copies(spark, share):
    mixed = mixing.systematic_mix(documents(spark), share=share)
    want = {r.doc_id: r.copies for r in mixed.collect()}
    if share < 1:
        rates = {r.source: r.target / r.source_size for r in mixed.select("source", "target", "source_size").distinct().collect()}
        assert min(rates.values()) < 0.3 and 0 in want.values()
    got = Counter(r.doc_id for r in mixing.repeated(mixed).select("doc_id").collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_stage_leaves_out_what_is_not_taken(spark):
    rows = [(i, "w " * 10, "en", s, 20) for i, s in enumerate("a" * 200 + "b" * 180 + "c" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter({r.doc_id: r.copies for r in mixing.systematic_mix(docs).collect() if r.copies})
    assert len(want) < len(rows)
    assert Counter(r.doc_id for r in cp.mix_sources(spark, docs, "").collect()) == want
