import pytest

from promptlens.llm.katz import katz_scores
from promptlens.llm.queries import QUERIES
from tests.llm.test_katz import Brute, corpus


def held_to(rows, docs):
    brute = Brute(docs, least=1)
    got = sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[2]))
    want = sorted((brute.row(*d) for d in docs), key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-7) and g[6] == pytest.approx(w[6], abs=1e-7)


def test_query_uses_bigrams_seen_once(spark, tmp_path):
    docs = corpus(400, 400)
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held_to(QUERIES["op6_lm_scoring"](spark, str(tmp_path)).collect(), docs)


def test_hot_contexts_with_bigrams_seen_once(spark):
    docs = corpus(400, 5)
    held_to(katz_scores(spark.createDataFrame(docs, "doc_id long, text string"), least=1, partitions=4, hot_share=0.003).collect(), docs)
