"""What op6 shuffles follows the text, not rows times partitions."""

import random

from promptlens.llm.katz import katz_scores


def shuffled(spark, df, partitions):
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = written()
    rows = katz_scores(df, least=1, partitions=partitions).collect()
    return written() - before, {r.doc_id: (r.n_known, round(r.base_score, 7), round(r.score, 7)) for r in rows}


def test_shuffle_by_partitions(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{int(2000 * rng.random() ** 3)}" for _ in range(40))) for i in range(10_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    few, same = shuffled(spark, df, 4)
    many, rows = shuffled(spark, df, 128)
    assert rows.keys() == same.keys() and all(abs(x - y) < 1e-6 for k in rows for x, y in zip(rows[k], same[k], strict=True))
    assert many < 1.5 * few, (few, many)
