from promptlens.plans import queries as q
from promptlens.plans.views import view


def test_texts_are_whole(spark, tmp_path):
    # ids whose text the views leave as it is
    texts = {55: "start " + "word " * 400 + "漢字 ends (here", 56: "x" * 5000 + " she said? End."}
    spark.createDataFrame([(i, "en", "web", t) for i, t in texts.items()], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    read = lambda name, c: {r["ord"]: r[c] for r in view(spark, str(tmp_path), name).select("ord", c).collect()}
    assert read("v_prompts", "prompt") == texts
    assert read("v_generations", "generation")[55] == texts[55] and read("v_repeated", "generation")[55] == texts[55]
    rows = lambda name: {r["ord"]: r for r in q.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {k: r["n_char"] for k, r in rows("tx1_tx2_lengths").items()} == {k: len(t) for k, t in texts.items()}
    assert rows("qa1_qa13_quality_flags")[55]["parentesi_round_sbilanciate"]
    assert rows("ga7_han_share")[55]["audit_n_han_letters"] == 2
