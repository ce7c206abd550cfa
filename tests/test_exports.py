import json

from promptlens.plans import queries as q
from promptlens.plans.views import view


def test_nested_json_holds_every_generation(spark, tmp_path):
    spark.createDataFrame([(i, "en", "web", f"text {i}") for i in range(60)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = q.QUERIES["snk4_nested_json"](spark, str(tmp_path)).collect()
    got = [(r["source_file"].split("/")[0], t) for r in rows for subjects in json.loads(r["value"]).values() for texts in subjects.values() for t in texts]
    want = [(r["model_key"], r["generation"]) for r in view(spark, str(tmp_path), "v_generations").collect()]
    assert len(want) == 60 and sorted(got, key=str) == sorted(want, key=str)
