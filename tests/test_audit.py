import pytest
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.operators import audit, prepare
from promptlens.sources import parquet_audit

SCHEMA = "prompt_id string, model_key string, repetition int, domain string, category string, subject string, prompt string, generation string, status string, generated_tokens double, finish_reason string"


def rows(cases):
    return [(i, "model_a", 1, "gender", "female", "Example", p, g, s, float(n), f) for i, p, g, s, n, f in cases]


BASE = rows([
    ("a", "Example", "English only.", "ok", 3, "max_new_tokens"),
    ("b", "Example", "Hello 你好, world 世界!", "ok", 8, "max_new_tokens"),
    ("c", "Example", "日本語かな", "ok", 5, "max_new_tokens"),
    ("d", "Example", "\U00020000", "ok", 1, "max_new_tokens"),
    ("e", "", None, "skipped_empty_prompt", 0, "not_generated_empty_prompt"),
    ("f", "Example", "  ", "ok", 1, "eos_token"),
    ("g", "Example", "word word word word", "ok", 4, "eos_token"),
])


@pytest.fixture(scope="module")
def flagged(spark):
    df = audit.add_flags(spark.createDataFrame(BASE, SCHEMA))
    return {r.prompt_id: r for r in df.collect()}, df


def test_scripts_and_texts(flagged):
    r, _ = flagged
    assert [k for k in r if r[k].audit_has_han] == ["b", "c", "d"] or {k for k in r if r[k].audit_has_han} == {"b", "c", "d"}
    assert (r["b"].audit_n_han, r["d"].audit_n_han) == (4, 1)
    assert {k for k in r if r[k].audit_has_kana} == {"c"} and {k for k in r if r[k].audit_han_and_latin} == {"b"}
    assert r["e"].audit_han_share_letters is None and r["e"].audit_n_chars is None
    assert r["f"].audit_empty_generation and not r["e"].audit_empty_generation
    assert {k for k in r if r[k].audit_repeated_word} == {"g"}
    assert all(x.audit_roundtrip_mismatch is None and not x.audit_duplicate_key for x in r.values())


def test_han_passages(flagged):
    _, df = flagged
    got = sorted(audit.han_passages(df).collect(), key=lambda x: (x.prompt_id, x.segment_index))
    assert len(got) == 4 and (got[0].han_segment, got[0].start_char, got[0].end_char) == ("你好", 7, 8)
    assert (got[1].start_char, got[1].context) == (17, "Hello 你好, world 世界!")
    near = audit.han_passages(df, 2).where("prompt_id = 'b' and segment_index = 2").first()
    assert near.context == "d 世界!"
    assert audit.han_passages(df.where("not audit_has_han")).count() == 0


def test_summary_and_grid(flagged, spark):
    _, df = flagged
    s = audit.summarize(df).first()
    assert (s.n_nonempty_ok, s.n_han_ok, s.pct_han_nonempty_ok, s.n_empty_generation) == (5, 3, 60.0, 1)
    assert audit.paired_grid(df, ["model_a", "other"]).where("n_records = 0").count() == 7
    twice = audit.add_flags(spark.createDataFrame([*BASE, BASE[0]], SCHEMA))
    assert twice.where("audit_duplicate_key").count() == 2
    none = audit.summarize(df.where("prompt_id = 'e'")).first()
    assert none.pct_han_nonempty_ok is None and none.mean_chars_ok is None


def test_optional_columns(spark):
    df = spark.createDataFrame([(*BASE[0], False, None, False), (*BASE[1], True, True, None)], SCHEMA + ", generation_hit_token_limit boolean, sentence_complete boolean, tokenizer_roundtrip_matches boolean")
    r = {x.prompt_id: x for x in audit.add_flags(df).collect()}
    assert not r["a"].audit_at_token_limit and r["b"].audit_at_token_limit
    assert r["a"].audit_sentence_incomplete and not r["b"].audit_sentence_incomplete
    assert r["a"].audit_roundtrip_mismatch and not r["b"].audit_roundtrip_mismatch


def test_question_marks_and_status(spark):
    cases = ["What? ", "a?b?", "no", "？", None, "", " "]
    df = audit.add_flags(spark.createDataFrame(rows([(str(i), "P", g, "ok", 1, "eos_token") for i, g in enumerate(cases)]), SCHEMA)).orderBy("prompt_id").collect()
    assert [r.audit_n_question_marks for r in df] == [1, 2, 0, 0, None, 0, 0]
    odd = audit.add_flags(spark.createDataFrame(rows([("x", "P", "text", "skipped_empty_prompt", 1, "e"), ("y", "", "text", "ok", 1, "e"), ("z", None, "t", None, 1, "e")]), SCHEMA)).orderBy("prompt_id").collect()
    assert [r.audit_status_inconsistent for r in odd] == [True, True, False]
    assert [r.audit_unexpected_status for r in odd] == [False, False, True] and odd[2].audit_missing_prompt


def test_schema_checks(spark):
    df = spark.createDataFrame(BASE, SCHEMA)
    for bad in (df.drop("status"), df.withColumn("prompt", F.lit(1)), df.limit(0), df.withColumn("repetition", F.lit(0)), df.withColumn("model_key", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            audit.check_schema(bad)
    with pytest.raises(ValueError):
        audit.add_flags(audit.add_flags(df))


def test_nul(spark, tmp_path):
    cases = ["normal", "", None, "a\x00b漢?\x00", "\x00"]
    raw = spark.createDataFrame(rows([(str(i), "P", g, "ok", 1, "eos_token") for i, g in enumerate(cases)]), SCHEMA).withColumn("ids", F.array(F.lit(1)))
    raw.write.parquet(f"{tmp_path}/g")
    data, report = parquet_audit.read_audit(spark, f"{tmp_path}/g")
    got = data.orderBy("prompt_id").collect()
    assert "ids" not in data.columns and [r.audit_n_nul for r in got] == [0, 0, 0, 2, 1]
    assert got[3].generation == "a�b漢?�" and got[3].audit_nul_columns == "generation" and got[0].audit_nul_columns is None
    rep = sorted(report.collect(), key=lambda r: r.prompt_id)
    assert len(rep) == 2 and rep[0].hex == "610062e6bca23f00" and rep[0].column == "generation"
    done = prepare.prepare_texts(audit.add_flags(data)).orderBy("prompt_id").collect()
    assert [r.text_preparation_status for r in done[3:]] == ["nul_in_metric_text"] * 2 and done[3].text_full is None


REPLICAS = ["  Hello WORLD. ", "hello\nworld.", "Different.", "你好\tWORLD!", " 你好 world! "]


def diversity(spark, texts, status="ok", repeat=False):
    data = [("p", "m", i + 1, "d", "c", "s", "P", t, status, 1.0, "e") for i, t in enumerate(texts)]
    df = audit.add_flags(spark.createDataFrame(data + data[:1] * repeat, SCHEMA))
    return audit.replica_diversity(df).first(), audit.equal_replicas(df).count()


def test_diversity(spark):
    r, n = diversity(spark, REPLICAS)
    assert (r.n_valid, r.n_unique_normalized, r.n_redundant_normalized, r.max_same_normalized, r.n_pairs, r.n_equal_pairs_normalized, r.all_identical_normalized, n) == (5, 3, 2, 2, 10, 2, False, 4)
    r, n = diversity(spark, ["Same"] * 5)
    assert (r.n_unique_normalized, r.n_redundant_normalized, r.n_pairs, r.n_equal_pairs_normalized, r.all_identical_normalized, n) == (1, 4, 10, 10, True, 5)
    r, n = diversity(spark, ["x"] * 5, status="failed")
    assert (r.n_valid, r.n_unique_normalized, r.max_same_normalized, r.n_pairs, r.all_identical_normalized, n) == (0, 0, None, 0, None, 0)
    r, n = diversity(spark, ["one"])
    assert (r.n_valid, r.n_unique_normalized, r.n_pairs, r.all_identical_normalized) == (1, 1, 0, None)
    r, n = diversity(spark, REPLICAS, repeat=True)
    assert r.replica_group_invalid and (r.n_records, r.n_unique_normalized, r.n_pairs, r.all_identical_normalized, n) == (6, None, None, None, 0)
    pairs = [("Yes.", "Yes?"), ("cafe", "café"), ("is good", "is not good"), ("1", "2")]
    df = spark.createDataFrame(pairs, "a string, b string").select(T.normalized("a") != T.normalized("b")).collect()
    assert all(x[0] for x in df)


PREPARE = [
    ("The doctor", " is kind.", "ok", False), ("Hello", ", world!", "ok", False), ("un", "happy", "ok", False), ("Text ", "你好", "ok", True), ("Name", "? False.", "ok", False), (None, " result", "ok", False),
    ("", " result", "ok", False), ("Text", None, "ok", False), ("Text", "\t", "ok", False), ("Text", " result", None, False), ("Text", "", "skipped_empty_prompt", False),
]


def test_prepare(spark):
    df = spark.createDataFrame([(i, "m", *r) for i, r in enumerate(PREPARE)], "i int, model_key string, prompt string, generation string, status string, audit_has_han boolean")
    out = prepare.apply_han_policy(prepare.prepare_texts(df))
    r = out.orderBy("i").collect()
    assert [x.text_full for x in r[:5]] == ["The doctor is kind.", "Hello, world!", "unhappy", "Text 你好", "Name? False."]
    assert [x.text_preparation_status for x in r[5:]] == ["missing_prompt", "empty_prompt", "missing_generation", "empty_generation", "generation_status_not_ok", "generation_status_not_ok"]
    assert r[3].exclusion_reason == "han_pending_review" and r[4].eligible_english_metrics and not r[3].eligible_english_metrics
    c = prepare.coverage(out).first()
    assert (c.n_records, c.n_prepared, c.n_excluded_han, c.n_eligible, c.pct_excluded_han_prepared) == (11, 5, 1, 4, 20.0)
    c = prepare.coverage(out.where("i > 4")).first()
    assert c.n_prepared == 0 and c.pct_excluded_han_prepared is None and c.pct_eligible_prepared is None
    with pytest.raises(ValueError):
        prepare.prepare_texts(out)
    with pytest.raises(ValueError):
        prepare.prepare_texts(df.drop("status"))
    with pytest.raises(Exception, match="audit_has_han is null"):
        prepare.apply_han_policy(prepare.prepare_texts(df.withColumn("audit_has_han", F.lit(None).cast("boolean")))).collect()


def test_runs_with_sidecars(spark, tmp_path):
    for model, n in (("base", 3), ("post", 2)):
        data = [(f"p{i}", model, 1, "d", "c", "s", "P", "g", "ok", 1.0, "e") for i in range(n)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/run/{model}/generations.parquet")
        (tmp_path / "run" / model / "metadata.json").write_text('{"expected_records": 3,\n "repetitions": 1}')
    run = parquet_audit.read_run(spark, f"{tmp_path}/run")
    done = {r.model_key: r for r in run["completeness"].collect()}
    assert done["base"].complete and not done["post"].complete and done["post"].observed_records == 2
    assert run["data"].count() == 5 and run["files"].count() == 2 and run["nul_report"].count() == 0


def test_inconsistent_prompts(spark):
    data = [BASE[0], (*BASE[0][:1], "other", 1, "gender", "male", *BASE[0][5:]), BASE[1], (*BASE[1][:1], "other", *BASE[1][2:])]
    r = audit.inconsistent_prompts(spark.createDataFrame(data, SCHEMA)).collect()
    assert [(x.prompt_id, x.n_category) for x in r] == [("a", 2)]


def test_review_sample(flagged):
    _, df = flagged
    out = audit.review_sample(df, 2)
    assert out.count() == 2 and out.first().manual_notes == ""
    assert sorted(map(str, out.collect())) == sorted(map(str, audit.review_sample(df.repartition(3), 2).collect()))
