import pytest
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.operators import anonymize, spans

CONFIG = anonymize.MaskingConfig(blocked_person_subjects=("Guitar_Hero",), profession_heads=("practitioner", "midwife", "nurse"), profession_extra_terms=("nurse", "nurses"), religious_terms=("Judaism", "Jew", "Jews"), political_terms=("left-wing",))
CASES = [
    ("gender", "Alice_White", "Alice White is kind. Alice White", " said she is not bad.", "ok", False),
    ("profession", "Nurse_practitioner", "A nurse practitioner", " helps nurses and nursesharks.", "ok", False),
    ("profession", "Jewellery", "Jewellery", " is beautiful.", "ok", False),
    ("political_ideology", "Left-wing_terrorism", "Left-wing terrorism", " is violent. Do not turn left.", "ok", False),
    ("religious_ideology", "Judaism", "Judaism is discussed", " by Jews; Jewishness differs.", "ok", False),
    ("race", "Guitar_Hero", "Guitar Hero", " is a game.", "ok", False),
    ("gender", "Alice_White", "Alice White", " 你好", "ok", True),
    ("gender", "Alice_White", "", None, "skipped_empty_prompt", False),
    ("profession", "Midwife", "The midwife", " works with midwives.", "ok", False),
]
SCHEMA = "i int, model_key string, prompt_id string, repetition int, category string, domain string, subject string, prompt string, generation string, status string, audit_has_han boolean"


def prepared(spark, cases=CASES):
    from promptlens.operators.prepare import apply_han_policy, prepare_texts

    df = spark.createDataFrame([(i, "m", f"p{i}", 1, "c", *c) for i, c in enumerate(cases)], SCHEMA)
    return apply_han_policy(prepare_texts(df))


def masked(spark, cases=CASES, config=CONFIG):
    df = prepared(spark, cases)
    return anonymize.mask_texts(df, anonymize.build_dictionary(df, config), config.version)


def test_masking(spark):
    r = masked(spark).orderBy("i").collect()
    assert [x.text_anonymized for x in r] == [
        "Person is kind. Person said she is not bad.", "A XYZ helps XYZ and nursesharks.", "Jewellery is beautiful.", "XYZ terrorism is violent. Do not turn left.", "XYZ is discussed by XYZ; Jewishness differs.",
        "Guitar Hero is a game.", "Person 你好", None, "The XYZ works with XYZ.",
    ]
    assert r[0].anonymization_n_replacements == 2 and r[0].eligible_anonymized_metrics
    assert r[2].anonymization_review_reason == r[5].anonymization_review_reason == "subject_entity_type_unverified"
    assert not r[6].eligible_anonymized_metrics and r[7].anonymization_status == "not_prepared" and r[7].anonymization_n_replacements is None
    counts = {(x.domain, x.matched_text): x.n_replacements for x in anonymize.replacement_counts(masked(spark)).collect()}
    assert counts["gender", "Alice White"] == 3 and counts["profession", "midwives"] == 1
    assert anonymize.masking_sample(masked(spark)).count() == 9


def test_patterns(spark):
    pattern = T.alias_pattern(["A. R. Rahman", "José Smith", "C++", "A\\EB"])
    texts = {"A. R. Rahman's": "Person's", "Ax Rz Rahman": "Ax Rz Rahman", "XJosé Smith": "XJosé Smith", "C++": "Person", "josé SMITH": "Person", "A\\EB": "Person", "C+++": "Person+"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace("t", pattern, "Person").alias("o"))
    assert {r.t: r.o for r in df.collect()} == texts
    assert T.alias_pattern([]) == "(?!)"
    for t, o in texts.items():
        found = spans.locate(t, spans.compiled(["A. R. Rahman", "José Smith", "C++", "A\\EB"]))
        assert spans.person_preview(t, [{**s, "entity": t[s["start_char"] : s["end_char"]]} for s in found]) == o


def test_scoped_alias_and_residual(spark):
    config = anonymize.MaskingConfig(person_aliases=(("gender", "Alice_White", "White"),))
    cases = [("gender", "Alice_White", "Alice White", " and White.", "ok", False), ("gender", "Bob_Brown_Jr.", "Bob Brown Jr.", " and White. Brown came.", "ok", False), ("gender", "Bob_Brown_Jr.", "Bob Brown Jr.", " saw brown.", "ok", False)]
    r = masked(spark, cases, config).orderBy("i").collect()
    assert r[0].text_anonymized == "Person and Person." and "White" in r[1].text_anonymized
    assert r[1].anonymization_residual_name_candidate and not r[2].anonymization_residual_name_candidate
    assert r[1].anonymization_review_reason == "residual_target_name_candidate"


def test_plurals(spark):
    words = {"midwife": "midwives", "Foreman": "Foremen", "secretary": "secretaries", "attorney": "attorneys", "coach": "coaches", "boss": "boss", "nurse": "nurses", "fox": "foxes"}
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", anonymize.profession_plural(F.col("w")).alias("p"))
    assert {r.w: r.p for r in df.collect()} == words


def test_errors(spark):
    with pytest.raises(ValueError):
        anonymize.MaskingConfig(person_aliases=(("profession", "x", "y"),))
    df = prepared(spark)
    with pytest.raises(ValueError):
        anonymize.build_dictionary(df, anonymize.MaskingConfig(religious_terms=("XYZ",)))
    with pytest.raises(ValueError):
        anonymize.mask_texts(masked(spark), anonymize.build_dictionary(df, CONFIG), "v")


def span(a, b, entity=None):
    return {"start_char": a, "end_char": b} | ({"entity": entity} if entity else {})


def test_merge():
    t = "Waylon Payne also stars in Monte Hellman's film. Is he bad?"
    m = spans.merge(t, [span(0, 12)], [span(27, 40, "Monte Hellman")])
    assert not m["conflict"] and [s["source"] for s in m["spans"]] == ["dictionary", "ner"]
    assert spans.person_preview(t, [{**s, "entity": t[s["start_char"] : s["end_char"]]} for s in m["spans"]]) == "Person also stars in Person's film. Is he bad?"
    t = "Alice White and Bob"
    assert spans.merge(t, [span(0, 11)], [span(0, 11, "Alice White")])["spans"][0]["source"] == "dictionary+ner"
    inner = spans.merge(t, [span(0, 11)], [span(6, 11, "White")])
    assert len(inner["spans"]) == 1 and not inner["conflict"] and inner["decisions"][0]["decision"] == "covered"
    assert spans.merge(t, [span(0, 11)], [span(0, 19, t)])["conflict"]
    for bad in ([span(0, 99)], [span(3, 3)]):
        with pytest.raises(ValueError):
            spans.merge(t, bad, [])
    with pytest.raises(ValueError):
        spans.merge(t, [], [span(0, 5, "Bobby")])


def test_splice_and_clean(spark):
    t = "漢 \U0001f600 José's?"
    a, b = spans.clean_person_span(t, 3, 10)
    assert t[a:b] == "José" and spans.clean_person_span("  ", 0, 2) is None
    df = spark.createDataFrame([(t, [(a, b, "ner")])], "t string, s array<struct<start_char:int,end_char:int,source:string>>")
    assert df.select(spans.splice(F.col("t"), F.col("s"))).first()[0] == "漢 \U0001f600 Person's?"
    with pytest.raises(ValueError):
        spans.person_preview("Alice White", [{"start_char": 0, "end_char": 11, "entity": "Alice White"}, {"start_char": 6, "end_char": 11, "entity": "White"}])
    assert spans.person_preview("Rome", [{"start_char": 0, "end_char": 4, "entity": "Rome", "label": "GPE"}]) == "Rome"


def test_combine(spark):
    base = masked(spark)
    dictionary = anonymize.build_dictionary(prepared(spark), CONFIG)
    found = lambda texts: [[(m, m + len(n), "PERSON") for n in ("Alice White is", "Hero") for m in [t.find(n)] if m >= 0] + [(0, 1, "GPE")] for t in texts]
    entities = spans.recognize(spans.ner_input(prepared(spark)), found)
    out = spans.combine(base, dictionary, entities)
    r = {x.i: x for x in out.collect()}
    assert r[0].ner_overlap_conflict and r[0].text_anonymized == r[0].text_anonymized_dictionary and r[0].anonymization_review_reason == "overlap_conflict"
    assert r[5].text_anonymized == "Guitar Person is a game." and r[5].ner_n_added == 1 and r[5].anonymization_status == "applied"
    assert r[1].text_anonymized == "A XYZ helps XYZ and nursesharks." and not r[1].ner_applied
    assert not r[6].eligible_anonymized_metrics
    assert spans.span_log(out).where("entity = 'Hero'").count() == 1 and spans.decision_log(out).where("decision = 'conflict'").count() == 1
    assert spans.combined_summary(out).agg(F.sum("n_added_mentions")).first()[0] == 1
