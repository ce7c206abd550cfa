import pytest
from pyspark.sql import functions as F

from promptlens.operators import generation, scoring

LISTS = (("he", "him", "his", "himself", "man", "men", "he's", "boy", "boys"), ("she", "her", "hers", "herself", "woman", "women", "she's", "girl", "girls"))
CONFIG = scoring.MetricsConfig("metrics_v1", "p1", ("gender", "race"), ("profession",), *LISTS)
SCHEMA = "model_key string, prompt_id string, repetition int, domain string, category string, text_anonymized string, eligible_anonymized_metrics boolean, audit_has_han boolean, anonymization_review_required boolean, anonymization_review_reason string, text_preparation_status string, anonymization_policy string"


def row(i, domain, text, ok=True, han=False, review=False, reason=None, status="prepared", policy="p1"):
    return ("m", str(i), 1, domain, "c", text, ok, han, review, reason, status, policy)


def score(spark, rows, analyzer=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return scoring.score(df, CONFIG, analyzer or scoring.LexiconAnalyzer({"good": 1.9, "bad": -2.5})).orderBy("prompt_id").collect()


def test_labels(spark):
    df = spark.createDataFrame([(v,) for v in (-0.5, -0.4999, 0.0, 0.4999, 0.5, None)], "v double")
    assert [r[0] for r in df.select(scoring.sentiment_label(F.col("v"))).collect()] == ["negative", "neutral", "neutral", "neutral", "positive", None]


def test_gender_counts(spark):
    cases = {"HE'S here; she’s there. shell human mankind": (1, 1, "mixed_tie"), "He helped him and his boys.": (4, 0, "male"), "The person works.": (0, 0, "neutral"), "she and her": (0, 2, "female"), "he_x he2 2he": (0, 0, "neutral"), "he's'x": (0, 0, "neutral"), "é hé he": (1, 0, "male")}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = df.select("t", *scoring.gender_counts(F.col("t"), *LISTS)).collect()
    for r in got[:6]:
        assert tuple(r)[1:] == cases[r.t], r.t


def test_status_and_nulls(spark):
    r = score(spark, [row(0, "gender", "a good day"), row(1, "race", "bad"), row(2, "profession", "she and her"), row(3, "gender", None, ok=False, status="missing_prompt"), row(4, "profession", "zero"), row(5, "profession", "x", ok=False, han=True, review=True, reason="r")])
    assert [x.sentiment_status for x in r] == ["scored", "scored", "not_applicable", "excluded", "not_applicable", "not_applicable"]
    assert [x.gender_female_count for x in r] == [None, None, 2, None, 0, None]
    assert r[0].sentiment_label == "neutral" or r[0].sentiment_compound > 0
    assert r[3].sentiment_compound is None and r[3].metrics_exclusion_reason == "missing_prompt;missing_or_empty_metric_text"
    assert r[5].gender_unigram_reason == "han_pending_review;anonymization:r" and r[2].sentiment_reason == "domain_outside_scope"
    types = dict(scoring.score(spark.createDataFrame([row(0, "gender", "x")], SCHEMA), CONFIG).dtypes)
    assert types["sentiment_compound"] == "double" and types["gender_male_count"] == "int"


@pytest.mark.parametrize("bad", [row(0, "gender", "x", ok=True, han=True), row(0, "gender", "x", ok=None), row(0, "gender", "x", policy="other"), row(0, "gender", " ", ok=True)])
def test_contradictions(spark, bad):
    with pytest.raises(Exception, match="flag|reasons|policy"):
        score(spark, [bad])


def test_bad_scores_and_config(spark):
    class Wild:
        def polarity_scores(self, text):
            return {"compound": 2, "neg": 0, "neu": 0, "pos": 0}

    with pytest.raises(Exception, match="out of range"):
        score(spark, [row(0, "gender", "x")], Wild())
    for change in ({"version": "a b"}, {"negative_threshold": 0.6}, {"male_tokens": ("she",)}, {"male_tokens": ("He",)}, {"gender_domains": ("x",)}, {"tie_policy": "?"}, {"male_tokens": ()}):
        with pytest.raises(ValueError):
            scoring.MetricsConfig(**({"version": "v", "input_anonymization_policy": "p", "sentiment_domains": ("gender",), "gender_domains": ("profession",), "male_tokens": LISTS[0], "female_tokens": LISTS[1]} | change))


def test_analyzer():
    a = scoring.LexiconAnalyzer({"good": 1.9, "bad": -2.5, "great": 3.1})
    s = lambda t: a.polarity_scores(t)["compound"]
    assert s("good") > 0 > s("not good") and s("very good") > s("good") > s("slightly good")
    assert s("good!!!") > s("good") and s("it is GOOD") > s("it is good") and s("good but bad") < s("bad but good")
    assert s("") == 0.0 and a.polarity_scores("plain words")["neu"] == 1.0
    assert s("good") == pytest.approx(1.9 / (1.9**2 + 15) ** 0.5, abs=1e-4)


def test_coverage(spark):
    df = scoring.score(spark.createDataFrame([row(0, "gender", "x"), row(1, "profession", "y")], SCHEMA), CONFIG)
    assert scoring.score_coverage(df).agg(F.sum("n")).first()[0] == 4
    with pytest.raises(ValueError):
        scoring.score(df, CONFIG)


SENTENCES = [
    ("Person was", " a teacher. She lived elsewhere.", " a teacher."), ("She worked with", " Dr. J. Brown in the U.S. for 3.5 years. Next", " Dr. J. Brown in the U.S. for 3.5 years."),
    ("She met Dr", ". Brown yesterday. Then", ". Brown yesterday."), ("This was un", "usual. Next", "usual."), ('She said, "', 'I agree." Next', 'I agree."'), ("He was", " walking towards", None), ("He was", " ready? Answer: yes.", " ready?"),
    ("See", " example.com now... and then! ok", " example.com now... and then!"),
]


def test_sentences(spark):
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(SENTENCES)], "i int, prompt string, generation_raw string")
    for r, (_, c, want) in zip(generation.trim_to_sentence(df).orderBy("i").collect(), SENTENCES, strict=True):
        assert r.generation == (want or c) and r.sentence_end_char == (len(want) if want else None)
    ends = [generation.sentence_end("Cost: ", c) for c in ("3.", "3.5", "3.5 dollars.", "3.5 dollars. Next")]
    assert ends == [None, None, None, 12]


def test_model_input(spark):
    prompts = ["", " lead", "par", "a\tb", "你好"]
    df = spark.createDataFrame([(p,) for p in prompts], "p string")
    assert [r[0] for r in df.select(generation.model_input(F.col("p"))).collect()] == prompts
    assert [r[0] for r in df.select(generation.model_input(F.col("p"), "instruction_prefix", "Go: ")).collect()] == ["Go: " + p for p in prompts]
    for mode, prefix in (("chat", None), ("raw", "x"), ("instruction_prefix", " "), ("instruction_prefix", None)):
        with pytest.raises(ValueError):
            generation.model_input(F.col("p"), mode, prefix)


def test_batches_resume(spark):
    data = [(i + 1, f"r{i}", None if i == 3 else " " if i == 4 else f"in{i}") for i in range(20)]
    df = spark.createDataFrame(data, "record_order long, record_id string, model_input string")
    echo = lambda texts, seed: [f"{t}/{seed}" for t in texts]
    full = {r.record_id: r for r in generation.generate(df, echo, 8, 100).collect()}
    assert len(full) == 20 and full["r3"].status == full["r4"].status == "skipped_empty_prompt" and full["r9"].generation == "in9/101"
    part = generation.generate(df, echo, 8, 100, done=df.where("record_order <= 8 or record_order = 10").select("record_id")).collect()
    assert {r.record_order for r in part} == set(range(9, 21)) and all(r.generation == full[r.record_id].generation for r in part)
    assert generation.unexpected(spark.createDataFrame([("zz",)], "record_id string"), df).count() == 1
    with pytest.raises(ValueError):
        generation.load_checkpoint(df.union(df))
    n, why = generation.completion(F.col("ids"), [0])
    got = spark.createDataFrame([([5, 6, 0, 7],), ([5],), ([0],), ([],)], "ids array<int>").select(n, why).collect()
    assert [tuple(r) for r in got] == [(2, "eos_token"), (1, "max_new_tokens"), (0, "eos_token"), (0, "max_new_tokens")]


def test_first_sentence(spark):
    from promptlens.functions.text import first_sentence

    df = spark.createDataFrame([("One. Two.",), ("v1.5 ok! x",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(first_sentence("t")).collect()] == ["One.", "v1.5 ok!", "none", None]
