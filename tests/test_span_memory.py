"""What finding, merging and recognising hold at once, and that pieces of a batch change no result."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from promptlens.functions import rows
from promptlens.operators import anonymize, spans
from tests.test_masking import CASES, CONFIG, masked, prepared

WORDS = ["Alice White", "Bob", "Jews", "漢字", "plain", "words", "\U0001f600"]


def texts_of(n, words, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=words)) for _ in range(n)]


def peak_of(run, batch):
    """The traced peak over what a consumer that keeps nothing takes, and the number of rows."""
    tracemalloc.start()
    try:
        n = sum(len(out) for out in run(iter([batch])))
        return tracemalloc.get_traced_memory()[1], n
    finally:
        tracemalloc.stop()


def test_pieces_are_the_columns_in_turn(monkeypatch):
    monkeypatch.setattr(rows, "PIECE", 100)
    monkeypatch.setattr(rows, "ROWS", 7)
    texts = ["x" * 500, None, "", *["é" * i for i in range(40)], *[None] * 20, "y" * 101]
    got = list(rows.pieces((pa.array(texts), pa.array(range(len(texts))))))
    assert [t for part, _ in got for t in part] == texts and [i for _, part in got for i in part] == list(range(len(texts)))
    assert all(len(part) == 1 or len(part) <= 7 and sum(len((t or "").encode()) for t in part) <= 100 for part, _ in got)
    assert list(rows.pieces((pa.array([], pa.string()),))) == []


def test_finding_and_merging_hold_a_piece(spark, monkeypatch):
    df = prepared(spark)
    runs, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, *a: runs.append(f) or real(f, *a))
    spans.combine(masked(spark), anonymize.build_dictionary(df, CONFIG), spans.recognize(spans.ner_input(df), lambda texts: [[] for _ in texts]))
    assert len(runs) == 1  # a text goes to one worker, once
    texts = texts_of(4000, 200)
    entities = pa.array([None] * len(texts), pa.list_(pa.struct({"start_char": pa.int32(), "end_char": pa.int32(), "entity": pa.string()})))
    peak, n = peak_of(runs[0], (pa.array(texts), pa.array(["gender"] * len(texts)), pa.array(["Alice_White"] * len(texts)), entities))
    assert n == len(texts) and peak < 12e6, peak


def test_recognising_holds_a_list_of_the_recogniser(spark, monkeypatch):
    runs, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema: runs.append(run))
    seen = []
    spans.recognize(spark.createDataFrame([("a", "b")], "text_id string, text_full string"), lambda texts: seen.append(len(texts)) or [[(0, len(t), "PERSON")] for t in texts])
    texts = texts_of(4001, 200)
    peak, n = peak_of(runs[0], pa.RecordBatch.from_pydict({"text_id": [str(i) for i in range(len(texts))], "text_full": texts}))
    assert n == len(texts) and set(seen[:-1]) == {64} and peak < 6e6, peak


def test_batches_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    sizes = lambda texts: [[(0, 1, "PERSON")] for _ in texts]
    spans.recognize(spark.createDataFrame([("a", "b")], "text_id string, text_full string"), sizes)
    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    held = F.arrow_udf(lambda t: pa.array([t.nbytes] * len(t), pa.int64()), "long", F.ArrowUDFType.SCALAR)
    assert long.select(held("t").alias("n")).agg(F.max("n")).first()[0] < 10e6


def test_one_step_is_two_steps(spark, monkeypatch):
    dictionary = anonymize.build_dictionary(prepared(spark), CONFIG)
    cases = [(t, d, s, [(0, 3, t[:3])]) for t, (d, s) in zip(texts_of(60, 9, 2), [("gender", "Alice_White"), ("race", None), (None, "x")] * 20, strict=True)]
    cases += [(None, "gender", "Alice_White", None), ("", "gender", "x", None), ("Bob", "gender", "x", [])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, t string, domain string, subject string, e {spans.ENTITY_JSON}").coalesce(1)
    two = spans.dictionary_spans(df, dictionary, "t", "d").select("i", spans.merge_spans(F.col("t"), F.col("d"), F.col("e")).alias("m")).orderBy("i").collect()
    one = spans.found_and_merged(df, dictionary, "t", "e", "m").select("i", "m").orderBy("i").collect()
    assert one == two and len(one) == len(cases)
    for r, (t, _, _, e) in zip(one, cases, strict=True):
        assert len(r.m.decisions) == len(e or []) and (t is not None or r.m.asDict(recursive=True) == {"spans": [], "decisions": [], "conflict": False})


def test_logs_find_and_merge_once(spark):
    cases = [*CASES, ("race", "Nobody", "No name", " here.", "ok", False)]
    df = prepared(spark, cases)
    found = lambda texts: [[(t.find("Hero"), t.find("Hero") + 4, "PERSON")] if "Hero" in t else [] for t in texts]
    out = spans.combine(masked(spark, cases), anonymize.build_dictionary(df, CONFIG), spans.recognize(spans.ner_input(df), found))
    rows_of = out.where("ner_applied").select("ner_spans", "ner_decisions").collect()
    assert any(not r.ner_decisions for r in rows_of) and any(not r.ner_spans for r in rows_of)
    for log, column in ((spans.span_log(out), "ner_spans"), (spans.decision_log(out), "ner_decisions")):
        assert log._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        assert log.count() == sum(len(r[column]) for r in rows_of) and log.where("start_char IS NULL").count() == 0
