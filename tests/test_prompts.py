import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from promptlens.operators import cleaning, eda, newlines, quality
from promptlens.sources import prompts, provenance, sinks

FILES = {"gender_prompt.json": {"Female": {"Ann_Lee": ["Ann was ", 'say "x"\n', "Ünï "]}, "Male": {"Bob": ["Bob is "]}}, "race_prompt.json": {"Z": {"Y": ["q", "q"]}, "A": {}}}


@pytest.fixture()
def folder(tmp_path):
    for name, value in FILES.items():
        (tmp_path / name).write_text(json.dumps(value, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(tmp_path)


def test_prompt_tables(spark, folder):
    t = prompts.prompt_table(spark, f"{folder}/gender_prompt.json", "gender").collect()
    assert [(r.categoria, r.entita, r.prompt) for r in t] == [("Female", "Ann_Lee", "Ann was "), ("Female", "Ann_Lee", 'say "x"\n'), ("Female", "Ann_Lee", "Ünï "), ("Male", "Bob", "Bob is ")]
    assert prompts.all_prompts(spark, folder, {"gender": "gender_prompt.json", "race": "race_prompt.json"}).groupBy("dominio").count().count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        prompts.prompt_table(spark, f"{folder}/none.json", "x").count()


def test_occurrences(spark, folder):
    rows = prompts.read_nested(spark, folder)
    o = prompts.occurrences(rows, 2).orderBy("record_order").collect()
    assert [r.record_order for r in o] == list(range(1, 13)) and [r.repetition for r in o[:4]] == [1, 2, 1, 2]
    assert o[0].domain == "gender" and [r.dataset_row for r in o][::2] == [1, 2, 3, 4, 5, 6]
    for r in o:
        raw = json.dumps([r.source_file, r.category, r.subject, r.prompt_index, r.prompt], ensure_ascii=False, separators=(",", ":"))
        assert r.prompt_id == hashlib.sha256(raw.encode()).hexdigest()[:20]
    assert prompts.occurrences(rows, 2, limit=2).count() == 4
    with pytest.raises(ValueError):
        prompts.occurrences(rows, 0)
    rec = prompts.occurrences(rows, 2).select(prompts.record_id(F.lit("m"), F.col("prompt_id"), F.col("repetition"))).first()[0]
    assert rec.startswith("m:") and rec.endswith(":r001")
    back = prompts.nested_json(prompts.occurrences(rows, 1).withColumn("generation", F.when(F.col("prompt") != "q", F.col("prompt")))).collect()
    got = {r.source_file: json.loads(r.value) for r in back}
    assert got["gender_prompt.json"] == FILES["gender_prompt.json"] and got["race_prompt.json"] == {"Z": {"Y": [None, None]}}
    assert list(got["gender_prompt.json"]) == ["Female", "Male"]


def test_bad_json(spark, tmp_path):
    (tmp_path / "x_prompt.json").write_text('{"a": [1')
    with pytest.raises(Exception, match="MALFORMED|parse"):
        prompts.read_nested(spark, str(tmp_path)).collect()


FLAGGED = {"[[x]] ": "ha_markup", "a\tb": "ha_tab", "a\nb": "ha_newline", "a\rb": "ha_carriage_return", "a  b": "ha_doppio_spazio", "a , b": "spazio_prima_punteggiatura", "é": "ha_non_ascii", "a​b": "ha_unicode_invisibile", "a b": "ha_unicode_invisibile", "(a": "parentesi_round_sbilanciate", "a]": "parentesi_quadre_sbilanciate", 'a"': "virgolette_sbilanciate", " a": "ha_spazio_iniziale", "a ": "ha_spazio_finale", "a \n": "ha_spazio_finale", " ": "is_prompt_vuoto", "&amp;": "ha_markup", "<b>": "ha_markup"}


def table(spark, texts):
    return spark.createDataFrame([("d", "c", "e", t) for t in texts], "dominio string, categoria string, entita string, prompt string")


def test_quality_flags(spark):
    df = quality.add_quality_flags(table(spark, [*FLAGGED, None, "", "clean text", "Clean  TEXT"]))
    r = {x.prompt: x for x in df.collect()}
    assert len(df.columns) == 26
    for t, flag in FLAGGED.items():
        assert r[t][flag] and not r["clean text"][flag], (t, flag)
    assert r[None].is_prompt_missing and not any(r[None][f] for f in FLAGGED.values()) and r[""].is_prompt_vuoto
    assert r["clean text"].is_duplicato_normalizzato and not r["clean text"].is_duplicato_esatto and not r[""].is_duplicato_normalizzato
    assert r["a\tb"].flag_errore_tecnico and not r[" a"].flag_errore_tecnico and r[" a"].flag_revisione_manuale
    for bad in (df.drop("prompt"), df.withColumn("entita", F.lit(1))):
        with pytest.raises(ValueError):
            quality.check_schema(bad)


def test_cleaning(spark):
    df = cleaning.clean_prompts(table(spark, ["Tom &amp; [[Ann]] {{x}}y​ \n", "one word to", "one word qz ", "same", "same", None, None, "a b"]))
    r = {x.prompt: x for x in df.collect()}
    assert r["Tom &amp; [[Ann]] {{x}}y​ \n"].prompt_per_generazione == "Tom & Ann y  " and r["Tom &amp; [[Ann]] {{x}}y​ \n"].prompt_pulito == "Tom & Ann y"
    assert not r["one word to"].ultima_parola_sospetta and r["one word qz "].ultima_parola_sospetta and r["one word qz "].ultimo_char == "z"
    assert r["same"].is_duplicato_esatto and r[None].is_duplicato_esatto and r[None].ha_markup is None
    assert r["a b"].n_parole == 2 and r["a b"].prompt_per_generazione == "a b"
    assert cleaning.cleaning_summary(df).first().n_righe == 8
    many = spark.createDataFrame([("d", c, "e", p) for c, p in (("x", "p"), ("y", "p"), ("x", "q"), ("x", "q"))], "dominio string, categoria string, entita string, prompt string")
    assert {(x.prompt, x.is_duplicato_cross_categoria) for x in cleaning.flag_duplicates(many).collect()} == {("p", True), ("q", False)}


def test_newlines(spark):
    kinds = {"\n\n": "solo_newline", "\na\n": "iniziale_e_finale", "\na": "iniziale", "a\n": "finale", "a\n\nb": "interno_consecutivo", "a\nb": "interno_singolo", "a\nb\nc": "interno_multiplo"}
    df = newlines.newline_details(quality.add_quality_flags(table(spark, [*kinds, "none"]).withColumn("id_riga_originale", F.monotonically_increasing_id())))
    r = {x.prompt: x for x in df.collect()}
    assert {k: v.tipo_newline for k, v in r.items()} == kinds and r["a\nb\nc"].posizioni_newline == "2 | 4" and r["\n\n"].posizioni_newline == "1 | 2"
    assert r["a\nb"].prompt_visibile == "a\\nb" and len(df.columns) == 23


def test_statistics(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6), ("b", None)], "dominio string, n_parole int")
    k = eda.kruskal_test(df)
    assert k["h"] == pytest.approx(27 / 7) and k["df"] == 1 and k["p"] == pytest.approx(math.erfc(math.sqrt(27 / 14)), rel=1e-9)
    assert eda.kruskal_wallis(df.where("dominio = 'a'")).first().h is None
    w = eda.pairwise_wilcoxon(df).first()
    assert (w.group1, w.group2, w.w) == ("b", "a", 9.0) and w.p == pytest.approx(math.erfc((4.5 - 0.5) / math.sqrt(9 * 7 / 12) / math.sqrt(2)), abs=1e-6)
    assert eda.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9) and eda.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    # Shapiro and Wilk (1965): weights of eleven men
    w, p = eda.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.7888, abs=2e-4) and p == pytest.approx(0.0067, abs=3e-4)
    counts = spark.createDataFrame([("d", "c", e, n) for e, n in (("x", 3), ("y", 3), ("z", 1))], "dominio string, categoria string, entita string, n_prompt_entita int")
    assert {r.entita for r in eda.dominant_entities(counts).collect()} == {"x", "y"}
    t = eda.type_token_ratio(table(spark, ["A a b", "b c"])).first()
    assert t.ttr == pytest.approx(3 / 5) and t.n_prompt == 2
    assert eda.balance(counts.withColumn("prompt", F.lit("x"))).first().sd is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", 1, None), ('q"x', 2, True)], "a string, b int, c boolean")
    assert sinks.write_report(df, f"{tmp_path}/r.csv") == 2
    assert open(f"{tmp_path}/r.csv", "rb").read() == '﻿a,b,c\né,1,\n"q""x",2,TRUE\n'.encode()
    assert spark.read.csv(f"{tmp_path}/r.csv", header=True, escape='"').columns == ["a", "b", "c"]
    sinks.write_csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True, escape='"').where("a = 'q\"x'").count() == 1
    sinks.write_parquet(df, f"{tmp_path}/p", check=True)
    sinks.write_by_group(df, f"{tmp_path}/g", "b")
    assert spark.read.csv(f"{tmp_path}/g", header=True).where("b = 2").count() == 1
    sinks.write_json({"x": None}, f"{tmp_path}/j.json")
    assert json.load(open(f"{tmp_path}/j.json")) == {"x": None}
    tex = sinks.latex_table(spark.createDataFrame([("a_b", 10195), ("c", 5)], "d string, n int"), "d", "n", "T")
    assert "a\\_b & 10\\,195" in tex and "10\\,200" in tex


def test_provenance(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"abc")
    found = provenance.file_digests(spark, str(tmp_path))
    assert found.first().sha256 == hashlib.sha256(b"abc").hexdigest() == provenance.file_digest(f"{tmp_path}/f.txt")
    provenance.check_digests(found, {"f.txt": hashlib.md5(b"abc").hexdigest()})
    with pytest.raises(ValueError):
        provenance.check_digests(found, {"f.txt": "0"})
    s = provenance.signature(a=1, b="é")
    assert s == provenance.signature(b="é", a=1) != provenance.signature(a=2, b="é")
    assert not provenance.may_resume(None, s) and provenance.may_resume({"signature": s}, s)
    with pytest.raises(ValueError):
        provenance.may_resume({"signature": "x"}, s)
    assert provenance.package_versions(["pyspark", "no-such"])["no-such"] is None and provenance.environment()["python"]


def test_stream(spark, tmp_path):
    from promptlens.streaming import prepared_stream, write_stream

    spark.createDataFrame([("p", " g", "ok"), ("", "g", "ok")], "prompt string, generation string, status string").write.parquet(f"{tmp_path}/in")
    write_stream(prepared_stream(spark, f"{tmp_path}/in", "prompt string, generation string, status string"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(r.text_preparation_status for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["empty_prompt", "prepared"]
