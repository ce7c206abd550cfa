"""One query for each operator of the text audit, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.operators import anonymize, audit, cleaning, eda, generation, newlines, prepare, quality, scoring, spans
from promptlens.plans.views import view
from promptlens.sources import prompts as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MASKING = anonymize.MaskingConfig(
    blocked_person_subjects=("Guitar_Hero",),
    profession_heads=("nurse", "watchman"),
    profession_extra_terms=("nurse", "nurses", "doctor", "doctors"),
    religious_terms=("Judaism", "Jew", "Jews", "Christian", "Christians", "Muslim", "Muslims", "Nation of Islam", "Islam"),
    political_terms=("far-left", "left-wing"),
    person_aliases=(("gender", "Alice_White", "White"),),
)
METRICS = scoring.MetricsConfig("metrics_v1", "dictionary_v1", ("gender", "race", "religious_ideology", "political_ideology"), ("profession",), ("he", "him", "his", "himself", "man", "men", "he's", "boy", "boys"), ("she", "her", "hers", "herself", "woman", "women", "she's", "girl", "girls"))
#: A few words with a valence, in place of a full lexicon.
LEXICON = {"good": 1.9, "kind": 2.4, "bad": -2.5, "evil": -3.4, "same": 0.3, "answer": 0.2}
EXPECTED_DOMAINS = ["gender", "profession", "race", "religious_ideology", "political_ideology"]


def query(name: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def _p(spark, d):
    return view(spark, d, "v_prompts")


def _clean(spark, d):
    return _p(spark, d).transform(cleaning.clean_prompts)


def _audit(spark, d):
    return _p(spark, d).transform(quality.add_quality_flags)


def _words(spark, d):
    return _p(spark, d).transform(cleaning.add_lengths)


def _flags(spark, d, name="v_generations"):
    return audit.add_flags(view(spark, d, name))


def _prepared(spark, d):
    return _flags(spark, d).transform(prepare.prepare_texts).transform(prepare.apply_han_policy)


def _masked(spark, d):
    df = _prepared(spark, d)
    return anonymize.mask_texts(df, anonymize.build_dictionary(df, MASKING), MASKING.version)


def _details(spark, d):
    return newlines.newline_details(_p(spark, d).withColumn("id_riga_originale", F.col("ord")).transform(quality.add_quality_flags))


def _simple(name: str, build: Callable[[SparkSession, str], DataFrame], *columns: str) -> None:
    QUERIES[name] = lambda spark, d: build(spark, d).select(*columns) if columns else build(spark, d)


# Prompt tables and cleaning
_simple("src5_src6_ids", lambda s, d: view(s, d, "v_generations").select("ord", source.stable_prompt_id(F.lit("f.json"), "category", "subject", F.col("ord"), F.coalesce("prompt", F.lit(""))).alias("prompt_id"), source.record_id(F.col("model_key"), F.col("prompt_id"), F.col("repetition")).alias("record_id"), T.first_sentence("generation").isNull().alias("no_text")))
_simple("tx1_tx2_lengths", _words, "ord", "n_char", "n_parole")
_simple("tx3_dup1_dup3_duplicates", lambda s, d: cleaning.flag_duplicates(_p(s, d)), "ord", "prompt_normalizzato", "is_duplicato_esatto", "is_duplicato_quasi", "is_duplicato_cross_categoria")
_simple("tx4_length_outliers", lambda s, d: cleaning.flag_length_outliers(_words(s, d)), "ord", "outlier_lunghezza")
_simple("tx5_tx8_truncation", lambda s, d: cleaning.flag_truncation(_p(s, d)), "ord", "ultimo_char", "finisce_con_punteggiatura", "ultima_parola", "ultima_parola_sospetta")
_simple("tx9_tx16_characters", lambda s, d: cleaning.flag_special_characters(_p(s, d)), "ord", *cleaning.STRUCTURAL, "ha_non_ascii")
_simple("tx17_tx18_repair", lambda s, d: cleaning.repair(_p(s, d)), "ord", "prompt_per_generazione", "prompt_pulito")
_simple("tx19_tx20_clean", _clean, "ord", "n_parole", "is_duplicato_quasi", "prompt_pulito", "flag_qualita_strutturale")
_simple("ag27_cleaning_summary", lambda s, d: cleaning.cleaning_summary(_clean(s, d)))
_simple("flt1_review_exports", lambda s, d: cleaning.export_cases(_clean(s, d))["lunghezza"], "ord", "prompt", "n_parole")

# Prompt audit
_simple("qa1_qa13_quality_flags", _audit, "ord", "prompt_normalizzato_audit", *(c for cs in quality.FLAGS.values() for c in cs), "is_duplicato_esatto", "is_duplicato_normalizzato", "is_riga_duplicata")
_simple("flt2_technical_errors", lambda s, d: quality.technical_errors(_audit(s, d)))
_simple("flt2_manual_review", lambda s, d: quality.manual_review(_audit(s, d)))
_simple("ag2_dataset_summary", lambda s, d: quality.dataset_summary(quality.add_quality_flags(_p(s, d).drop("ord"))))
_simple("ag3_missing_summary", lambda s, d: quality.missing_summary(_p(s, d)))
_simple("ag4_category_counts", lambda s, d: quality.category_counts(_p(s, d)))
_simple("ag5_length_summary", lambda s, d: quality.length_summary(_p(s, d)))
_simple("ag6_domain_check", lambda s, d: quality.check_domains(_p(s, d), EXPECTED_DOMAINS))
_simple("ag7_category_variants", lambda s, d: quality.category_variants(_p(s, d)))
_simple("ag8_flag_summary", lambda s, d: quality.flag_summary(_audit(s, d)))
_simple("ag9_duplicate_summary", lambda s, d: quality.duplicate_summary(_audit(s, d)))
_simple("ag10_technical_summary", lambda s, d: quality.technical_summary(_audit(s, d)))
_simple("nl1_nl5_newline_details", _details)
_simple("nl6_unchanged", lambda s, d: newlines.unchanged(_p(s, d), _audit(s, d), "ord"))
_simple("ag11_newline_by_kind", lambda s, d: newlines.by_kind(_details(s, d)))
_simple("ag11_newline_by_domain", lambda s, d: newlines.by_domain_kind(_details(s, d)))
_simple("ag11_newline_by_category", lambda s, d: newlines.by_category_kind(_details(s, d)))

# Balance and statistics
_simple("ag1_structure", lambda s, d: eda.structure_summary(_p(s, d)))
_simple("ag12_balance", lambda s, d: eda.balance(_p(s, d)))
_simple("ag13_prompts_per_domain", lambda s, d: eda.prompts_per_domain(_p(s, d)))
_simple("ag14_entity_counts", lambda s, d: eda.entity_counts(_p(s, d)))
_simple("ag15_entity_imbalance", lambda s, d: eda.entity_imbalance(eda.entity_counts(_p(s, d))))
_simple("st1_dominant_entities", lambda s, d: eda.dominant_entities(eda.entity_counts(_p(s, d))))
_simple("st2_kruskal_wallis", lambda s, d: eda.kruskal_wallis(_words(s, d)).select(F.round("h", 6).alias("h"), "df", "n"))
_simple("st3_pairwise_wilcoxon", lambda s, d: eda.pairwise_wilcoxon(_words(s, d)))
_simple("st4_shapiro_wilk", lambda s, d: eda.normality_test(_words(s, d)))
_simple("st5_type_token_ratio", lambda s, d: eda.type_token_ratio(_p(s, d)))
_simple("st5_corpus_type_token_ratio", lambda s, d: eda.corpus_type_token_ratio(_p(s, d)))
_simple("st6_dominance", lambda s, d: eda.dominance_over(eda.dominant_entities(eda.entity_counts(_p(s, d)))))
_simple("st7_qq_points", lambda s, d: eda.qq_points(_words(s, d)))
_simple("pl2_entity_histogram", lambda s, d: eda.histogram(eda.entity_counts(_p(s, d)), F.log10("n_prompt_entita"), ("dominio",)))
_simple("pl1_pl3_pl4_bars", lambda s, d: eda.bars(eda.category_counts(_p(s, d))))
_simple("pl5_length_histogram", lambda s, d: eda.histogram(_words(s, d), F.col("n_parole"), ("dominio",)))
_simple("pl6_box_stats", lambda s, d: eda.box_stats(_words(s, d)))
_simple("pl7_ttr_bars", lambda s, d: eda.bars(eda.type_token_ratio(_p(s, d)), value="ttr"))
_simple("pl8_token_histogram", lambda s, d: eda.token_histogram(_flags(s, d)))
_simple("pl9_han_rates", lambda s, d: eda.han_rates(_flags(s, d)))
_simple("sl3_stratified_sample", lambda s, d: eda.stratified_sample(_p(s, d), ("dominio", "categoria"), 3, "ord"), "ord", "dominio", "categoria")
_simple("sl4_simple_sample", lambda s, d: eda.stable_sample(_p(s, d), 100, "ord"), "ord")

# Generation audit
_AUDIT = "audit_has_text audit_status_ok audit_empty_generation audit_missing_prompt audit_empty_prompt audit_unexpected_status audit_status_inconsistent audit_at_token_limit audit_sentence_incomplete audit_n_chars audit_n_letters audit_n_han audit_n_latin audit_has_han audit_han_and_latin audit_has_kana audit_prompt_has_han audit_han_only_in_generation audit_n_question_marks audit_has_question_mark audit_roundtrip_mismatch audit_duplicate_key".split()
_simple("ga1_ga13_flags", lambda s, d: _flags(s, d, "v_repeated"), "ord", "category", *_AUDIT)
_simple("ga7_han_share", lambda s, d: _flags(s, d), "ord", "audit_n_han_letters", "audit_han_share_letters")
_simple("ga11_ga14_review", lambda s, d: _flags(s, d), "ord", "audit_repeated_word", "audit_review")
_simple("ga15_normalized", lambda s, d: view(s, d, "v_generations").select("ord", T.normalized("generation").alias("generation_normalized")))
_simple("ga16_han_passages", lambda s, d: audit.han_passages(_flags(s, d)))
_SUMMARY = "n_records n_prompts n_ok n_skipped_empty n_empty_generation n_unexpected_status n_status_inconsistent n_duplicate_key_rows n_at_token_limit pct_at_token_limit_ok mean_generated_tokens_ok mean_chars_ok n_nonempty_ok n_han_ok pct_han_nonempty_ok n_han_and_latin_ok n_han_only_in_generation_ok n_question_mark_ok pct_question_mark_nonempty_ok n_nul_rows n_nul_characters n_sentence_incomplete".split()
_simple("ag16_summary_by_model", lambda s, d: audit.summarize(_flags(s, d, "v_repeated")), "model_key", *_SUMMARY)
_simple("ag16_summary_by_category", lambda s, d: audit.summarize(_flags(s, d), ("model_key", "domain", "category")), "model_key", "domain", "category", *_SUMMARY)
_simple("ag16_summary_by_repetition", lambda s, d: audit.summarize(_flags(s, d), ("model_key", "repetition")), "model_key", "repetition", *_SUMMARY)
_simple("ag17_finish_counts", lambda s, d: audit.finish_counts(view(s, d, "v_generations")))
_simple("ag18_inconsistent_prompts", lambda s, d: audit.inconsistent_prompts(view(s, d, "v_repeated")))
_simple("ag19_jn4_jn5_paired_grid", lambda s, d: audit.paired_grid(view(s, d, "v_repeated"), ["base", "post", "other"]))
_simple("ag20_jn2_replica_diversity", lambda s, d: audit.replica_diversity(_flags(s, d, "v_repeated"), "ord"))
_simple("jn3_equal_replicas", lambda s, d: audit.equal_replicas(_flags(s, d)), "ord", "model_key", "prompt_id", "repetition", "generation_normalized", "n_same_normalized")
_simple("ag21_diversity_distribution", lambda s, d: audit.diversity_distribution(audit.replica_diversity(_flags(s, d), "ord")))
_simple("sl5_jn6_review_sample", lambda s, d: audit.review_sample(_flags(s, d)), "domain", "category", "prompt_id", "repetition", "model_key", "manual_notes")

# Preparation, masking, spans
_simple("pr1_pr2_prepare", _prepared, "ord", "text_preparation_status", "text_full", "eligible_english_metrics", "language_review_required", "exclusion_reason")
_simple("ag22_coverage", lambda s, d: prepare.coverage(_prepared(s, d), ("model_key", "domain")))
_simple("ag23_preparation_counts", lambda s, d: prepare.preparation_counts(_prepared(s, d)))
_simple("an2_plurals", lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", anonymize.profession_plural(F.concat("p_name", F.element_at(F.array(*map(F.lit, ("man", "y", "ay", "x", "s", "midwife", "sh", ""))), (F.col("p_partkey") % 8 + 1).cast("int")))).alias("plural")))
_simple("an3_dictionary", lambda s, d: anonymize.build_dictionary(_prepared(s, d), MASKING))
_simple("an1_an4_jn13_mask", _masked, "ord", "text_anonymized", "prompt_anonymized", "anonymization_n_replacements", "anonymization_n_prompt_replacements", "anonymization_status")
_simple("an5_an6_jn9_review", _masked, "ord", "anonymization_residual_name_candidate", "anonymization_review_required", "anonymization_review_reason", "eligible_anonymized_metrics")
_simple("ag25_replacement_counts", lambda s, d: anonymize.replacement_counts(_masked(s, d)))
_simple("ag23_masking_summary", lambda s, d: anonymize.masking_summary(_masked(s, d)))
_simple("an7_sl6_jn7_masking_sample", lambda s, d: anonymize.masking_sample(_masked(s, d)))


def _entities(spark, d):
    """Recognised names for each text: here, what a fixed list finds."""
    found = lambda texts: [[(m, m + len(n), "PERSON") for n in ("Alice White", "Mrs. Brown", "Bob Brown Jr.") for m in [t.find(n)] if m >= 0] for t in texts]
    return spans.recognize(spans.ner_input(_prepared(spark, d)), found)


def _combined(spark, d):
    masked = _masked(spark, d)
    dictionary = anonymize.build_dictionary(_prepared(spark, d), MASKING)
    return spans.combine(masked, dictionary, _entities(spark, d))


_simple("ne3_so5_ner_input", lambda s, d: spans.ner_input(_prepared(s, d)))
_simple("ne1_ne2_recognize", _entities)
_simple("ne4_dictionary_spans", lambda s, d: spans.dictionary_spans(_prepared(s, d), anonymize.build_dictionary(_prepared(s, d), MASKING)), "ord", "dictionary_spans")
_simple("ne5_ne8_jn8_combine", _combined, "ord", "text_anonymized", "prompt_anonymized", "ner_n_added", "ner_overlap_conflict", "ner_crosses_prompt_boundary", "anonymization_status", "anonymization_review_reason", "eligible_anonymized_metrics")
_simple("ne7_span_log", lambda s, d: spans.span_log(_combined(s, d)))
_simple("ne7_decision_log", lambda s, d: spans.decision_log(_combined(s, d)))
_simple("ag24_combined_summary", lambda s, d: spans.combined_summary(_combined(s, d)))


# Scores
def _scored(spark, d):
    return scoring.score(_masked(spark, d), METRICS, scoring.LexiconAnalyzer(LEXICON))


_simple("sc1_sentiment_label", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", scoring.sentiment_label(F.pmod("value", F.lit(2.0)) - 1).alias("sentiment_label")))
_simple("sc2_sentiment", _scored, "ord", "sentiment_compound", "sentiment_neg", "sentiment_neu", "sentiment_pos", "sentiment_label")
_simple("sc3_gender_counts", lambda s, d: view(s, d, "v_generations").select("ord", *(c.alias(n) for c, n in zip(scoring.gender_counts(F.col("generation"), METRICS.male_tokens, METRICS.female_tokens), ("gender_male_count", "gender_female_count", "gender_unigram_label"), strict=True))))
_simple("sc4_sc5_score", _scored, "ord", "metrics_exclusion_reason", "sentiment_status", "sentiment_reason", "gender_unigram_status", "gender_unigram_reason", "gender_male_count", "gender_female_count", "gender_unigram_label")
_simple("sc7_repeated_keys", lambda s, d: scoring.repeated_keys(view(s, d, "v_repeated")))
_simple("snk5_ag28_score_coverage", lambda s, d: scoring.score_coverage(_scored(s, d)))

# Generation
_simple("ge1_model_input", lambda s, d: view(s, d, "v_generations").select("ord", generation.model_input(F.col("prompt"), "instruction_prefix", "Continue: ").alias("model_input")))
_simple("ge4_ge5_sentence_end", lambda s, d: generation.trim_to_sentence(view(s, d, "v_generations").withColumnRenamed("generation", "generation_raw")), "ord", "sentence_end_char", "generation")
_simple("ge9_first_sentence", lambda s, d: view(s, d, "v_generations").select("ord", T.first_sentence("generation").alias("first_sentence")))


@query("ge2_batches")
def ge2(spark: SparkSession, d: str) -> DataFrame:
    """Batches of eight, done again where a record is missing from what an earlier run left: here, those that went well."""
    base = view(spark, d, "v_generations").select((F.col("ord") + 1).alias("record_order"), source.record_id(F.col("model_key"), F.col("prompt_id"), F.col("repetition")).alias("record_id"), F.col("prompt").alias("model_input"), "status")
    done = base.where("status = 'ok'").select("record_id")
    base = base.drop("status")
    return generation.generate(base, lambda texts, seed: [f"{len(t)}:{seed}" for t in texts], done=done).select("record_order", "batch_index", "batch_seed", "status", "generation")


@query("ge3_completion")
def ge3(spark: SparkSession, d: str) -> DataFrame:
    n, why = generation.completion(F.col("ids"), [0, 7])
    ids = view(spark, d, "v_generations").select("ord", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: ((F.col("ord") + 3) * i) % 29).alias("ids"))
    return ids.select("ord", n.cast("int").alias("n_ids"), why.alias("finish_reason"))


@query("snk4_nested_json")
def snk4(spark: SparkSession, d: str) -> DataFrame:
    """Every model's generations, the file named after model and domain."""
    every = view(spark, d, "v_generations")
    return source.nested_json(every.select("repetition", F.concat_ws("/", "model_key", F.concat("domain", F.lit(".json"))).alias("source_file"), "category", "subject", F.col("ord").alias("prompt_index"), F.col("ord").alias("record_order"), "generation"))


@query("src7_ga17_ga18_nul")
def src7(spark: SparkSession, d: str) -> DataFrame:
    """The NUL report of generations where some have the byte put in."""
    from promptlens.sources import parquet_audit

    hit = F.when(F.col("ord") % 9 == 2, F.concat(F.lit("a\x00b"), "generation", F.lit("\x00"))).otherwise(F.col("generation"))
    raw = view(spark, d, "v_generations").withColumn("generation", hit)
    return parquet_audit.nul_report(raw)


@query("pr1_nul_prepared")
def pr1_nul(spark: SparkSession, d: str) -> DataFrame:
    from promptlens.sources import parquet_audit

    hit = F.when(F.col("ord") % 9 == 2, F.concat(F.lit("a\x00b"), "generation", F.lit("\x00"))).otherwise(F.col("generation"))
    raw = parquet_audit.replace_nul(view(spark, d, "v_generations").withColumn("generation", hit))
    return prepare.prepare_texts(raw).select("ord", "audit_n_nul", "audit_has_nul", "audit_nul_columns", "text_preparation_status")


# Relational steps that the scripts take by themselves
def _records(spark, d, name):
    return view(spark, d, name).select("ord", source.record_id(F.col("model_key"), F.col("prompt_id"), F.col("repetition")).alias("record_id"), "prompt_id", "repetition", "model_key", "status")


def _planned(spark, d):
    """A plan of four repetitions by one model more than there are."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model_key"), F.lit(r).alias("repetition")) for m in ("base", "other") for r in range(1, 5)))).alias("x")
    keys = view(spark, d, "v_generations").select("prompt_id").distinct().select("prompt_id", each)
    return keys.select(source.record_id(F.col("x.model_key"), F.col("prompt_id"), F.col("x.repetition")).alias("record_id"))


_simple("jn11_unexpected_ids", lambda s, d: generation.unexpected(_records(s, d, "v_repeated"), _planned(s, d)).select("ord", "record_id", "prompt_id", "repetition", "model_key"))
_simple("jn12_so4_setdiff", lambda s, d: _p(s, d).select("categoria").exceptAll(_p(s, d).select(F.lower(F.trim("categoria")).alias("categoria"))))
_simple("so1_bind_rows", lambda s, d: _p(s, d).select("ord", "prompt").unionByName(view(s, d, "v_generations").select("ord", "generation"), allowMissingColumns=True))
_simple("so2_distinct", lambda s, d: _p(s, d).select("dominio", "categoria", "entita").distinct())
_simple("so3_union", lambda s, d: _p(s, d).select("dominio").union(view(s, d, "v_generations").select("domain")).distinct())
_simple("sl1_sorted", lambda s, d: _p(s, d).select("dominio", "categoria", "ord").orderBy("dominio", F.desc_nulls_last("categoria"), "ord"))
_simple("sl2_first_n", lambda s, d: _p(s, d).orderBy("ord").limit(50).select("ord", "prompt"))
_simple("wn8_row_ids", lambda s, d: _p(s, d).select("ord", (F.row_number().over(Window.partitionBy("dominio").orderBy("ord"))).alias("id_riga")))
_simple("wn9_first_per_group", lambda s, d: eda.bars(eda.category_counts(_p(s, d))).where("posizione <= 3"))
_simple("jn1_labels", lambda s, d: quality.flag_summary(_audit(s, d)).join(F.broadcast(s.createDataFrame([(c, k) for k, cs in quality.FLAGS.items() for c in cs], "controllo string, etichetta string")), "controllo", "left"))
_simple("ag26_completeness", lambda s, d: audit.completeness(view(s, d, "v_generations"), s.createDataFrame([("base", 500, 5), ("post", 500, 5), ("other", 500, 5)], "model_key string, expected_records long, expected_repetitions int")))
_simple("sl7_ne10_pilot_sample", lambda s, d: spans.pilot_sample(spans.ner_input(_prepared(s, d)), 50, "Mrs. Brown"), "text_id", "sample_kind")
_simple("ge10_few_shot", lambda s, d: view(s, d, "v_generations").select("ord", generation.few_shot(F.col("prompt"), [("A", "b.")], "Continue.").alias("model_input")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's summary by model: scan, Unicode flags, a window and filtered aggregates."""
    return QUERIES["ag16_summary_by_model"](spark, sf_dir)
