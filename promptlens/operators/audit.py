"""Audit of generated continuations: flags, summaries, replica diversity, pairing, Han passages, samples.

No row is dropped. Flags are false, not null, where a text is missing; measures are null. Optional
columns change the plan: without `tokenizer_roundtrip_matches` its flag is null, without
`sentence_complete` no sentence counts as incomplete, and `generation_hit_token_limit` overrides the
finish reason where it exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T

KEY = ("model_key", "prompt_id", "repetition")
TEXTS = ("prompt_id", "model_key", "domain", "category", "subject", "prompt", "generation", "status", "finish_reason")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def check_schema(df: DataFrame, rows: bool = True) -> DataFrame:
    """Columns and types; with rows, also what only the data can show, in one aggregation."""
    kinds = dict(df.dtypes)
    missing = [c for c in (*TEXTS, "repetition", "generated_tokens") if c not in kinds]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    other = [c for c in TEXTS if kinds[c] != "string"] + [c for c in ("repetition", "generated_tokens") if kinds[c] not in NUMERIC and not kinds[c].startswith("decimal")]
    if other:
        raise ValueError(f"wrong types: {', '.join(other)}")
    if rows:
        bad = T.any_of(F.col(c).isNull() for c in KEY)
        r = df.agg(F.count("*").alias("n"), F.count_if(bad).alias("keys"), F.count_if((F.col("repetition") < 1) | (F.col("repetition") % 1 != 0)).alias("reps")).first()
        if not r.n:
            raise ValueError("no records")
        if r.keys:
            raise ValueError(f"{r['keys']} rows without a key")
        if r.reps:
            raise ValueError(f"{r.reps} repetitions that are no positive integer")
    return df


def add_flags(df: DataFrame) -> DataFrame:
    """The audit_* columns."""
    check_schema(df, rows=False)
    have = set(df.columns)
    if "audit_status_ok" in have:
        raise ValueError("already audited")
    nul = {"audit_has_nul": F.lit(False), "audit_n_nul": F.lit(0), "audit_nul_in_metric_text": F.lit(False)}
    df = df.withColumns({c: v for c, v in nul.items() if c not in have})
    g, p, status = F.col("generation"), F.col("prompt"), F.col("status")
    col = F.col
    has_text = T.flag(~T.blank(g))
    ok = T.flag(status == "ok")
    empty_prompt = T.flag(T.blank(p))
    limit = T.flag(col("generation_hit_token_limit")) if "generation_hit_token_limit" in have else T.flag(col("finish_reason") == "max_new_tokens")
    first = {
        "audit_has_text": has_text,
        "audit_status_ok": ok,
        "audit_empty_generation": ok & ~has_text,
        "audit_missing_prompt": p.isNull(),
        "audit_empty_prompt": empty_prompt,
        "audit_unexpected_status": ~T.one_of(status, ("ok", "skipped_empty_prompt")),
        "audit_status_inconsistent": (T.flag(status == "skipped_empty_prompt") & (~empty_prompt | has_text)) | (ok & empty_prompt),
        "audit_at_token_limit": limit,
        "audit_sentence_incomplete": (ok & ~T.flag(col("sentence_complete"))) if "sentence_complete" in have else F.lit(False),
        "audit_n_chars": F.length(g),
        "audit_n_letters": T.count(g, r"\p{L}"),
        "audit_n_han": T.count(g, r"\p{IsHan}"),
        "audit_n_han_letters": T.count(g, r"[\p{L}&&\p{IsHan}]"),
        "audit_n_latin": T.count(g, r"\p{IsLatin}"),
        "audit_has_kana": T.flag(T.matches(g, r"[\p{IsHiragana}\p{IsKatakana}]")),
        "audit_prompt_has_han": T.flag(T.matches(p, r"\p{IsHan}")),
        "audit_n_question_marks": T.count_literal(g, "?"),
        "audit_repeated_word": T.flag(T.matches(g, r"(?iU)\b(\p{L}+)\b(?:\s+\1\b){3,}")),
        "audit_roundtrip_mismatch": T.flag(~col("tokenizer_roundtrip_matches")) if "tokenizer_roundtrip_matches" in have else F.lit(None).cast("boolean"),
        "audit_duplicate_key": F.count("*").over(Window.partitionBy(*KEY)) > 1,
    }
    df = df.withColumns(first)
    has_han = T.flag(col("audit_n_han") > 0)
    df = df.withColumns(
        {
            "audit_has_han": has_han,
            "audit_han_share_letters": F.when(col("audit_n_letters") > 0, col("audit_n_han_letters") / col("audit_n_letters")),
            "audit_han_and_latin": T.flag(has_han & (col("audit_n_latin") > 0)),
            "audit_han_only_in_generation": has_han & ~col("audit_prompt_has_han") & ~col("audit_missing_prompt"),
            "audit_has_question_mark": T.flag(col("audit_n_question_marks") > 0),
        }
    )
    signals = "has_han has_question_mark empty_generation unexpected_status status_inconsistent missing_prompt repeated_word duplicate_key roundtrip_mismatch has_nul sentence_incomplete".split()
    return df.withColumn("audit_review", T.any_of(T.flag(col(f"audit_{s}")) for s in signals))


def _share(condition: Column, among: Column) -> Column:
    """Per cent of rows among which the condition holds; null if there are none."""
    return 100 * F.avg(F.when(among, condition.cast("int")))


def summarize(df: DataFrame, groups: tuple[str, ...] = ("model_key",)) -> DataFrame:
    """Counts and rates by any groups, each rate with its own denominator."""
    c = F.col
    ok, text = c("audit_status_ok"), c("audit_has_text")
    both = ok & text
    n = F.count_if
    return df.groupBy(*groups).agg(
        F.count("*").alias("n_records"),
        F.countDistinct("prompt_id").alias("n_prompts"),
        n(ok).alias("n_ok"),
        n(c("status") == "skipped_empty_prompt").alias("n_skipped_empty"),
        n(c("audit_empty_generation")).alias("n_empty_generation"),
        n(c("audit_unexpected_status")).alias("n_unexpected_status"),
        n(c("audit_status_inconsistent")).alias("n_status_inconsistent"),
        n(c("audit_duplicate_key")).alias("n_duplicate_key_rows"),
        n(c("audit_at_token_limit") & ok).alias("n_at_token_limit"),
        _share(c("audit_at_token_limit"), ok).alias("pct_at_token_limit_ok"),
        F.avg(F.when(ok, c("generated_tokens"))).alias("mean_generated_tokens_ok"),
        F.avg(F.when(ok, c("audit_n_chars"))).alias("mean_chars_ok"),
        n(both).alias("n_nonempty_ok"),
        n(c("audit_has_han") & ok).alias("n_han_ok"),
        _share(c("audit_has_han"), both).alias("pct_han_nonempty_ok"),
        n(c("audit_han_and_latin") & ok).alias("n_han_and_latin_ok"),
        n(c("audit_han_only_in_generation") & ok).alias("n_han_only_in_generation_ok"),
        n(c("audit_has_question_mark") & ok).alias("n_question_mark_ok"),
        _share(c("audit_has_question_mark"), both).alias("pct_question_mark_nonempty_ok"),
        n(c("audit_repeated_word")).alias("n_repeated_word"),
        n(c("audit_has_nul")).alias("n_nul_rows"),
        F.sum("audit_n_nul").alias("n_nul_characters"),
        n(c("audit_sentence_incomplete")).alias("n_sentence_incomplete"),
        n(c("audit_review")).alias("n_review"),
    )


def finish_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("model_key", "status", "finish_reason").agg(F.count("*").alias("n"))


def inconsistent_prompts(df: DataFrame) -> DataFrame:
    """Keys whose attributes differ between models; a null is a value of its own."""
    attributes = ("domain", "category", "subject", "prompt")
    kinds = [(F.countDistinct(a) + F.max(F.col(a).isNull().cast("int"))).alias(f"n_{a}") for a in attributes]
    return df.groupBy("prompt_id", "repetition").agg(*kinds).where(" or ".join(f"n_{a} <> 1" for a in attributes))


def paired_grid(df: DataFrame, models: list[str]) -> DataFrame:
    """Records of each observed key for each model, 0 where there is none. models is the caller's short list."""
    counts = df.groupBy("prompt_id", "repetition", "model_key").agg(F.count("*").alias("n"))
    keys = df.select("prompt_id", "repetition").distinct()
    grid = keys.select("*", F.explode(F.array(*map(F.lit, models))).alias("model_key"))
    return grid.join(counts, ["prompt_id", "repetition", "model_key"], "left").select("prompt_id", "repetition", "model_key", F.coalesce("n", F.lit(0)).alias("n_records"))


def missing_keys(df: DataFrame, models: list[str]) -> DataFrame:
    return paired_grid(df, models).where("n_records <> 1")


# Replica diversity


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumn("replica_group_invalid", F.max("audit_duplicate_key").over(Window.partitionBy("model_key", "prompt_id")))


def _valid(marked: DataFrame) -> DataFrame:
    some = marked.where(F.col("audit_status_ok") & F.col("audit_has_text") & ~F.col("replica_group_invalid"))
    return some.withColumn("generation_normalized", T.normalized("generation"))


def replica_diversity(df: DataFrame, order: str = "repetition") -> DataFrame:
    """One row a (model, prompt): valid and distinct continuations, equal pairs, after normalisation.

    Equal pairs come from group sizes, not from a self-join. Groups with duplicate keys stay, with
    null measures. Attributes are those of the first row in `order`.
    """
    group = ("model_key", "prompt_id")
    marked = _marked(df)
    first = F.struct(order, "domain", "category", "subject", "prompt")
    per = marked.groupBy(*group).agg(F.min(first).alias("f"), F.count("*").alias("n_records"), F.count_if(F.col("audit_status_ok") & F.col("audit_has_text")).alias("n_valid"), F.max("replica_group_invalid").alias("replica_group_invalid"))
    same = _valid(marked).groupBy(*group, "generation_normalized").agg(F.count("*").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    measures = same.groupBy(*group).agg(F.count("*").alias("u"), F.max("n").alias("max_same_normalized"), F.sum(pairs).alias("e"))
    x = per.join(measures, list(group), "left")
    bad, v = F.col("replica_group_invalid"), F.col("n_valid")
    unique = F.when(~bad, F.coalesce("u", F.lit(0)))
    return x.select(
        *group, *(F.col(f"f.{a}").alias(a) for a in ("domain", "category", "subject", "prompt")), "n_records", "n_valid", "replica_group_invalid",
        unique.alias("n_unique_normalized"), "max_same_normalized", (v - unique).alias("n_redundant_normalized"),
        F.when(~bad, v * (v - 1) / 2).alias("n_pairs"), F.when(~bad, F.coalesce("e", F.lit(0.0))).alias("n_equal_pairs_normalized"),
        F.when(~bad & (v >= 2), unique == 1).alias("all_identical_normalized"),
    )


def equal_replicas(df: DataFrame) -> DataFrame:
    """Rows whose normalised continuation occurs more than once for their model and prompt."""
    same = F.count("*").over(Window.partitionBy("model_key", "prompt_id", "generation_normalized"))
    return _valid(_marked(df)).withColumn("n_same_normalized", same).where("n_same_normalized >= 2").orderBy(*KEY)


def diversity_distribution(per_prompt: DataFrame) -> DataFrame:
    return per_prompt.groupBy("model_key", "domain", "category", "replica_group_invalid", "n_valid", "n_unique_normalized").agg(F.count("*").alias("n_prompts"))


def han_passages(df: DataFrame, context: int = 50) -> DataFrame:
    """One row a run of Han characters: its number, 1-based first and last place, text, and the text around it."""
    g = F.col("generation")
    # what stands before each run, and the runs: with them, places add up
    before = F.split(g, r"\p{IsHan}+", -1)
    runs = F.regexp_extract_all(g, F.lit(r"(\p{IsHan}+)"), F.lit(1))
    base = df.where("audit_has_han").select("model_key", "prompt_id", "repetition", "domain", "category", "subject", g, before.alias("b"), runs.alias("r"))
    start = F.struct(F.array().cast("array<int>").alias("a"), F.lit(1).alias("at"))
    places = F.aggregate(
        F.sequence(F.lit(1), F.size("r")), start,
        lambda s, i: F.struct(F.concat(s["a"], F.array(s["at"] + F.length(F.element_at("b", i)))).alias("a"), (s["at"] + F.length(F.element_at("b", i)) + F.length(F.element_at("r", i))).alias("at")),
    )["a"]
    out = base.withColumn("p", places).select("*", F.posexplode("r").alias("i", "han_segment"))
    first = F.element_at("p", F.col("i") + 1)
    last = first + F.length("han_segment") - 1
    low = F.greatest(F.lit(1), first - context)
    return out.select("model_key", "prompt_id", "repetition", "domain", "category", "subject", (F.col("i") + 1).alias("segment_index"), first.alias("start_char"), last.alias("end_char"), "han_segment", F.substring(g, low, last + context - low + 1).alias("context"))


def review_sample(df: DataFrame, per_category: int = 5, seed: int = 42) -> DataFrame:
    """All models' rows for up to `per_category` keys of each category, drawn by a stable hash, with empty note columns."""
    keys = df.where("audit_status_ok").select("domain", "category", "prompt_id", "repetition").distinct()
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "prompt_id", F.col("repetition").cast("string")).cast("binary"))
    top = keys.withColumn("r", F.row_number().over(Window.partitionBy("domain", "category").orderBy(draw, "prompt_id", "repetition"))).where(F.col("r") <= per_category).drop("r")
    out = df.join(top, ["domain", "category", "prompt_id", "repetition"], "left_semi")
    return out.withColumns({c: F.lit("") for c in ("manual_language", "manual_coherence", "manual_notes")}).orderBy("domain", "category", "prompt_id", "repetition", "model_key")


def completeness(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Observed against expected records and repetitions by model; expected: model_key, expected_records, expected_repetitions."""
    seen = df.groupBy("model_key").agg(F.count("*").alias("observed_records"), F.max("repetition").alias("observed_repetitions"))
    out = seen.join(expected, "model_key", "full_outer")
    return out.select("model_key", F.coalesce("observed_records", F.lit(0)).alias("observed_records"), "expected_records", "observed_repetitions", "expected_repetitions", (F.coalesce("observed_records", F.lit(0)) == F.col("expected_records")).alias("complete"))
