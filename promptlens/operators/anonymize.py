"""Masking of identifying terms by dictionary.

The dictionary is built from the prompts' subjects and a configuration, never from continuations.
Its size follows the number of subjects, a label set, not the rows; the terms of each domain become
one pattern literal, which Spark compiles once. Base terms are masked first, then the terms that
belong to a single subject, on the text already masked.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T

PEOPLE = ("gender", "race")
#: A dictionary beyond this many terms does not become a pattern literal.
MOST_TERMS = 200_000
SUSPECT = ("known_nonperson_subject", "subject_not_recognized_as_profession")
DICTIONARY = "domain string, subject string, alias string, replacement string, source string, enabled boolean, review_reason string"


@dataclass(frozen=True)
class MaskingConfig:
    """What a masking run is told, besides the prompts."""

    version: str = "dictionary_v1"
    blocked_person_subjects: tuple[str, ...] = ()
    profession_heads: tuple[str, ...] = ()
    profession_extra_terms: tuple[str, ...] = ()
    religious_terms: tuple[str, ...] = ()
    political_terms: tuple[str, ...] = ()
    #: (domain, subject, alias)
    person_aliases: tuple[tuple[str, str, str], ...] = ()
    terms: dict[str, tuple[str, tuple[str, ...]]] = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        for domain, subject, alias in self.person_aliases:
            if domain not in PEOPLE or not subject or not alias:
                raise ValueError(f"bad person alias: {(domain, subject, alias)}")
        named = {"profession": ("configured_profession", self.profession_extra_terms), "religious_ideology": ("configured_religion", self.religious_terms), "political_ideology": ("configured_ideology", self.political_terms)}
        object.__setattr__(self, "terms", named)

    @classmethod
    def from_dict(cls, spec: dict) -> MaskingConfig:
        names = [f for f in cls.__dataclass_fields__ if f not in ("terms", "person_aliases", "version")]
        return cls(spec.get("version", "dictionary_v1"), **{n: tuple(spec.get(n, ())) for n in names}, person_aliases=tuple((a["domain"], a["subject"], a["alias"]) for a in spec.get("person_aliases", ())))


def profession_plural(term: Column) -> Column:
    """The regular plurals of names of professions."""
    ends = lambda p: term.rlike(f"(?i){p}$")
    swap = lambda p, by: F.regexp_replace(term, f"(?i){p}$", by)
    return (
        F.when(ends("midwife"), swap("wife", "wives"))
        .when(ends("man"), swap("man", "men"))
        .when(ends("[^aeiou]y"), swap("y", "ies"))
        .when(ends("(ch|sh|x|z)"), F.concat(term, F.lit("es")))
        .when(ends("s"), term)
        .otherwise(F.concat(term, F.lit("s")))
    )


def build_dictionary(df: DataFrame, config: MaskingConfig) -> DataFrame:
    """domain, subject, alias, replacement, source, enabled, review_reason."""
    missing = [c for c in ("domain", "subject", "prompt_id", "prompt") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    domain, subject = F.col("domain"), F.col("subject")
    people, job = domain.isin(*PEOPLE), domain == "profession"
    label = T.trimmed(F.replace(subject, F.lit("_"), F.lit(" ")))
    head = F.lower(F.regexp_extract(label, r"(?s)([^ -]*)$", 1))
    known, blocked = T.one_of(head, config.profession_heads), T.one_of(subject, config.blocked_person_subjects)
    subjects = df.select("domain", "subject").distinct()
    candidates = subjects.select(
        "domain", "subject", label.alias("alias"), F.when(people, "Person").otherwise("XYZ").alias("replacement"), F.lit("subject_label").alias("source"), ((people & ~blocked) | (job & known)).alias("enabled"),
        F.when(people & blocked, "known_nonperson_subject").when(job & ~known, "subject_not_recognized_as_profession").when(~people & ~job, "use_identifying_terms_not_entire_page_title").alias("review_reason"),
    )
    plurals = candidates.where(job & F.col("enabled")).withColumns({"alias": profession_plural(F.col("alias")), "source": F.lit("profession_plural")})
    fixed = [(d, "*", a, "XYZ", source, True, None) for d, (source, aliases) in config.terms.items() for a in aliases]
    fixed += [(d, s, a, "Person", "configured_person_alias", True, None) for d, s, a in config.person_aliases]
    if any(not r[2] or r[2] in ("Person", "XYZ") for r in fixed):
        raise ValueError("a term is empty or a placeholder")
    out = candidates.unionByName(plurals).unionByName(df.sparkSession.createDataFrame(fixed, DICTIONARY)).distinct()
    bad = F.col("alias").isNull() | (F.col("alias") == "") | (F.col("enabled") & F.col("alias").isin("Person", "XYZ"))
    return out.withColumn("alias", F.when(bad, F.raise_error(F.concat(F.lit("bad alias for "), subject))).otherwise(F.col("alias")))


def terms_by_domain(dictionary: DataFrame) -> tuple[dict[str, list[str]], dict[str, dict[str, list[str]]]]:
    """Enabled terms of each domain, and those of single subjects; a dictionary too large for patterns is an error."""
    rows = dictionary.where("enabled").select("domain", "subject", "alias", "source").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: mask by spans instead")
    base, own = {}, {}
    for r in rows:
        if r.source == "configured_person_alias":
            own.setdefault(r.domain, {}).setdefault(r.subject, []).append(r.alias)
        else:
            base.setdefault(r.domain, []).append(r.alias)
    return base, own


def _masked(df: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """Apply (who, pattern, placeholder) rules that exclude each other to both texts, and count."""
    if not rules:
        return df

    def chain(value, default):
        return reduce(lambda done, r: done.when(r[0], value(r)) if done is not None else F.when(r[0], value(r)), rules, None).otherwise(default)

    text, prompt = F.col("text_anonymized"), F.col("prompt_anonymized")
    return df.withColumns(
        {
            "anonymization_n_replacements": F.col("anonymization_n_replacements") + chain(lambda r: T.count(text, r[1]), F.lit(0)),
            "anonymization_n_prompt_replacements": F.col("anonymization_n_prompt_replacements") + chain(lambda r: T.count(prompt, r[1]), F.lit(0)),
            "anonymization_matches": F.concat(F.col("anonymization_matches"), chain(lambda r: F.regexp_extract_all(text, F.lit(r[1]), F.lit(0)), F.array().cast("array<string>"))),
            "text_anonymized": chain(lambda r: F.regexp_replace(text, r[1], r[2]), text),
            "prompt_anonymized": chain(lambda r: F.regexp_replace(prompt, r[1], r[2]), prompt),
        }
    )


def residual_name(subject: Column, masked: Column) -> Column:
    """Whether a person's last name, as written, still stands in the masked text."""
    label = F.regexp_replace(F.replace(subject, F.lit("_"), F.lit(" ")), r" (Jr\.?|Sr\.?|II|III|IV)$", "")
    name = F.regexp_extract(label, r"(?s)([^ ]*)$", 1)
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+\-?^$|&~#])", r"\\$1")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?![\p{L}\p{N}_])"))
    return (F.length(name) >= 3) & ~name.isin("Person", "XYZ") & F.regexp_like(masked, pattern)


def review_columns(df: DataFrame, suspects: DataFrame, extra: tuple[tuple[Column, str], ...] = ()) -> DataFrame:
    """anonymization_review_required, its first reason, and who stays eligible."""
    known = suspects.where(F.col("review_reason").isin(*SUSPECT)).select(F.col("domain").alias("__d"), F.col("subject").alias("__s")).distinct()
    out = df.join(known, (F.col("domain") == F.col("__d")) & (F.col("subject") == F.col("__s")), "left")
    ready = F.col("text_preparation_status") == "prepared"
    open_, off = F.col("__d").isNotNull(), F.col("anonymization_status") != "applied"
    residual = F.col("anonymization_residual_name_candidate")
    needed = reduce(lambda a, x: a | x[0], extra, open_ | off | residual)
    reason = F.when(~ready, F.lit(None)).when(open_, "subject_entity_type_unverified")
    for condition, name in extra:
        reason = reason.when(condition, name)
    reason = reason.when(off, F.col("anonymization_status")).when(residual, "residual_target_name_candidate")
    out = out.withColumns({"anonymization_review_required": ready & needed, "anonymization_review_reason": reason}).drop("__d", "__s")
    return out.withColumn("eligible_anonymized_metrics", F.col("eligible_english_metrics") & (F.col("anonymization_status") == "applied") & ~F.col("anonymization_review_required"))


def mask_texts(df: DataFrame, dictionary: DataFrame, version: str) -> DataFrame:
    """Prepared texts with their terms masked: Person for people, XYZ elsewhere; counts, status, review."""
    missing = [c for c in ("text_full", "text_preparation_status", "domain", "subject", "prompt", "eligible_english_metrics") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if "text_anonymized" in df.columns or "anonymization_status" in df.columns:
        raise ValueError("already masked")
    base, own = terms_by_domain(dictionary)
    ready = F.col("text_preparation_status") == "prepared"
    zero = F.when(ready, 0)
    df = df.withColumns({"text_anonymized": F.col("text_full"), "prompt_anonymized": F.col("prompt"), "anonymization_policy": F.lit(version), "anonymization_n_replacements": zero, "anonymization_n_prompt_replacements": zero, "anonymization_matches": F.array().cast("array<string>")})
    name = lambda d: "Person" if d in PEOPLE else "XYZ"
    df = _masked(df, [(ready & (F.col("domain") == d), T.alias_pattern(a), name(d)) for d, a in sorted(base.items())])
    df = _masked(df, [(ready & (F.col("domain") == d) & (F.col("subject") == s), T.alias_pattern(a), name(d)) for d, each in sorted(own.items()) for s, a in sorted(each.items())])
    status = F.when(~ready, "not_prepared").when(F.col("anonymization_n_replacements") == 0, "no_dictionary_match").when(F.col("anonymization_n_prompt_replacements") == 0, "no_prompt_match").otherwise("applied")
    residual = T.flag(ready & F.col("domain").isin(*PEOPLE) & residual_name(F.col("subject"), F.col("text_anonymized")))
    df = df.withColumns({"anonymization_status": status, "anonymization_residual_name_candidate": residual})
    return review_columns(df, dictionary)


def replacement_counts(masked: DataFrame) -> DataFrame:
    """How often each term was replaced, by domain."""
    name = F.when(F.col("domain").isin(*PEOPLE), "Person").otherwise("XYZ")
    return masked.select("domain", F.explode("anonymization_matches").alias("matched_text"), name.alias("replacement")).groupBy("domain", "matched_text", "replacement").agg(F.count("*").alias("n_replacements"))


def masking_summary(masked: DataFrame) -> DataFrame:
    """Rows prepared, changed, under review and eligible by model and domain."""
    return masked.groupBy("model_key", "domain").agg(
        F.count("*").alias("n_records"),
        F.count_if(F.col("text_preparation_status") == "prepared").alias("n_prepared"),
        F.count_if(F.col("text_anonymized") != F.col("text_full")).alias("n_changed"),
        F.sum("anonymization_n_replacements").alias("n_replacements"),
        F.count_if("anonymization_review_required").alias("n_review"),
        F.count_if("eligible_anonymized_metrics").alias("n_eligible"),
    )


def masking_sample(masked: DataFrame, n: int = 3) -> DataFrame:
    """All models' first repetition of the first n prompts of each (domain, category, status)."""
    stratum = ("domain", "category", "anonymization_status")
    keys = masked.select(*stratum, "prompt_id").distinct()
    first = keys.withColumn("r", F.row_number().over(Window.partitionBy(*stratum).orderBy("prompt_id"))).where(F.col("r") <= n).select("prompt_id").distinct()
    kept = "model_key prompt_id repetition domain category subject prompt generation text_full text_anonymized anonymization_status anonymization_n_replacements anonymization_review_required anonymization_review_reason eligible_anonymized_metrics".split()
    return masked.where("repetition = 1").join(first, "prompt_id", "left_semi").select(*kept).orderBy("domain", "category", "prompt_id", "model_key")
