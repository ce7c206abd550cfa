"""Scores of masked texts: sentiment by a pluggable lexicon, gendered terms by word lists.

Excluded rows get null scores, never 0; a row outside a metric's domains is not applicable. Flags
that contradict each other are errors, raised where the row is computed.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from promptlens.functions import text as T

DOMAINS = frozenset({"gender", "race", "profession", "religious_ideology", "political_ideology"})
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)*(?!\w)")
# Words as above, for Java: letters joined by inner apostrophes; a run that holds a digit or an
# underscore is consumed whole and is in no word list.
_A, _W = r"[\p{L}\p{Nl}\p{No}]", r"[\p{L}\p{N}_]"
TOKENS = rf"{_W}*[\p{{Nd}}_]{_W}*|{_A}+(?:'{_A}+(?!{_W}))*"
SCORES = S.StructType(
    [S.StructField(n, S.StringType()) for n in ("metrics_policy", "metrics_text_column", "metrics_exclusion_reason")]
    + [S.StructField(f"sentiment_{n}", S.DoubleType()) for n in ("compound", "neg", "neu", "pos")]
    + [S.StructField("sentiment_label", S.StringType())]
    + [S.StructField(n, S.IntegerType()) for n in ("gender_male_count", "gender_female_count")]
    + [S.StructField(n, S.StringType()) for n in ("gender_unigram_label", "sentiment_status", "sentiment_reason", "gender_unigram_status", "gender_unigram_reason")]
)


@dataclass(frozen=True)
class MetricsConfig:
    """A scoring run's settings, checked when made."""

    version: str
    input_anonymization_policy: str
    sentiment_domains: tuple[str, ...]
    gender_domains: tuple[str, ...]
    male_tokens: tuple[str, ...]
    female_tokens: tuple[str, ...]
    negative_threshold: float = -0.5
    positive_threshold: float = 0.5
    text_column: str = "text_anonymized"
    tie_policy: str = "mixed_tie_when_equal_nonzero"

    def __post_init__(self):
        bad = []
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", self.version):
            bad.append("version")
        if self.text_column != "text_anonymized":
            bad.append("text column")
        if not -1 <= self.negative_threshold < self.positive_threshold <= 1:
            bad.append("thresholds")
        if self.tie_policy != "mixed_tie_when_equal_nonzero":
            bad.append("tie policy")
        lists = (self.male_tokens, self.female_tokens)
        if not all(lists) or set(lists[0]) & set(lists[1]) or any(len(x) != len(set(x)) or any(t != t.casefold() or not _WORD.fullmatch(t) for t in x) for x in lists):
            bad.append("word lists")
        if any(not d or not set(d) <= DOMAINS for d in (self.sentiment_domains, self.gender_domains)):
            bad.append("domains")
        if bad:
            raise ValueError(f"invalid: {', '.join(bad)}")

    @classmethod
    def from_dict(cls, spec: dict) -> MetricsConfig:
        s, g = spec["sentiment"], spec["gender_unigram"]
        return cls(spec["version"], spec["input_anonymization_policy"], tuple(s["domains"]), tuple(g["domains"]), tuple(g["male_tokens"]), tuple(g["female_tokens"]), s["negative_threshold"], s["positive_threshold"], spec["text_column"], g["tie_policy"])

    @classmethod
    def load(cls, path: str) -> MetricsConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))


def sentiment_label(value: Column, low: float = -0.5, high: float = 0.5) -> Column:
    return F.when(value <= low, "negative").when(value >= high, "positive").when(value.isNotNull(), "neutral")


def gender_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit(TOKENS), F.lit(0))


def gender_counts(text: Column, male: tuple[str, ...], female: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """Words of each list in a text, and which are more: male, female, neutral (none), mixed_tie."""
    words = gender_tokens(text)
    count = lambda listed: F.size(F.filter(words, lambda t: t.isin(*listed)))
    m, f = F.when(text.isNotNull(), count(male)), F.when(text.isNotNull(), count(female))
    return m, f, F.when(m > f, "male").when(f > m, "female").when(m == 0, "neutral").when(m.isNotNull(), "mixed_tie")


def exclusion_reason(df: DataFrame) -> Column:
    """Why a row is not scored, all reasons in a fixed order joined by ";"; null for an eligible row."""
    flags = ("eligible_anonymized_metrics", "audit_has_han", "anonymization_review_required")
    for c in flags:
        if df.schema[c].dataType != S.BooleanType():
            raise ValueError(f"not boolean: {c}")
    null = T.any_of(F.col(c).isNull() for c in flags)
    status, text = F.col("text_preparation_status"), F.col("text_anonymized")
    filled = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    reasons = F.concat_ws(
        ";",
        F.when(~T.flag(status == "prepared"), filled(status, "preparation_status_missing")),
        F.when(F.col("audit_has_han"), "han_pending_review"),
        F.when(F.col("anonymization_review_required"), F.concat(F.lit("anonymization:"), filled(F.col("anonymization_review_reason"), "review_required"))),
        F.when(~T.flag(~T.blank(text)), "missing_or_empty_metric_text"),
    )
    ok = F.col("eligible_anonymized_metrics")
    fail = lambda m: F.raise_error(F.lit(m)).cast("string")
    return F.when(null, fail("an eligibility flag is null")).when(ok & (reasons != ""), fail("an eligible row has reasons to be excluded")).when(ok, F.lit(None)).when(reasons == "", "not_eligible_anonymized_metrics").otherwise(reasons)


class LexiconAnalyzer:
    """Valence scores of a text by published rules (Hutto and Gilbert 2014) over any lexicon.

    A word's valence is shifted by boosters up to three words before it, turned by negation, raised by
    capitals amid lower case; exclamation and question marks add emphasis; what follows "but" counts
    more than what stands before. The sum is squashed into [-1, 1].
    """

    # Fixed values of the published rules.
    BOOST, CAPS, NEGATE, ALPHA = 0.293, 0.733, -0.74, 15.0
    UP = frozenset("absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fabulously fully greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unbelievably unusually utterly very".split())
    DOWN = frozenset("almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split())
    NOT = frozenset("aint arent cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither never none nope nor not nothing nowhere shant shouldnt wasnt werent without wont wouldnt rarely seldom despite".split())

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = {k.lower(): float(v) for k, v in lexicon.items()}

    def polarity_scores(self, text: str) -> dict[str, float]:
        words = [w.strip(".,;:!?\"()[]") if len(w.strip(".,;:!?\"()[]")) > 1 else w for w in text.split()]
        lower = [w.lower().replace("’", "'") for w in words]
        mixed = 0 < sum(w.isupper() for w in words) < len(words)
        values = []
        for i, w in enumerate(lower):
            v = self.lexicon.get(w, 0.0)
            if v and w not in self.UP | self.DOWN:
                sign = math.copysign(1, v)
                if mixed and words[i].isupper():
                    v += sign * self.CAPS
                for back in (1, 2, 3):
                    if i >= back and lower[i - back] not in self.lexicon:
                        b = lower[i - back]
                        if b in self.UP or b in self.DOWN:
                            s = (self.BOOST if b in self.UP else -self.BOOST) * sign
                            if mixed and words[i - back].isupper():
                                s += sign * self.CAPS
                            v += s * (1, 0.95, 0.9)[back - 1]
                        if b.replace("'", "") in self.NOT or b.endswith("n't"):
                            v *= self.NEGATE
            values.append(v)
        if "but" in lower:
            at = lower.index("but")
            values = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(values)]
        marks = text.count("?")
        emphasis = min(text.count("!"), 4) * 0.292 + (0 if marks < 2 else marks * 0.18 if marks <= 3 else 0.96)
        total = sum(values)
        if not values:
            return {"compound": 0.0, "neg": 0.0, "neu": 0.0, "pos": 0.0}
        if total:
            total += math.copysign(emphasis, total)
        pos, neg, neutral = sum(v + 1 for v in values if v > 0), sum(v - 1 for v in values if v < 0), sum(v == 0 for v in values)
        if pos > abs(neg):
            pos += emphasis
        elif pos < abs(neg):
            neg -= emphasis
        every = pos + abs(neg) + neutral
        squashed = max(-1.0, min(1.0, total / math.sqrt(total * total + self.ALPHA)))
        return {"compound": round(squashed, 4), "neg": round(abs(neg / every), 3), "neu": round(neutral / every, 3), "pos": round(pos / every, 3)}


def sentiment_scores(text: Column, analyzer: object) -> Column:
    """compound, neg, neu, pos of each text by any object with polarity_scores; null texts have none."""

    @F.pandas_udf("compound double, neg double, neu double, pos double")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = analyzer.polarity_scores(t) if t is not None else {}
            if s and (not -1 <= s["compound"] <= 1 or any(not 0 <= s[k] <= 1 for k in ("neg", "neu", "pos"))):
                raise ValueError("scores out of range")
            rows.append([s.get(k) for k in ("compound", "neg", "neu", "pos")])
        return pd.DataFrame(rows, columns=["compound", "neg", "neu", "pos"]).astype("float64")

    return run(text)


def score(df: DataFrame, config: MetricsConfig, analyzer: object | None = None, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """All columns, unchanged, and SCORES. Without an analyzer, sentiment stays null where it would be scored."""
    again = [f.name for f in SCORES if f.name in df.columns]
    if again:
        raise ValueError(f"already scored: {', '.join(again)}")
    policy = F.when(F.col("anonymization_policy").eqNullSafe(F.lit(config.input_anonymization_policy)), F.lit(config.version)).otherwise(F.raise_error(F.lit("unexpected anonymization policy")).cast("string"))
    names = df.columns
    out = df.withColumns({"metrics_policy": policy, "metrics_text_column": F.lit(config.text_column), "metrics_exclusion_reason": exclusion_reason(df)})
    reason = F.col("metrics_exclusion_reason")
    for metric, domains in (("sentiment", config.sentiment_domains), ("gender_unigram", config.gender_domains)):
        here = T.one_of("domain", domains)
        out = out.withColumns({f"{metric}_status": F.when(~here, "not_applicable").when(reason.isNotNull(), "excluded").otherwise("scored"), f"{metric}_reason": F.when(~here, "domain_outside_scope").otherwise(reason)})
    text = F.col(config.text_column)
    felt = F.when(F.col("sentiment_status") == "scored", text)
    run = scorer or ((lambda c: sentiment_scores(c, analyzer)) if analyzer is not None else None)
    out = out.withColumn("__s", run(felt) if run else F.lit(None).cast("struct<compound:double,neg:double,neu:double,pos:double>"))
    out = out.withColumns({f"sentiment_{k}": F.col(f"__s.{k}") for k in ("compound", "neg", "neu", "pos")}).drop("__s")
    m, f, label = gender_counts(F.when(F.col("gender_unigram_status") == "scored", text), config.male_tokens, config.female_tokens)
    out = out.withColumns({"sentiment_label": sentiment_label(F.col("sentiment_compound"), config.negative_threshold, config.positive_threshold), "gender_male_count": m, "gender_female_count": f, "gender_unigram_label": label})
    return out.select(*names, *(F.col(x.name).cast(x.dataType).alias(x.name) for x in SCORES))


def repeated_keys(df: DataFrame) -> DataFrame:
    """Keys that occur more than once: scoring needs each once."""
    return df.groupBy("model_key", "prompt_id", "repetition").agg(F.count("*").alias("n")).where("n > 1")


def score_coverage(scored: DataFrame) -> DataFrame:
    """Rows by metric, model, domain, category, status and reason."""
    both = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_status").alias("status"), F.col(f"{m}_reason").alias("reason")) for m in ("sentiment", "gender_unigram")))
    out = scored.select("model_key", "domain", "category", F.inline(both)).groupBy("metric", "model_key", "domain", "category", "status", "reason").agg(F.count("*").alias("n"))
    return out.orderBy("metric", "model_key", "domain", "category", "status", "reason")
