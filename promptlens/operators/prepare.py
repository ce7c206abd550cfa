"""Texts for scoring: prompt and continuation joined, and who may be scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.functions import text as T

HAN_POLICY = "exclude_any_han_v1"


def _once(df: DataFrame, *columns: str) -> None:
    again = [c for c in columns if c in df.columns]
    if again:
        raise ValueError(f"already prepared: {', '.join(again)}")


def _need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def prepare_texts(df: DataFrame) -> DataFrame:
    """text_preparation_status, the first problem in a fixed order, and text_full, null unless prepared.

    Prompt and continuation meet without a separator.
    """
    _need(df, "prompt", "generation", "status")
    _once(df, "text_full", "text_preparation_status")
    nul = T.flag(F.col("audit_nul_in_metric_text")) if "audit_nul_in_metric_text" in df.columns else F.lit(False)
    status = (
        F.when(~T.flag(F.col("status") == "ok"), "generation_status_not_ok")
        .when(nul, "nul_in_metric_text")
        .when(F.col("prompt").isNull(), "missing_prompt")
        .when(T.blank("prompt"), "empty_prompt")
        .when(F.col("generation").isNull(), "missing_generation")
        .when(T.blank("generation"), "empty_generation")
        .otherwise("prepared")
    )
    df = df.withColumn("text_preparation_status", status)
    return df.withColumn("text_full", F.when(F.col("text_preparation_status") == "prepared", F.concat("prompt", "generation")))


def apply_han_policy(df: DataFrame) -> DataFrame:
    """Who is eligible for English metrics: prepared and without any Han character. A null flag is an error."""
    _need(df, "text_preparation_status", "audit_has_han")
    _once(df, "eligible_english_metrics", "exclusion_reason")
    han = F.coalesce(F.col("audit_has_han"), F.raise_error(F.lit("audit_has_han is null")).cast("boolean"))
    ready = F.col("text_preparation_status") == "prepared"
    return df.withColumns(
        {
            "language_policy": F.lit(HAN_POLICY),
            "eligible_english_metrics": ready & ~han,
            "language_review_required": ready & han,
            "exclusion_reason": F.when(~ready, F.col("text_preparation_status")).when(han, "han_pending_review"),
        }
    )


def coverage(df: DataFrame, groups: tuple[str, ...] = ("model_key",)) -> DataFrame:
    """Prepared, excluded and eligible rows; percentages of the prepared, null without any."""
    ready = F.col("text_preparation_status") == "prepared"
    out = df.groupBy(*groups).agg(F.count("*").alias("n_records"), F.count_if(ready).alias("n_prepared"), F.count_if("language_review_required").alias("n_excluded_han"), F.count_if("eligible_english_metrics").alias("n_eligible"))
    share = lambda c: 100 * F.col(c) / F.nullif("n_prepared", F.lit(0))
    return out.withColumns({"pct_excluded_han_prepared": share("n_excluded_han"), "pct_eligible_prepared": share("n_eligible")})


def preparation_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("model_key", "domain", "category", "text_preparation_status").agg(F.count("*").alias("n"))
