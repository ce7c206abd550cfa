"""Diagnostics of line breaks inside prompts. Nulls stay null; nothing is repaired in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T

DETAILS = (
    "id_riga_originale dominio categoria entita tipo_newline n_newline posizioni_newline newline_iniziale newline_finale newline_consecutivi spazio_prima_newline spazio_dopo_newline "
    "ha_tab ha_carriage_return ha_markup is_duplicato_esatto is_duplicato_normalizzato lunghezza_originale lunghezza_candidata candidata_diversa prompt prompt_visibile prompt_candidato_whitespace"
).split()


def newline_kind(prompt: Column, n: Column) -> Column:
    """Where a prompt's line breaks stand; the first class that fits."""
    at_start, at_end = prompt.startswith("\n"), prompt.endswith("\n")
    return (
        F.when(n == 0, "nessun_newline")
        .when(T.matches(prompt, r"\A\n+\z"), "solo_newline")
        .when(at_start & at_end, "iniziale_e_finale")
        .when(at_start, "iniziale")
        .when(at_end, "finale")
        .when(prompt.contains("\n\n"), "interno_consecutivo")
        .when(n == 1, "interno_singolo")
        .when(n > 1, "interno_multiplo")
        .otherwise("altro")
    )


def only_whitespace_changed(c: Column) -> Column:
    return T.squished(F.regexp_replace(c, r"\r\n|\r|\n|\t", " "))


def newline_details(audited: DataFrame) -> DataFrame:
    """The prompts with line breaks, by id_riga_originale, with where and how they break."""
    p = F.col("prompt")
    df = audited.where("ha_newline").withColumns(
        {
            "n_newline": T.count_literal(p, "\n"),
            "posizioni_newline": T.positions(p, "\n"),
            "newline_iniziale": p.startswith("\n"),
            "newline_finale": p.endswith("\n"),
            "newline_consecutivi": p.contains("\n\n"),
            "spazio_prima_newline": p.contains(" \n"),
            "spazio_dopo_newline": p.contains("\n "),
            "lunghezza_originale": F.length(p),
            "prompt_visibile": T.visible(p),
            "prompt_candidato_whitespace": only_whitespace_changed(p),
        }
    )
    df = df.withColumns({"tipo_newline": newline_kind(p, F.col("n_newline")), "lunghezza_candidata": F.length("prompt_candidato_whitespace"), "candidata_diversa": p != F.col("prompt_candidato_whitespace")})
    return df.select(*DETAILS).orderBy("dominio", "categoria", "id_riga_originale")


def by_kind(details: DataFrame) -> DataFrame:
    return details.groupBy("tipo_newline").agg(F.count("*").alias("n_prompt"))


def by_domain_kind(details: DataFrame) -> DataFrame:
    """Counts with their share of the domain's prompts that have line breaks."""
    out = details.groupBy("dominio", "tipo_newline").agg(F.count("*").alias("n_prompt"))
    return out.withColumn("percentuale_nel_dominio", F.round(100 * F.col("n_prompt") / F.sum("n_prompt").over(Window.partitionBy("dominio")), 3))


def by_category_kind(details: DataFrame) -> DataFrame:
    return details.groupBy("dominio", "categoria", "tipo_newline").agg(F.count("*").alias("n_prompt"))


def unchanged(raw: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """Rows that were lost, added or whose prompt was changed; empty if the audit kept all."""
    a, b = raw.select(F.col(key).alias("k"), F.col("prompt").alias("x")), audited.select(F.col(key).alias("k"), F.col("prompt").alias("y"))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full_outer")
    return both.where(F.col("l").isNull() | F.col("r").isNull() | ~F.col("x").eqNullSafe(F.col("y"))).select(F.col("k").alias(key))
