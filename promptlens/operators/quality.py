"""Prompt audit: flags for technical errors and for review, and the summaries over them.

Flags are never null: a null prompt is `is_prompt_missing` and false elsewhere. No row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T
from promptlens.operators.cleaning import INVISIBLE, MARKUP

BASE = ("dominio", "categoria", "entita", "prompt")
#: Flags by what they ask for, in report order.
FLAGS = {
    "errore_tecnico": ("is_prompt_missing", "is_prompt_vuoto", "ha_markup", "ha_tab", "ha_newline", "ha_carriage_return", "ha_caratteri_controllo", "ha_unicode_invisibile"),
    "revisione_manuale": ("ha_doppio_spazio", "spazio_prima_punteggiatura", "ha_spazio_iniziale", "parentesi_round_sbilanciate", "parentesi_quadre_sbilanciate", "virgolette_sbilanciate"),
    "informativo": ("ha_non_ascii", "ha_spazio_finale"),
    "sintesi": ("flag_errore_tecnico", "flag_revisione_manuale"),
}


def check_schema(df: DataFrame) -> DataFrame:
    """The prompt columns must be there, as text."""
    missing = [c for c in BASE if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    other = [c for c in BASE if df.schema[c].dataType.simpleString() != "string"]
    if other:
        raise ValueError(f"not text: {', '.join(other)}")
    return df


def _same(*columns: str) -> Column:
    return F.count("*").over(Window.partitionBy(*columns)) > 1


def add_quality_flags(df: DataFrame) -> DataFrame:
    """Twenty-two columns after the prompt's four."""
    check_schema(df)
    p = F.col("prompt")
    df = df.withColumns(
        {
            "prompt_normalizzato_audit": T.normalized(p),
            "is_prompt_missing": p.isNull(),
            "is_prompt_vuoto": T.flag(T.blank(p)),
            "ha_markup": T.flag(T.matches(p, MARKUP)),
            "ha_tab": T.flag(p.contains("\t")),
            "ha_newline": T.flag(p.contains("\n")),
            "ha_carriage_return": T.flag(p.contains("\r")),
            "ha_unicode_invisibile": T.flag(T.matches(p, INVISIBLE)),
            "ha_doppio_spazio": T.flag(p.contains("  ")),
            "spazio_prima_punteggiatura": T.flag(T.matches(p, " [.,;:!?]")),
            "ha_spazio_iniziale": T.flag(p.startswith(" ")),
            "ha_spazio_finale": T.flag(T.matches(p, " $")),
            "ha_non_ascii": T.flag(T.matches(p, r"[^\x00-\x7F]")),
            "parentesi_round_sbilanciate": T.flag(T.unbalanced(p, "(", ")")),
            "parentesi_quadre_sbilanciate": T.flag(T.unbalanced(p, "[", "]")),
            "virgolette_sbilanciate": T.flag(T.odd_quotes(p)),
        }
    )
    valid = F.col("prompt_normalizzato_audit").isNotNull() & (F.col("prompt_normalizzato_audit") != "")
    df = df.withColumns(
        {
            "ha_caratteri_controllo": F.col("ha_tab") | F.col("ha_newline") | F.col("ha_carriage_return"),
            "is_duplicato_esatto": p.isNotNull() & _same("prompt"),
            "is_duplicato_normalizzato": T.flag(valid & _same("prompt_normalizzato_audit")),
            "is_riga_duplicata": _same(*BASE),
        }
    )
    return df.withColumns({"flag_errore_tecnico": T.any_of(F.col(c) for c in FLAGS["errore_tecnico"]), "flag_revisione_manuale": T.any_of(F.col(c) for c in FLAGS["revisione_manuale"])})


def flagged(df: DataFrame, summary: str, details: tuple[str, ...]) -> DataFrame:
    """Rows with a summary flag: the prompt's columns and the detailed flags."""
    missing = [c for c in (*BASE, summary, *details) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.where(F.col(summary)).select(*BASE, *details)


def technical_errors(df: DataFrame) -> DataFrame:
    return flagged(df, "flag_errore_tecnico", FLAGS["errore_tecnico"])


def manual_review(df: DataFrame) -> DataFrame:
    return flagged(df, "flag_revisione_manuale", FLAGS["revisione_manuale"])


def dataset_summary(audited: DataFrame, raw_columns: int = len(BASE)) -> DataFrame:
    """Rows, columns and distinct values; nulls are no value, and the empty normal form is none either."""
    norm = F.col("prompt_normalizzato_audit")
    return audited.agg(
        F.count("*").alias("n_righe"),
        F.lit(raw_columns).alias("n_colonne_originali"),
        F.lit(len(audited.columns)).alias("n_colonne_dopo_audit"),
        F.countDistinct("dominio").alias("n_domini"),
        F.countDistinct("dominio", "categoria").alias("n_categorie"),
        F.countDistinct("entita").alias("n_entita"),
        F.countDistinct("prompt").alias("n_prompt_unici_esatti"),
        F.countDistinct(F.when(norm != "", norm)).alias("n_prompt_unici_normalizzati"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """One row a column: nulls, their percentage (3 places), blank texts (null for other types)."""
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggs += [F.count_if(c.isNull()).alias(f"m{i}"), (F.count_if(T.blank(c)) if f.dataType.simpleString() == "string" else F.lit(None).cast("long")).alias(f"b{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(f.name).alias("colonna"), F.col(f"m{i}").alias("n_missing"), F.round(100 * F.col(f"m{i}") / F.nullif("n", F.lit(0)), 3).alias("pct_missing"), F.col(f"b{i}").alias("n_stringhe_vuote")) for i, f in enumerate(df.schema)))
    return one.select(F.inline(rows))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("dominio", "categoria").agg(F.count("*").alias("n_prompt")).orderBy("dominio", F.desc("n_prompt"))


def length_summary(df: DataFrame) -> DataFrame:
    n = T.word_count("prompt")
    out = df.groupBy("dominio").agg(
        F.count("*").alias("n_prompt"),
        F.count(n).alias("n_prompt_non_missing"),
        F.count_if(T.blank("prompt")).alias("n_prompt_vuoti"),
        F.min(n).alias("lunghezza_min_parole"),
        F.max(n).alias("lunghezza_max_parole"),
        F.avg(n).alias("lunghezza_media_parole"),
    )
    return out.orderBy(F.desc("n_prompt"))


def check_domains(df: DataFrame, expected: list[str]) -> DataFrame:
    """Expected and present domains, each OK, MANCANTE or INATTESO."""
    wanted = df.sparkSession.createDataFrame([(d,) for d in dict.fromkeys(expected)], "dominio string").withColumn("atteso", F.lit(True))
    there = df.where(F.col("dominio").isNotNull()).select("dominio").distinct().withColumn("presente", F.lit(True))
    out = wanted.join(there, "dominio", "full_outer").select("dominio", F.coalesce("atteso", F.lit(False)).alias("atteso"), F.coalesce("presente", F.lit(False)).alias("presente"))
    return out.withColumn("stato", F.when(F.col("atteso") & F.col("presente"), "OK").when(F.col("atteso"), "MANCANTE").otherwise("INATTESO"))


def category_variants(df: DataFrame) -> DataFrame:
    """Names of categories that differ only in case or white space."""
    some = df.where(F.col("categoria").isNotNull() & ~T.blank("categoria")).withColumn("categoria_normalizzata", T.normalized("categoria"))
    # distinct first: a group then holds spellings, not rows
    some = some.select("dominio", "categoria_normalizzata", "categoria").distinct()
    out = some.groupBy("dominio", "categoria_normalizzata").agg(F.count("*").alias("n_varianti"), F.array_join(F.array_sort(F.collect_list("categoria")), " | ").alias("varianti"))
    return out.where("n_varianti > 1")


def flag_summary(audited: DataFrame) -> DataFrame:
    """One row a flag in report order: class, rows, percentage (3 places)."""
    named = [(k, c) for k, cs in FLAGS.items() for c in cs]
    one = audited.agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(c) for _, c in named))
    rows = F.array(*(F.struct(F.lit(c).alias("controllo"), F.lit(k).alias("classe"), F.col(c).alias("n_prompt"), F.round(100 * F.col(c) / F.nullif("n", F.lit(0)), 3).alias("percentuale")) for k, c in named))
    return one.select(F.inline(rows))


def duplicate_summary(audited: DataFrame) -> DataFrame:
    """Rows in duplicates and groups of them."""
    norm = "prompt_normalizzato_audit"
    one = audited.agg(
        F.count_if("is_riga_duplicata").alias("righe_completamente_duplicate"),
        F.count_if("is_duplicato_esatto").alias("righe_in_prompt_duplicati_esatti"),
        F.countDistinct(F.when(F.col("is_duplicato_esatto"), F.col("prompt"))).alias("gruppi_prompt_duplicati_esatti"),
        F.count_if("is_duplicato_normalizzato").alias("righe_in_prompt_duplicati_normalizzati"),
        F.countDistinct(F.when(F.col("is_duplicato_normalizzato"), F.col(norm))).alias("gruppi_prompt_duplicati_normalizzati"),
    )
    return one.unpivot([], one.columns, "tipo", "valore")


def technical_summary(audited: DataFrame) -> DataFrame:
    """Technical problems with their percentage of all prompts (3 places)."""
    named = {"prompt_missing": "is_prompt_missing", "prompt_vuoto": "is_prompt_vuoto", "markup": "ha_markup", "tab": "ha_tab", "newline": "ha_newline", "carriage_return": "ha_carriage_return", "unicode_invisibile": "ha_unicode_invisibile", "almeno_un_errore_tecnico": "flag_errore_tecnico"}
    one = audited.agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(k) for k, c in named.items()))
    rows = F.array(*(F.struct(F.lit(k).alias("problema"), F.col(k).alias("n_prompt"), F.round(100 * F.col(k) / F.nullif("n", F.lit(0)), 3).alias("percentuale")) for k in named))
    return one.select(F.inline(rows))
