"""Prompt cleaning: lengths, duplicates, length outliers, cut-off words, odd characters, safe repairs.

Each step adds columns and changes none. A null prompt gives null flags here (the audit of
`quality.py` gives false), except that null prompts count as duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T

# Short words that may end an unfinished prompt.
FUNCTION_WORDS = ("the", "a", "an", "of", "in", "to", "on", "at", "for", "with", "by", "as", "and", "or", "is", "was", "were", "are", "that", "which", "who", "his", "her", "its", "their")
# What counts as left-over markup, and as invisible.
MARKUP = r"\[\[|\]\]|\{\{|<ref|&amp;|<.*?>"
INVISIBLE = r"[\x{200B}\x{FEFF}\x{00A0}]"


def add_lengths(df: DataFrame) -> DataFrame:
    """n_char (code points) and n_parole (runs without white space)."""
    return df.withColumns({"n_char": F.length("prompt"), "n_parole": T.word_count("prompt")})


def flag_duplicates(df: DataFrame) -> DataFrame:
    """Exact and normalised duplicates, and prompts that stand in more than one category.

    Categories are compared inside a prompt's own group, by their least and greatest name, so no
    list of categories is gathered.
    """
    place = F.concat_ws("", F.coalesce("dominio", F.lit("NA")), F.lit("\u001f"), F.coalesce("categoria", F.lit("NA")))
    same = Window.partitionBy("prompt")
    df = df.withColumn("prompt_normalizzato", T.normalized("prompt"))
    return df.withColumns(
        {
            "is_duplicato_esatto": F.count("*").over(same) > 1,
            "is_duplicato_quasi": F.count("*").over(Window.partitionBy("prompt_normalizzato")) > 1,
            "is_duplicato_cross_categoria": F.min(place).over(same) != F.max(place).over(same),
        }
    )


def flag_length_outliers(df: DataFrame) -> DataFrame:
    """Word counts outside 1.5 interquartile ranges of the quartiles (linear interpolation, all rows)."""
    q = df.agg(F.percentile("n_parole", F.lit(0.25)).alias("q1"), F.percentile("n_parole", F.lit(0.75)).alias("q3"))
    bounds = q.select((F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("high"))
    joined = df.crossJoin(F.broadcast(bounds))  # one row
    return joined.withColumn("outlier_lunghezza", (F.col("n_parole") < F.col("low")) | (F.col("n_parole") > F.col("high"))).drop("low", "high")


def flag_truncation(df: DataFrame) -> DataFrame:
    """Last character and word, closing punctuation, and last words too short to be whole."""
    end = T.trimmed("prompt")
    df = df.withColumns({"ultimo_char": F.right(end, F.lit(1)), "ultima_parola": F.element_at(F.split(end, " "), -1)})
    return df.withColumns(
        {
            "finisce_con_punteggiatura": T.matches("ultimo_char", "[.!?,:;]"),
            "ultima_parola_sospetta": (F.length("ultima_parola") <= 2) & ~F.lower("ultima_parola").isin(*FUNCTION_WORDS),
        }
    )


def flag_special_characters(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "ha_markup": T.matches("prompt", MARKUP),
            "ha_caratteri_controllo": T.matches("prompt", r"[\t\n\r]"),
            "ha_doppio_spazio": F.contains("prompt", F.lit("  ")),
            "spazio_prima_punteggiatura": T.matches("prompt", " [.,;:!?]"),
            "ha_non_ascii": T.matches("prompt", r"[^\x00-\x7F]"),
            "ha_unicode_invisibile": T.matches("prompt", INVISIBLE),
            "parentesi_round_sbilanciate": T.unbalanced("prompt", "(", ")"),
            "parentesi_quadre_sbilanciate": T.unbalanced("prompt", "[", "]"),
            "virgolette_sbilanciate": T.odd_quotes("prompt"),
        }
    )


def repair(df: DataFrame) -> DataFrame:
    """prompt_per_generazione (markup and invisible characters out, a last space kept) and prompt_pulito (squished).

    No-break spaces are flagged but stay in the first.
    """
    out = F.replace(F.col("prompt"), F.lit("&amp;"), F.lit("&"))
    for pattern, by in ((r"\[\[|\]\]", ""), (r"\{\{.*?\}\}", ""), (r"[\t\n\r]", " "), (r"[\x{200B}\x{FEFF}]", "")):
        out = F.regexp_replace(out, pattern, by)
    return df.withColumn("prompt_per_generazione", out).withColumn("prompt_pulito", T.squished("prompt_per_generazione"))


STRUCTURAL = ("ha_caratteri_controllo", "ha_doppio_spazio", "spazio_prima_punteggiatura", "ha_unicode_invisibile", "parentesi_round_sbilanciate", "parentesi_quadre_sbilanciate", "virgolette_sbilanciate", "ha_markup")


def clean_prompts(df: DataFrame) -> DataFrame:
    """All steps, and flag_qualita_strutturale: any structural flag."""
    for step in (add_lengths, flag_duplicates, flag_length_outliers, flag_truncation, flag_special_characters, repair):
        df = df.transform(step)
    return df.withColumn("flag_qualita_strutturale", T.any_of(F.col(c) for c in STRUCTURAL))


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """Totals over the cleaned prompts; `modifiche_sostanziali` are repairs beyond outer white space."""
    changed = T.trimmed("prompt_per_generazione") != T.trimmed("prompt")
    flags = ("is_duplicato_esatto", "is_duplicato_quasi", "is_duplicato_cross_categoria", "outlier_lunghezza", "ultima_parola_sospetta", "flag_qualita_strutturale", *STRUCTURAL)
    return cleaned.agg(F.count("*").alias("n_righe"), *(F.count_if(F.col(c)).alias(f"n_{c}") for c in flags), F.count_if(changed).alias("n_modifiche_sostanziali"))


def export_cases(cleaned: DataFrame) -> dict[str, DataFrame]:
    """Rows for review: duplicates, structural problems, and suspicious lengths or endings."""
    return {
        "duplicati": cleaned.where(F.col("is_duplicato_esatto") | F.col("is_duplicato_quasi")),
        "struttura": cleaned.where("flag_qualita_strutturale"),
        "lunghezza": cleaned.where(F.col("outlier_lunghezza") | F.col("ultima_parola_sospetta")),
    }
