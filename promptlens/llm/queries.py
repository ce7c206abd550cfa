"""The queries of this package's operators, each over its whole table, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm import bpe, forest, html, jaccard, katz, mixing, quality, sharding
from promptlens.llm.substring import doubling_dedup, rlz_dedup

SHARDS = [f"shard-{i:02d}" for i in range(64)]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz_dedup(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", F.col("n_items").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = doubling_dedup(_table(spark, sf_dir, "documents"), window=200)
    return out.select("doc_id", F.col("n_items").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.93)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.systematic_mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.with_length(html.extract_text(_table(spark, sf_dir, "pages"))).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_sharding": op5_sharding,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_rules": op7_quality_rules,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_mixing": op9_mixing,
    "op10_html_extraction": op10_html_extraction,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
early AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM (SELECT win.doc_id, i, unnest(range(0, 50)) AS o FROM win JOIN early USING (k) WHERE m < win.doc_id)),
item AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
kept AS (SELECT i.doc_id, string_agg(word, ' ' ORDER BY i.j) AS t, count(*) AS n FROM item i ANTI JOIN gone g ON i.doc_id = g.doc_id AND i.j = g.j GROUP BY i.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
    "op3_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id""",
    "op5_sharding": f"""
SELECT doc_id, slot, printf('shard-%02d', {sharding.lookup_table(SHARDS)}[slot + 1]) AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents)""",
    "op8_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT m.vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id)::BIGINT AS n_links, c AS component_id, m.vec_id = c AS kept FROM m""",
    "op9_mixing": f"""
WITH e AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size,
    floor(('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE * {mixing.CELLS})::INT AS part FROM documents),
d AS (SELECT *, ((length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)::INT) & 7)) * {mixing.CELLS} + part)::INT AS cell FROM e),
c AS (SELECT source, cell, count(*) AS n, sum(size)::BIGINT AS words FROM d GROUP BY source, cell),
st AS (SELECT source, cell, coalesce(sum(n) OVER (PARTITION BY source ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c),
z AS (SELECT source, sum(words)::BIGINT AS source_size FROM c GROUP BY source),
wt AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1] AS weight FROM z),
lv AS (SELECT *, coalesce(sum(weight) OVER o, 0)::BIGINT AS wb,
    (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
    FROM wt WINDOW o AS (ORDER BY source_size / weight::DOUBLE, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(wb) AS k, arg_min(level, wb) AS level FROM lv WHERE level * weight <= 2.0::DOUBLE * source_size),
g AS (SELECT source, source_size, CASE WHEN k IS NULL OR wb < k THEN 2.0::DOUBLE * source_size ELSE f.level * weight END AS target,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM lv, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM g),
k AS (SELECT d.*, row_number() OVER (PARTITION BY source, cell ORDER BY size, doc_id) AS nr FROM d)
SELECT k.doc_id, k.size, r.source_size, r.target, ((floor((start + nr) * rate + u) - floor((start + nr - 1) * rate + u)) * k.size)::BIGINT AS taken
FROM k JOIN st ON st.source IS NOT DISTINCT FROM k.source AND st.cell = k.cell JOIN r ON r.source IS NOT DISTINCT FROM k.source""",
}
