"""Prompts, generations and entities in the shape the operators expect, over the driver's tables.

The documents hold none of what the flags look for, so the views put it in: one anomaly for each
remainder of the id, whole rows that repeat among them, by SQL that Spark and DuckDB read alike. Every row of the table is used, and every text is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DOMAIN = "CASE lang WHEN 'en' THEN 'gender' WHEN 'fr' THEN 'profession' WHEN 'de' THEN 'race' ELSE 'religious_ideology' END"

PROMPTS = f"""
SELECT doc_id AS ord, CASE WHEN doc_id % 29 = 14 THEN 'gender' ELSE {_DOMAIN} END AS dominio,
  CASE WHEN doc_id % 29 = 14 THEN 'whole_row' WHEN doc_id % 41 = 3 THEN concat(' ', upper(source), '  ') ELSE source END AS categoria,
  CASE WHEN doc_id % 29 = 14 THEN 'subj_row' ELSE concat('subj_', cast(doc_id % 37 AS string)) END AS entita,
  CASE cast(doc_id % 29 AS int)
    WHEN 0 THEN concat(t, ' ') WHEN 1 THEN concat('[[x]] ', t) WHEN 2 THEN concat(t, ' &amp; more ') WHEN 3 THEN concat('(open ', t)
    WHEN 4 THEN concat('say "', t) WHEN 5 THEN concat('tab\there ', t) WHEN 6 THEN concat('two  spaces ', t) WHEN 7 THEN concat('odd , comma ', t)
    WHEN 8 THEN concat('no break ', t) WHEN 9 THEN concat('zero​width ', t) WHEN 10 THEN concat('你好 ', t) WHEN 11 THEN concat('{{{{tpl}}}} ', t)
    WHEN 12 THEN '' WHEN 13 THEN NULL WHEN 14 THEN 'The same prompt for all' WHEN 15 THEN concat(' lead ', t) WHEN 16 THEN '  '
    WHEN 17 THEN concat('\n', t) WHEN 18 THEN concat(t, '\n') WHEN 19 THEN concat('\n\n', t, '\n') WHEN 20 THEN '\n\n' WHEN 21 THEN concat('a\n\nb ', t)
    WHEN 22 THEN concat('cr\r\nlf ', t) WHEN 23 THEN 'the  SAME prompt for ALL ' WHEN 24 THEN concat(t, ' qz') WHEN 25 THEN concat('a]] b ', t, '.') ELSE t END AS prompt
FROM (SELECT doc_id, lang, source, text AS t FROM documents)"""

GENERATIONS = f"""
SELECT doc_id AS ord, cast(cast(floor(doc_id / 10) AS bigint) AS string) AS prompt_id,
  CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'post' END AS model_key,
  cast(floor((doc_id % 10) / 2) AS int) + 1 AS repetition,
  CASE cast(floor(doc_id / 10) AS bigint) % 4 WHEN 0 THEN 'gender' WHEN 1 THEN 'profession' WHEN 2 THEN 'race' ELSE 'religious_ideology' END AS domain,
  concat('cat_', cast(cast(floor(doc_id / 10) AS bigint) % 7 AS string)) AS category,
  CASE cast(floor(doc_id / 10) AS bigint) % 5 WHEN 0 THEN 'Alice_White' WHEN 1 THEN 'Head_nurse' WHEN 2 THEN 'Guitar_Hero' WHEN 3 THEN 'Bob_Brown_Jr.' ELSE 'Night_watchman' END AS subject,
  CASE cast(floor(doc_id / 10) AS bigint) % 13 WHEN 4 THEN '' WHEN 7 THEN NULL WHEN 9 THEN '漢 Alice White said '
    ELSE concat(CASE cast(floor(doc_id / 10) AS bigint) % 5 WHEN 0 THEN 'Alice White' WHEN 1 THEN 'The head nurse' WHEN 2 THEN 'Guitar Hero' WHEN 3 THEN 'Bob Brown' ELSE 'A night watchman' END, ' was ') END AS prompt,
  CASE WHEN cast(floor(doc_id / 10) AS bigint) % 13 = 4 AND doc_id % 3 > 0 THEN NULL
    WHEN doc_id % 7 = 1 THEN concat('Same answer ', cast(cast(floor(doc_id / 10) AS bigint) AS string), '.')
    WHEN doc_id % 7 = 2 THEN concat('  same  ANSWER ', cast(cast(floor(doc_id / 10) AS bigint) AS string), '.\n')
    ELSE CASE cast(doc_id % 19 AS int) WHEN 0 THEN concat(t, '? Yes.') WHEN 1 THEN concat('你好, ', t, ' 世界!') WHEN 2 THEN 'word word Word word' WHEN 3 THEN '' WHEN 4 THEN NULL
      WHEN 5 THEN concat('she and her ', t) WHEN 6 THEN concat('He said his ', t, ' Mrs. Brown') WHEN 7 THEN 'かな' WHEN 8 THEN '   ' WHEN 9 THEN concat('Alice White met Head nurses and BOB BROWN JR. ', t)
      WHEN 10 THEN 'Jews, muslims and Christians; judaismx' ELSE t END END AS generation,
  CASE WHEN cast(floor(doc_id / 10) AS bigint) % 13 = 4 THEN 'skipped_empty_prompt' WHEN doc_id % 53 = 5 THEN NULL WHEN doc_id % 53 = 6 THEN 'failed' ELSE 'ok' END AS status,
  cast(doc_id % 41 AS double) AS generated_tokens,
  CASE WHEN cast(floor(doc_id / 10) AS bigint) % 13 = 4 THEN 'not_generated_empty_prompt' WHEN doc_id % 3 = 0 THEN 'max_new_tokens' ELSE 'eos_token' END AS finish_reason
FROM (SELECT doc_id, text AS t FROM documents)"""

#: Keys that occur twice, and attributes that differ between models.
REPEATED = f"""
SELECT * FROM ({GENERATIONS}) UNION ALL
SELECT ord, prompt_id, model_key, repetition, domain, concat(category, '_b') AS category, subject, prompt, generation, status, generated_tokens, finish_reason FROM ({GENERATIONS}) WHERE ord % 31 = 4"""

SQL = {"v_prompts": PROMPTS, "v_generations": GENERATIONS, "v_repeated": REPEATED}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows, over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    docs.createOrReplaceTempView("promptlens_documents")
    return spark.sql(SQL[name].replace("FROM documents)", "FROM promptlens_documents)"))
