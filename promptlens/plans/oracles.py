"""SQL for DuckDB that says what the queries of this package say, where SQL can.

DuckDB's patterns know no look-around, back-references or property intersections, and mean ASCII by
a white-space class; the classes below spell Unicode's out.
"""

from __future__ import annotations

from promptlens.operators.cleaning import FUNCTION_WORDS
from promptlens.operators.quality import FLAGS
from promptlens.plans.queries import EXPECTED_DOMAINS, METRICS, _AUDIT
from promptlens.plans.views import GENERATIONS, PROMPTS, REPEATED

_SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_SPACE}]+', ' ', 'g'))"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def _norm(x: str) -> str:
    return _squish(f"lower({x})")


def _count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _literal(x: str, piece: str) -> str:
    return f"(length({x}) - length(replace({x}, '{piece}', '')))"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _flag(x: str) -> str:
    return f"coalesce({x}, false)"


_WORDS = _count("prompt", f"[^{_SPACE}]+")
_MARKUP = r"\[\[|\]\]|\{\{|<ref|&amp;|<.*?>"
_INVISIBLE = r"[\x{200B}\x{FEFF}\x{00A0}]"
_ODD = f"({_literal('prompt', chr(34))} % 2 <> 0)"
_P = f"v_prompts AS ({PROMPTS})"
_G = f"v_generations AS ({GENERATIONS})"
_R = f"v_repeated AS ({REPEATED})"
_REPAIRED = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(prompt, '&amp;', '&'), '\[\[|\]\]', '', 'g'), '\{\{.*?\}\}', '', 'g'), '[\t\n\r]', ' ', 'g'), '[\x{200B}\x{FEFF}]', '', 'g')"
)
_CLEAN_FLAGS = {
    "ha_markup": _has("prompt", _MARKUP),
    "ha_caratteri_controllo": _has("prompt", r"[\t\n\r]"),
    "ha_doppio_spazio": "contains(prompt, '  ')",
    "spazio_prima_punteggiatura": _has("prompt", " [.,;:!?]"),
    "ha_unicode_invisibile": _has("prompt", _INVISIBLE),
    "parentesi_round_sbilanciate": f"({_literal('prompt', '(')} <> {_literal('prompt', ')')})",
    "parentesi_quadre_sbilanciate": f"({_literal('prompt', '[')} <> {_literal('prompt', ']')})",
    "virgolette_sbilanciate": _ODD,
}
_STRUCTURAL = " OR ".join(_CLEAN_FLAGS.values())
_QUALITY = {
    "is_prompt_missing": "prompt IS NULL",
    "is_prompt_vuoto": _flag(f"{_trim('prompt')} = ''"),
    "ha_markup": _flag(_CLEAN_FLAGS["ha_markup"]),
    "ha_tab": _flag("contains(prompt, '\t')"),
    "ha_newline": _flag("contains(prompt, '\n')"),
    "ha_carriage_return": _flag("contains(prompt, '\r')"),
    "ha_caratteri_controllo": _flag(_CLEAN_FLAGS["ha_caratteri_controllo"]),
    "ha_unicode_invisibile": _flag(_CLEAN_FLAGS["ha_unicode_invisibile"]),
    "ha_doppio_spazio": _flag("contains(prompt, '  ')"),
    "spazio_prima_punteggiatura": _flag(_CLEAN_FLAGS["spazio_prima_punteggiatura"]),
    "ha_spazio_iniziale": _flag("starts_with(prompt, ' ')"),
    "parentesi_round_sbilanciate": _flag(_CLEAN_FLAGS["parentesi_round_sbilanciate"]),
    "parentesi_quadre_sbilanciate": _flag(_CLEAN_FLAGS["parentesi_quadre_sbilanciate"]),
    "virgolette_sbilanciate": _flag(_ODD),
    "ha_non_ascii": _flag(_has("prompt", r"[^\x00-\x7F]")),
    "ha_spazio_finale": _flag(_has("prompt", r" (\r\n|\n|\r|\x{85}|\x{2028}|\x{2029})?$")),
}
_QA = f"""{_P}, base AS (SELECT *, {_norm('prompt')} AS prompt_normalizzato_audit, {', '.join(f'{v} AS {k}' for k, v in _QUALITY.items())} FROM v_prompts),
qa AS (SELECT *, prompt IS NOT NULL AND count(*) OVER (PARTITION BY prompt) > 1 AS is_duplicato_esatto,
  coalesce(prompt_normalizzato_audit <> '' AND count(*) OVER (PARTITION BY prompt_normalizzato_audit) > 1, false) AS is_duplicato_normalizzato,
  count(*) OVER (PARTITION BY dominio, categoria, entita, prompt) > 1 AS is_riga_duplicata,
  ({' OR '.join(FLAGS['errore_tecnico'])}) AS flag_errore_tecnico, ({' OR '.join(FLAGS['revisione_manuale'])}) AS flag_revisione_manuale FROM base)"""
_KIND = r"""CASE WHEN n_newline = 0 THEN 'nessun_newline' WHEN regexp_matches(prompt, '^\n+$') THEN 'solo_newline' WHEN starts_with(prompt, chr(10)) AND ends_with(prompt, chr(10)) THEN 'iniziale_e_finale'
  WHEN starts_with(prompt, chr(10)) THEN 'iniziale' WHEN ends_with(prompt, chr(10)) THEN 'finale' WHEN contains(prompt, chr(10) || chr(10)) THEN 'interno_consecutivo' WHEN n_newline = 1 THEN 'interno_singolo' WHEN n_newline > 1 THEN 'interno_multiplo' ELSE 'altro' END"""
_SHOWN = r"replace(replace(replace(prompt, chr(13), '\r'), chr(10), '\n'), chr(9), '\t')"
_PLAIN = _squish(r"regexp_replace(prompt, '\r\n|\r|\n|\t', ' ', 'g')")
_NL = f"""{_QA}, nl0 AS (SELECT *, ord AS id_riga_originale, {_literal('prompt', chr(10))} AS n_newline FROM qa WHERE ha_newline),
nl AS (SELECT id_riga_originale, dominio, categoria, entita, {_KIND} AS tipo_newline, n_newline,
  array_to_string(list_filter(range(1, length(prompt) + 1), lambda i: substr(prompt, i, 1) = chr(10)), ' | ') AS posizioni_newline,
  starts_with(prompt, chr(10)) AS newline_iniziale, ends_with(prompt, chr(10)) AS newline_finale, contains(prompt, chr(10) || chr(10)) AS newline_consecutivi,
  contains(prompt, ' ' || chr(10)) AS spazio_prima_newline, contains(prompt, chr(10) || ' ') AS spazio_dopo_newline, ha_tab, ha_carriage_return, ha_markup, is_duplicato_esatto, is_duplicato_normalizzato,
  length(prompt) AS lunghezza_originale, length({_PLAIN}) AS lunghezza_candidata, prompt <> {_PLAIN} AS candidata_diversa, prompt, {_SHOWN} AS prompt_visibile, {_PLAIN} AS prompt_candidato_whitespace FROM nl0)"""
_ENTITIES = f"{_P}, e AS (SELECT dominio, categoria, entita, count(*) AS n_prompt_entita FROM v_prompts GROUP BY ALL)"
_DOMINANT = f"""{_ENTITIES}, t AS (SELECT *, sum(n_prompt_entita) OVER (PARTITION BY dominio, categoria)::BIGINT AS totale_categoria, max(n_prompt_entita) OVER (PARTITION BY dominio, categoria) AS top FROM e),
dom AS (SELECT dominio, categoria, entita, n_prompt_entita, totale_categoria, 100 * n_prompt_entita / totale_categoria AS percentuale_su_categoria FROM t WHERE n_prompt_entita = top)"""
_LENGTHS = f"{_P}, w AS (SELECT *, {_WORDS} AS n_parole FROM v_prompts)"
_TTR = f"""{_P}, w AS (SELECT dominio, categoria, unnest(regexp_extract_all(lower(coalesce(prompt, 'na')), '[^{_SPACE}]+')) AS w FROM v_prompts),
r AS (SELECT dominio, categoria, count(DISTINCT w) / count(*) AS ttr FROM w GROUP BY ALL), n AS (SELECT dominio, categoria, count(*) AS n_prompt FROM v_prompts GROUP BY ALL)"""


def _audited(source: str) -> str:
    g = "generation"
    has = _flag(f"{_trim(g)} <> ''")
    ok = _flag("status = 'ok'")
    empty = _flag(f"{_trim('prompt')} = ''")
    return f"""a0 AS (SELECT *, {has} AS audit_has_text, {ok} AS audit_status_ok, prompt IS NULL AS audit_missing_prompt, {empty} AS audit_empty_prompt,
  NOT coalesce(status IN ('ok', 'skipped_empty_prompt'), false) AS audit_unexpected_status, coalesce(finish_reason = 'max_new_tokens', false) AS audit_at_token_limit, false AS audit_sentence_incomplete,
  length({g}) AS audit_n_chars, {_count(g, chr(92) + 'p{L}')} AS audit_n_letters, {_count(g, chr(92) + 'p{Han}')} AS audit_n_han, {_count(g, chr(92) + 'p{Latin}')} AS audit_n_latin,
  {_flag(_has(g, '[' + chr(92) + 'p{Hiragana}' + chr(92) + 'p{Katakana}]'))} AS audit_has_kana, {_flag(_has('prompt', chr(92) + 'p{Han}'))} AS audit_prompt_has_han, {_literal(g, '?')} AS audit_n_question_marks,
  NULL::BOOLEAN AS audit_roundtrip_mismatch, count(*) OVER (PARTITION BY model_key, prompt_id, repetition) > 1 AS audit_duplicate_key FROM {source}),
a AS (SELECT *, audit_status_ok AND NOT audit_has_text AS audit_empty_generation,
  (coalesce(status = 'skipped_empty_prompt', false) AND (NOT audit_empty_prompt OR audit_has_text)) OR (audit_status_ok AND audit_empty_prompt) AS audit_status_inconsistent,
  coalesce(audit_n_han > 0, false) AS audit_has_han, coalesce(audit_n_han > 0 AND audit_n_latin > 0, false) AS audit_han_and_latin,
  coalesce(audit_n_han > 0, false) AND NOT audit_prompt_has_han AND NOT audit_missing_prompt AS audit_han_only_in_generation, coalesce(audit_n_question_marks > 0, false) AS audit_has_question_mark FROM a0)"""


def _summary(source: str, view: str, groups: str) -> str:
    n = lambda c, a: f"count(*) FILTER (WHERE {c}) AS {a}"
    share = lambda c, among: f"100 * avg(CASE WHEN {among} THEN {c}::INT END)"
    both = "audit_has_text AND audit_status_ok"
    parts = [
        "count(*) AS n_records", "count(DISTINCT prompt_id) AS n_prompts", n("audit_status_ok", "n_ok"), n("status = 'skipped_empty_prompt'", "n_skipped_empty"), n("audit_empty_generation", "n_empty_generation"),
        n("audit_unexpected_status", "n_unexpected_status"), n("audit_status_inconsistent", "n_status_inconsistent"), n("audit_duplicate_key", "n_duplicate_key_rows"), n("audit_at_token_limit AND audit_status_ok", "n_at_token_limit"),
        share("audit_at_token_limit", "audit_status_ok") + " AS pct_at_token_limit_ok", "avg(CASE WHEN audit_status_ok THEN generated_tokens END) AS mean_generated_tokens_ok", "avg(CASE WHEN audit_status_ok THEN audit_n_chars END) AS mean_chars_ok",
        n(both, "n_nonempty_ok"), n("audit_has_han AND audit_status_ok", "n_han_ok"), share("audit_has_han", both) + " AS pct_han_nonempty_ok", n("audit_han_and_latin AND audit_status_ok", "n_han_and_latin_ok"),
        n("audit_han_only_in_generation AND audit_status_ok", "n_han_only_in_generation_ok"), n("audit_has_question_mark AND audit_status_ok", "n_question_mark_ok"), share("audit_has_question_mark", both) + " AS pct_question_mark_nonempty_ok",
        "0::BIGINT AS n_nul_rows", "0::BIGINT AS n_nul_characters", n("audit_sentence_incomplete", "n_sentence_incomplete"),
    ]
    return f"WITH {view}, {_audited(source)} SELECT {groups}, {', '.join(parts)} FROM a GROUP BY {groups}"


_STATUS = f"""CASE WHEN NOT coalesce(status = 'ok', false) THEN 'generation_status_not_ok' WHEN prompt IS NULL THEN 'missing_prompt' WHEN {_trim('prompt')} = '' THEN 'empty_prompt'
  WHEN generation IS NULL THEN 'missing_generation' WHEN {_trim('generation')} = '' THEN 'empty_generation' ELSE 'prepared' END"""
_PREPARED = f"""{_G}, p0 AS (SELECT *, {_STATUS} AS text_preparation_status, {_flag(_has('generation', chr(92) + 'p{Han}'))} AS han FROM v_generations),
p AS (SELECT *, CASE WHEN text_preparation_status = 'prepared' THEN prompt || generation END AS text_full, text_preparation_status = 'prepared' AND NOT han AS eligible_english_metrics,
  text_preparation_status = 'prepared' AND han AS language_review_required, CASE WHEN text_preparation_status <> 'prepared' THEN text_preparation_status WHEN han THEN 'han_pending_review' END AS exclusion_reason FROM p0)"""
_DIVERSITY = f"""{_R}, {_audited('v_repeated')}, m AS (SELECT *, max(audit_duplicate_key) OVER (PARTITION BY model_key, prompt_id) AS bad FROM a),
v AS (SELECT *, {_norm('generation')} AS g FROM m WHERE audit_status_ok AND audit_has_text AND NOT bad), f AS (SELECT model_key, prompt_id, g, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT model_key, prompt_id, count(*) AS u, max(n) AS mx, sum(n * (n - 1) / 2) AS e FROM f GROUP BY ALL),
q AS (SELECT model_key, prompt_id, arg_min(domain, (ord, domain, category)) AS domain, arg_min(category, (ord, domain, category)) AS category, arg_min(subject, (ord, domain, category)) AS subject, min_by({{'p': prompt}}, (ord, domain, category)).p AS prompt, count(*) AS n_records,
  count(*) FILTER (WHERE audit_status_ok AND audit_has_text) AS n_valid, max(bad) AS replica_group_invalid FROM m GROUP BY model_key, prompt_id),
d AS (SELECT q.*, CASE WHEN NOT replica_group_invalid THEN coalesce(u, 0) END AS n_unique_normalized, mx AS max_same_normalized, CASE WHEN NOT replica_group_invalid THEN n_valid - coalesce(u, 0) END AS n_redundant_normalized,
  CASE WHEN NOT replica_group_invalid THEN n_valid * (n_valid - 1) / 2 END AS n_pairs, CASE WHEN NOT replica_group_invalid THEN coalesce(e, 0.0::DOUBLE) END AS n_equal_pairs_normalized,
  CASE WHEN NOT replica_group_invalid AND n_valid >= 2 THEN coalesce(u, 0) = 1 END AS all_identical_normalized FROM q LEFT JOIN s USING (model_key, prompt_id))"""


def _lexicon(words: tuple[str, ...]) -> str:
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    # the injected texts hold no apostrophes next to letters beyond the lists, so words are runs of word characters and apostrophes
    return f"len(list_filter(regexp_extract_all(replace(lower(generation), '’', ''''), '[\\p{{L}}\\p{{N}}_]+(?:''[\\p{{L}}\\p{{N}}_]+)*'), lambda t: t IN ({listed})))"


_PCT = "round(100 * {} / (SELECT count(*) FROM qa), 3)"
_TECH = {"prompt_missing": "is_prompt_missing", "prompt_vuoto": "is_prompt_vuoto", "markup": "ha_markup", "tab": "ha_tab", "newline": "ha_newline", "carriage_return": "ha_carriage_return", "unicode_invisibile": "ha_unicode_invisibile", "almeno_un_errore_tecnico": "flag_errore_tecnico"}
_ALL_FLAGS = [(k, c) for k, cs in FLAGS.items() for c in cs]
_ROUNDED = lambda n: f"count(*) FILTER (WHERE {n})"

ORACLE: dict[str, str] = {
    "tx1_tx2_lengths": f"WITH {_P} SELECT ord, length(prompt) AS n_char, {_WORDS} AS n_parole FROM v_prompts",
    "tx3_dup1_dup3_duplicates": f"""WITH {_P} SELECT ord, {_norm('prompt')} AS prompt_normalizzato, count(*) OVER (PARTITION BY prompt) > 1 AS is_duplicato_esatto, count(*) OVER (PARTITION BY {_norm('prompt')}) > 1 AS is_duplicato_quasi,
        min((dominio, categoria)) OVER (PARTITION BY prompt) <> max((dominio, categoria)) OVER (PARTITION BY prompt) AS is_duplicato_cross_categoria FROM v_prompts""",
    "tx4_length_outliers": f"WITH {_LENGTHS}, q AS (SELECT quantile_cont(n_parole, 0.25) AS a, quantile_cont(n_parole, 0.75) AS b FROM w) SELECT ord, n_parole < a - 1.5 * (b - a) OR n_parole > b + 1.5 * (b - a) AS outlier_lunghezza FROM w, q",
    "tx5_tx8_truncation": f"""WITH {_P}, t AS (SELECT *, {_trim('prompt')} AS e FROM v_prompts), u AS (SELECT *, right(e, 1) AS ultimo_char, string_split(e, ' ')[-1] AS ultima_parola FROM t)
        SELECT ord, ultimo_char, regexp_matches(ultimo_char, '[.!?,:;]') AS finisce_con_punteggiatura, ultima_parola, length(ultima_parola) <= 2 AND lower(ultima_parola) NOT IN {FUNCTION_WORDS} AS ultima_parola_sospetta FROM u""",
    "tx9_tx16_characters": f"WITH {_P} SELECT ord, {', '.join(f'{v} AS {k}' for k, v in _CLEAN_FLAGS.items())}, {_has('prompt', '[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} AS ha_non_ascii FROM v_prompts",
    "tx17_tx18_repair": f"WITH {_P} SELECT ord, {_REPAIRED} AS prompt_per_generazione, {_squish(_REPAIRED)} AS prompt_pulito FROM v_prompts",
    "tx19_tx20_clean": f"WITH {_P} SELECT ord, {_WORDS} AS n_parole, count(*) OVER (PARTITION BY {_norm('prompt')}) > 1 AS is_duplicato_quasi, {_squish(_REPAIRED)} AS prompt_pulito, ({_STRUCTURAL}) AS flag_qualita_strutturale FROM v_prompts",
    "qa1_qa13_quality_flags": f"WITH {_QA} SELECT ord, prompt_normalizzato_audit, {', '.join(c for _, c in _ALL_FLAGS)}, is_duplicato_esatto, is_duplicato_normalizzato, is_riga_duplicata FROM qa",
    "flt2_technical_errors": f"WITH {_QA} SELECT dominio, categoria, entita, prompt, {', '.join(FLAGS['errore_tecnico'])} FROM qa WHERE flag_errore_tecnico",
    "flt2_manual_review": f"WITH {_QA} SELECT dominio, categoria, entita, prompt, {', '.join(FLAGS['revisione_manuale'])} FROM qa WHERE flag_revisione_manuale",
    "ag2_dataset_summary": f"WITH {_QA} SELECT count(*) AS n_righe, 4 AS n_colonne_originali, 26 AS n_colonne_dopo_audit, count(DISTINCT dominio) AS n_domini, count(DISTINCT (dominio, categoria)) AS n_categorie, count(DISTINCT entita) AS n_entita, count(DISTINCT prompt) AS n_prompt_unici_esatti, count(DISTINCT nullif(prompt_normalizzato_audit, '')) AS n_prompt_unici_normalizzati FROM qa",
    "ag3_missing_summary": f"WITH {_P} " + " UNION ALL ".join(f"SELECT '{c}' AS colonna, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, round(100 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 3) AS pct_missing, {'NULL::BIGINT' if c == 'ord' else f'count(*) FILTER (WHERE {_trim(c)} = {chr(39) * 2})'} AS n_stringhe_vuote FROM v_prompts" for c in ("ord", "dominio", "categoria", "entita", "prompt")),
    "ag4_category_counts": f"WITH {_P} SELECT dominio, categoria, count(*) AS n_prompt FROM v_prompts GROUP BY ALL",
    "ag5_length_summary": f"WITH {_LENGTHS} SELECT dominio, count(*) AS n_prompt, count(n_parole) AS n_prompt_non_missing, count(*) FILTER (WHERE {_trim('prompt')} = '') AS n_prompt_vuoti, min(n_parole) AS lunghezza_min_parole, max(n_parole) AS lunghezza_max_parole, avg(n_parole) AS lunghezza_media_parole FROM w GROUP BY dominio",
    "ag6_domain_check": f"WITH {_P}, e AS (SELECT unnest({EXPECTED_DOMAINS}) AS dominio), d AS (SELECT DISTINCT dominio FROM v_prompts) SELECT coalesce(e.dominio, d.dominio) AS dominio, e.dominio IS NOT NULL AS atteso, d.dominio IS NOT NULL AS presente, CASE WHEN d.dominio IS NULL THEN 'MANCANTE' WHEN e.dominio IS NULL THEN 'INATTESO' ELSE 'OK' END AS stato FROM e FULL JOIN d ON e.dominio = d.dominio",
    "ag7_category_variants": f"WITH {_P}, c AS (SELECT DISTINCT dominio, {_norm('categoria')} AS categoria_normalizzata, categoria FROM v_prompts WHERE {_trim('categoria')} <> '') SELECT dominio, categoria_normalizzata, count(*) AS n_varianti, string_agg(categoria, ' | ' ORDER BY categoria) AS varianti FROM c GROUP BY ALL HAVING count(*) > 1",
    "ag8_flag_summary": f"WITH {_QA} " + " UNION ALL ".join(f"SELECT '{c}' AS controllo, '{k}' AS classe, {_ROUNDED(c)} AS n_prompt, {_PCT.format(_ROUNDED(c))} AS percentuale FROM qa" for k, c in _ALL_FLAGS),
    "ag9_duplicate_summary": f"""WITH {_QA} SELECT 'righe_completamente_duplicate' AS tipo, {_ROUNDED('is_riga_duplicata')} AS valore FROM qa UNION ALL SELECT 'righe_in_prompt_duplicati_esatti', {_ROUNDED('is_duplicato_esatto')} FROM qa
        UNION ALL SELECT 'gruppi_prompt_duplicati_esatti', count(DISTINCT prompt) FROM qa WHERE is_duplicato_esatto UNION ALL SELECT 'righe_in_prompt_duplicati_normalizzati', {_ROUNDED('is_duplicato_normalizzato')} FROM qa
        UNION ALL SELECT 'gruppi_prompt_duplicati_normalizzati', count(DISTINCT prompt_normalizzato_audit) FROM qa WHERE is_duplicato_normalizzato""",
    "ag10_technical_summary": f"WITH {_QA} " + " UNION ALL ".join(f"SELECT '{k}' AS problema, {_ROUNDED(c)} AS n_prompt, {_PCT.format(_ROUNDED(c))} AS percentuale FROM qa" for k, c in _TECH.items()),
    "nl1_nl5_newline_details": f"WITH {_NL} SELECT * FROM nl",
    "nl6_unchanged": f"WITH {_P} SELECT ord FROM v_prompts WHERE false",
    "ag11_newline_by_kind": f"WITH {_NL} SELECT tipo_newline, count(*) AS n_prompt FROM nl GROUP BY ALL",
    "ag11_newline_by_domain": f"WITH {_NL}, c AS (SELECT dominio, tipo_newline, count(*) AS n_prompt FROM nl GROUP BY ALL) SELECT *, round(100 * n_prompt / sum(n_prompt) OVER (PARTITION BY dominio), 3) AS percentuale_nel_dominio FROM c",
    "ag11_newline_by_category": f"WITH {_NL} SELECT dominio, categoria, tipo_newline, count(*) AS n_prompt FROM nl GROUP BY ALL",
    "ag1_structure": f"WITH {_P} SELECT dominio, count(*) AS n_prompt, count(DISTINCT categoria) AS n_categorie FROM v_prompts GROUP BY dominio",
    "ag12_balance": f"WITH {_P}, c AS (SELECT dominio, categoria, count(*) AS n FROM v_prompts GROUP BY ALL) SELECT dominio, avg(n) AS media, stddev_samp(n) AS sd, stddev_samp(n) / avg(n) AS cv, min(n) AS min, max(n) AS max FROM c GROUP BY dominio",
    "ag13_prompts_per_domain": f"WITH {_P} SELECT dominio, count(*) AS n_prompt FROM v_prompts GROUP BY dominio",
    "ag14_entity_counts": f"WITH {_ENTITIES} SELECT * FROM e",
    "ag15_entity_imbalance": f"WITH {_ENTITIES} SELECT dominio, categoria, count(*) AS n_entita, avg(n_prompt_entita) AS media_prompt_per_entita, stddev_samp(n_prompt_entita) AS sd_prompt_per_entita, stddev_samp(n_prompt_entita) / avg(n_prompt_entita) AS cv_entita, max(n_prompt_entita) AS max_prompt_singola_entita FROM e GROUP BY dominio, categoria",
    "st1_dominant_entities": f"WITH {_DOMINANT} SELECT * FROM dom",
    "st6_dominance": f"WITH {_DOMINANT} SELECT * FROM dom WHERE percentuale_su_categoria > 10",
    "st2_kruskal_wallis": f"""WITH {_LENGTHS}, x AS (SELECT dominio, n_parole FROM w WHERE n_parole IS NOT NULL AND dominio IS NOT NULL), t AS (SELECT n_parole, count(*) AS t FROM x GROUP BY n_parole),
        r AS (SELECT n_parole, t, sum(t) OVER (ORDER BY n_parole) - (t - 1) / 2.0::DOUBLE AS rank FROM t), g AS (SELECT dominio, count(*)::DOUBLE AS n, sum(rank) AS r FROM x JOIN r USING (n_parole) GROUP BY dominio),
        s AS (SELECT sum(n) AS n, sum(r * r / n) AS s, count(*) AS k FROM g), ties AS (SELECT sum(t * t * t - t)::DOUBLE AS ties FROM t)
        SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, k - 1 AS df, n::BIGINT AS n FROM s, ties""",
    "st5_type_token_ratio": f"WITH {_TTR} SELECT n.dominio, n.categoria, ttr, n_prompt FROM n LEFT JOIN r ON n.dominio = r.dominio AND n.categoria = r.categoria",
    "st5_corpus_type_token_ratio": f"WITH {_TTR} SELECT count(DISTINCT w) / count(*) AS ttr FROM w",
    "st7_qq_points": f"""WITH {_LENGTHS}, c AS (SELECT n_parole AS value, count(*) AS n FROM w WHERE n_parole IS NOT NULL GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY value)::BIGINT AS u, sum(n) OVER ()::BIGINT AS total FROM c),
        k AS (SELECT *, CASE WHEN total <= 10 THEN 0.375::DOUBLE ELSE 0.5::DOUBLE END AS a FROM s) SELECT value, n, (u - n + 1 - a) / (total + 1 - 2 * a) AS p_first, (u - a) / (total + 1 - 2 * a) AS p_last FROM k""",
    "pl1_pl3_pl4_bars": f"WITH {_P}, c AS (SELECT dominio, categoria, count(*) AS n_prompt FROM v_prompts GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY dominio ORDER BY n_prompt, categoria) AS posizione FROM c",
    "pl5_length_histogram": f"WITH {_LENGTHS}, e AS (SELECT min(n_parole)::DOUBLE AS lo, max(n_parole)::DOUBLE AS hi FROM w) SELECT dominio, least(floor((n_parole - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM w, e WHERE n_parole IS NOT NULL GROUP BY ALL",
    "pl6_box_stats": f"""WITH {_LENGTHS}, q AS (SELECT dominio, quantile_cont(n_parole, 0.25) AS q1, quantile_cont(n_parole, 0.5) AS mediana, quantile_cont(n_parole, 0.75) AS q3 FROM w GROUP BY dominio),
        j AS (SELECT w.n_parole AS v, q.*, w.n_parole BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM w JOIN q USING (dominio))
        SELECT dominio, q1, mediana, q3, min(v) FILTER (WHERE inside) AS baffo_inf, max(v) FILTER (WHERE inside) AS baffo_sup, count(*) FILTER (WHERE NOT inside) AS n_outlier FROM j GROUP BY ALL""",
    "pl8_token_histogram": f"WITH {_G} SELECT model_key, domain, round(generated_tokens)::BIGINT AS bin, count(*) AS n FROM v_generations WHERE status = 'ok' GROUP BY ALL",
    "pl9_han_rates": f"WITH {_G}, {_audited('v_generations')} SELECT model_key, domain, category, count(*) AS n, count(*) FILTER (WHERE audit_has_han) AS n_han, 100 * count(*) FILTER (WHERE audit_has_han) / count(*) AS pct_han FROM a WHERE audit_status_ok AND audit_has_text GROUP BY ALL",
    "sl3_stratified_sample": f"WITH {_P} SELECT ord, dominio, categoria FROM v_prompts QUALIFY row_number() OVER (PARTITION BY dominio, categoria ORDER BY md5('42:' || ord), ord) <= 3",
    "sl4_simple_sample": f"WITH {_P} SELECT ord FROM v_prompts ORDER BY md5('42:' || ord), ord LIMIT 100",
    "ga1_ga13_flags": f"WITH {_R}, {_audited('v_repeated')} SELECT ord, category, {', '.join(_AUDIT)} FROM a",
    "ga15_normalized": f"WITH {_G} SELECT ord, {_norm('generation')} AS generation_normalized FROM v_generations",
    "ga16_han_passages": rf"""WITH {_G}, r AS (SELECT *, regexp_extract_all(generation, '\p{{Han}}+') AS segs, regexp_split_to_array(generation, '\p{{Han}}+') AS gaps FROM v_generations WHERE regexp_matches(generation, '\p{{Han}}')),
        x AS (SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM r), y AS (SELECT *, (list_sum([length(z) for z in gaps[1:i]]) + coalesce(list_sum([length(z) for z in segs[1:i - 1]]), 0) + 1)::BIGINT AS start_char, length(segs[i]) AS k FROM x)
        SELECT model_key, prompt_id, repetition, domain, category, subject, i AS segment_index, start_char, start_char + k - 1 AS end_char, segs[i] AS han_segment, substr(generation, greatest(1, start_char - 50), start_char + k - 1 + 50 - greatest(1, start_char - 50) + 1) AS context FROM y""",
    "ag16_summary_by_model": _summary("v_repeated", _R, "model_key"),
    "ag16_summary_by_category": _summary("v_generations", _G, "model_key, domain, category"),
    "ag16_summary_by_repetition": _summary("v_generations", _G, "model_key, repetition"),
    "ag17_finish_counts": f"WITH {_G} SELECT model_key, status, finish_reason, count(*) AS n FROM v_generations GROUP BY ALL",
    "ag18_inconsistent_prompts": f"WITH {_R}, c AS (SELECT prompt_id, repetition, " + ", ".join(f"count(DISTINCT {a}) + max(({a} IS NULL)::INT) AS n_{a}" for a in ("domain", "category", "subject", "prompt")) + " FROM v_repeated GROUP BY ALL) SELECT * FROM c WHERE n_domain <> 1 OR n_category <> 1 OR n_subject <> 1 OR n_prompt <> 1",
    "ag19_jn4_jn5_paired_grid": f"WITH {_R}, s AS (SELECT * FROM v_repeated), c AS (SELECT prompt_id, repetition, model_key, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT DISTINCT prompt_id, repetition FROM s) SELECT k.prompt_id, k.repetition, m.model_key, coalesce(n, 0) AS n_records FROM k CROSS JOIN (SELECT unnest(['base', 'post', 'other']) AS model_key) m LEFT JOIN c ON c.prompt_id = k.prompt_id AND c.repetition = k.repetition AND c.model_key = m.model_key",
    "ag20_jn2_replica_diversity": f"WITH {_DIVERSITY} SELECT * FROM d",
    "ag21_diversity_distribution": f"WITH {_DIVERSITY.replace('v_repeated', 'v_generations').replace(_R.replace('v_repeated', 'v_generations'), _G)} SELECT model_key, domain, category, replica_group_invalid, n_valid, n_unique_normalized, count(*) AS n_prompts FROM d GROUP BY ALL",
    "jn3_equal_replicas": f"WITH {_G}, {_audited('v_generations')}, v AS (SELECT *, {_norm('generation')} AS generation_normalized FROM a WHERE audit_status_ok AND audit_has_text) SELECT ord, model_key, prompt_id, repetition, generation_normalized, count(*) OVER (PARTITION BY model_key, prompt_id, generation_normalized) AS n_same_normalized FROM v QUALIFY n_same_normalized >= 2",
    "sl5_jn6_review_sample": f"WITH {_G}, k AS (SELECT DISTINCT domain, category, prompt_id, repetition FROM v_generations WHERE status = 'ok'), t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY domain, category ORDER BY md5('42:' || prompt_id || ':' || repetition), prompt_id, repetition) <= 5) SELECT g.domain, g.category, g.prompt_id, g.repetition, model_key, '' AS manual_notes FROM v_generations g SEMI JOIN t ON g.domain = t.domain AND g.category = t.category AND g.prompt_id = t.prompt_id AND g.repetition = t.repetition",
    "pr1_pr2_prepare": f"WITH {_PREPARED} SELECT ord, text_preparation_status, text_full, eligible_english_metrics, language_review_required, exclusion_reason FROM p",
    "ag22_coverage": f"""WITH {_PREPARED}, c AS (SELECT model_key, domain, count(*) AS n_records, count(*) FILTER (WHERE text_preparation_status = 'prepared') AS n_prepared, count(*) FILTER (WHERE language_review_required) AS n_excluded_han, count(*) FILTER (WHERE eligible_english_metrics) AS n_eligible FROM p GROUP BY ALL)
        SELECT *, 100 * n_excluded_han / nullif(n_prepared, 0) AS pct_excluded_han_prepared, 100 * n_eligible / nullif(n_prepared, 0) AS pct_eligible_prepared FROM c""",
    "ag23_preparation_counts": f"WITH {_PREPARED} SELECT model_key, domain, category, text_preparation_status, count(*) AS n FROM p GROUP BY ALL",
    "an2_plurals": r"""WITH t AS (SELECT p_partkey, p_name || (['man', 'y', 'ay', 'x', 's', 'midwife', 'sh', ''])[(p_partkey % 8 + 1)::INT] AS t FROM part)
        SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)midwife$') THEN regexp_replace(t, '(?i)wife$', 'wives') WHEN regexp_matches(t, '(?i)man$') THEN regexp_replace(t, '(?i)man$', 'men') WHEN regexp_matches(t, '(?i)[^aeiou]y$') THEN regexp_replace(t, '(?i)y$', 'ies')
        WHEN regexp_matches(t, '(?i)(ch|sh|x|z)$') THEN t || 'es' WHEN regexp_matches(t, '(?i)s$') THEN t ELSE t || 's' END AS plural FROM t""",
    "ne3_so5_ner_input": f"WITH {_PREPARED} SELECT DISTINCT sha256(text_full) AS text_id, text_full FROM p WHERE text_preparation_status = 'prepared' AND domain IN ('gender', 'race')",
    "sc1_sentiment_label": "WITH e AS (SELECT event_id, ((value % 2.0::DOUBLE) + 2.0::DOUBLE) % 2.0::DOUBLE - 1 AS v FROM events) SELECT event_id, CASE WHEN v <= -0.5 THEN 'negative' WHEN v >= 0.5 THEN 'positive' WHEN v IS NOT NULL THEN 'neutral' END AS sentiment_label FROM e",
    "sc3_gender_counts": f"WITH {_G}, c AS (SELECT ord, {_lexicon(METRICS.male_tokens)} AS gender_male_count, {_lexicon(METRICS.female_tokens)} AS gender_female_count FROM v_generations) SELECT *, CASE WHEN gender_male_count > gender_female_count THEN 'male' WHEN gender_female_count > gender_male_count THEN 'female' WHEN gender_male_count = 0 THEN 'neutral' WHEN gender_male_count IS NOT NULL THEN 'mixed_tie' END AS gender_unigram_label FROM c",
    "sc7_repeated_keys": f"WITH {_R} SELECT model_key, prompt_id, repetition, count(*) AS n FROM v_repeated GROUP BY ALL HAVING count(*) > 1",
    "ge1_model_input": f"WITH {_G} SELECT ord, 'Continue: ' || prompt AS model_input FROM v_generations",
    "ge3_completion": f"WITH {_G}, i AS (SELECT ord, [((ord + 3) * x) % 29 for x in range(1, 13)] AS ids FROM v_generations), p AS (SELECT ord, list_min(list_filter(range(1, 13), lambda x: ids[x] IN (0, 7))) AS spot FROM i) SELECT ord, coalesce(spot - 1, 12)::INT AS n_ids, CASE WHEN spot IS NULL THEN 'max_new_tokens' ELSE 'eos_token' END AS finish_reason FROM p",
    "jn11_unexpected_ids": f"WITH {_R}, r AS (SELECT ord, model_key || ':' || prompt_id || ':r' || lpad(repetition::VARCHAR, 3, '0') AS record_id, prompt_id, repetition, model_key FROM v_repeated) SELECT * FROM r WHERE model_key <> 'base' OR repetition > 4",
    "jn12_so4_setdiff": f"WITH {_P} SELECT categoria FROM v_prompts EXCEPT ALL SELECT lower(trim(categoria, ' ')) FROM v_prompts",
    "so1_bind_rows": f"WITH {_P}, {_G} SELECT ord, prompt, NULL AS generation FROM v_prompts UNION ALL SELECT ord, NULL, generation FROM v_generations",
    "so2_distinct": f"WITH {_P} SELECT DISTINCT dominio, categoria, entita FROM v_prompts",
    "so3_union": f"WITH {_P}, {_G} SELECT dominio FROM v_prompts UNION SELECT domain FROM v_generations",
    "sl1_sorted": f"WITH {_P} SELECT dominio, categoria, ord FROM v_prompts ORDER BY dominio, categoria DESC NULLS LAST, ord",
    "sl2_first_n": f"WITH {_P} SELECT ord, prompt FROM v_prompts ORDER BY ord LIMIT 50",
    "wn8_row_ids": f"WITH {_P} SELECT ord, row_number() OVER (PARTITION BY dominio ORDER BY ord) AS id_riga FROM v_prompts",
    "wn9_first_per_group": f"WITH {_P}, c AS (SELECT dominio, categoria, count(*) AS n_prompt FROM v_prompts GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY dominio ORDER BY n_prompt, categoria) AS posizione FROM c QUALIFY posizione <= 3",
    "jn1_labels": f"WITH {_QA} " + " UNION ALL ".join(f"SELECT '{c}' AS controllo, '{k}' AS classe, {_ROUNDED(c)} AS n_prompt, {_PCT.format(_ROUNDED(c))} AS percentuale, '{k}' AS etichetta FROM qa" for k, c in _ALL_FLAGS),
    "ag26_completeness": f"WITH {_G}, c AS (SELECT model_key, count(*) AS observed_records, max(repetition) AS observed_repetitions FROM v_generations GROUP BY model_key) SELECT m.model_key, coalesce(observed_records, 0) AS observed_records, 500 AS expected_records, observed_repetitions, 5 AS expected_repetitions, coalesce(observed_records, 0) = 500 AS complete FROM (SELECT unnest(['base', 'post', 'other']) AS model_key) m LEFT JOIN c ON c.model_key = m.model_key",
    "ge9_first_sentence": rf"WITH {_G} SELECT ord, coalesce(nullif(regexp_extract(generation, '(?s)^(.*?[.!?])(?:[{_SPACE}]|\z)', 1), ''), generation) AS first_sentence FROM v_generations",
    "ga7_han_share": rf"WITH {_G}, c AS (SELECT ord, {_count('generation', chr(92) + 'p{Han}')} AS han, {_count('generation', chr(92) + 'p{L}')} AS letters, len(list_filter(regexp_extract_all(generation, '\p{{L}}'), lambda x: regexp_matches(x, '\p{{Han}}'))) AS both_ FROM v_generations) SELECT ord, both_ AS audit_n_han_letters, both_ / nullif(letters, 0) AS audit_han_share_letters FROM c",
    "pl7_ttr_bars": f"WITH {_TTR}, j AS (SELECT n.dominio, n.categoria, ttr, n_prompt FROM n LEFT JOIN r ON n.dominio = r.dominio AND n.categoria = r.categoria) SELECT dominio, categoria, ttr, row_number() OVER (PARTITION BY dominio ORDER BY ttr NULLS FIRST, categoria) AS posizione FROM j",
    "pl2_entity_histogram": f"WITH {_ENTITIES}, v AS (SELECT dominio, log10(n_prompt_entita) AS x FROM e), m AS (SELECT min(x) AS lo, max(x) AS hi FROM v) SELECT dominio, least(floor((x - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM v, m WHERE x IS NOT NULL GROUP BY ALL",
    "ge10_few_shot": f"WITH {_G} SELECT ord, 'Continue.' || chr(10) || chr(10) || 'Prompt: A' || chr(10) || 'Continuation: b.' || chr(10) || chr(10) || 'Prompt: ' || prompt || chr(10) || 'Continuation:' AS model_input FROM v_generations",
}
