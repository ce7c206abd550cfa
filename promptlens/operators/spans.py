"""Entity spans: finding dictionary terms, merging them with recognised entities, splicing, review.

Spans count code points from 0, their end excluded. Finding and merging walk a text from left to
right with state, so they run in Python, a piece of an Arrow batch at a time; all else is column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.functions import rows
from promptlens.functions import text as T
from promptlens.operators.anonymize import PEOPLE, residual_name, review_columns, terms_by_domain

_STRUCT = "struct<start_char:int,end_char:int,source:string>"
_ENTITY = "struct<start_char:int,end_char:int,entity:string>"
ENTITY_JSON = f"array<{_ENTITY}>"
RESULT = f"struct<spans:array<{_STRUCT}>,decisions:array<struct<start_char:int,end_char:int,entity:string,decision:string>>,conflict:boolean>"
_SPANS = pa.list_(pa.struct({"start_char": pa.int32(), "end_char": pa.int32(), "source": pa.string()}))
_DECISIONS = pa.list_(pa.struct({"start_char": pa.int32(), "end_char": pa.int32(), "entity": pa.string(), "decision": pa.string()}))
_MERGED = pa.struct({"spans": _SPANS, "decisions": _DECISIONS, "conflict": pa.bool_()})


def clean_person_span(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Without outer white space and a closing 's; None if nothing is left."""
    if not 0 <= start <= end <= len(text):
        raise ValueError("span outside the text")
    piece = text[start:end]
    start += len(piece) - len(piece.lstrip())
    end = start + len(piece.strip())
    if text[start:end].endswith(("'s", "’s")):
        end -= 2
    return (start, end) if end > start else None


def locate(text: str | None, pattern: regex.Pattern | None) -> list[dict]:
    """All matches, from left to right."""
    return [] if text is None or pattern is None else [{"start_char": m.start(), "end_char": m.end(), "source": "dictionary"} for m in pattern.finditer(text)]


def compiled(aliases: Iterable[str]) -> regex.Pattern | None:
    """The dictionary's pattern for Python, which also sees letters beyond the basic plane before a term."""
    known = sorted({a for a in aliases if a}, key=lambda a: (-len(a), a))
    if not known:
        return None
    return regex.compile(r"(?<![\p{L}\p{N}_])(?:" + "|".join(regex.escape(a) for a in known) + r")(?![\p{L}\p{N}_])", regex.I)


def merge(text: str, dictionary: list[dict], entities: list[dict]) -> dict:
    """Dictionary spans in their order, the first of overlapping ones; then entities.

    An entity apart from all spans is added; one that a span contains is covered (with both sources
    if they are equal); any other overlap is a conflict and changes nothing.
    """
    for s in (*dictionary, *entities):
        if not 0 <= s["start_char"] < s["end_char"] <= len(text):
            raise ValueError(f"span outside the text: {s}")
    for e in entities:
        if text[e["start_char"] : e["end_char"]] != e["entity"]:
            raise ValueError(f"entity is not what stands there: {e}")
    apart = lambda a, b: a["end_char"] <= b["start_char"] or b["end_char"] <= a["start_char"]
    spans: list[dict] = []
    for s in dictionary:
        if all(apart(s, t) for t in spans):
            spans.append({"start_char": s["start_char"], "end_char": s["end_char"], "source": "dictionary"})
    decisions, conflict = [], False
    for e in entities:
        near = [s for s in spans if not apart(e, s)]
        cover = [s for s in near if s["start_char"] <= e["start_char"] and e["end_char"] <= s["end_char"]]
        if not near:
            spans.append({"start_char": e["start_char"], "end_char": e["end_char"], "source": "ner"})
            kind = "added"
        elif cover:
            kind = "covered"
            if (cover[0]["start_char"], cover[0]["end_char"]) == (e["start_char"], e["end_char"]) and cover[0]["source"] == "dictionary":
                cover[0]["source"] = "dictionary+ner"
        else:
            kind, conflict = "conflict", True
        decisions.append({"start_char": e["start_char"], "end_char": e["end_char"], "entity": e["entity"], "decision": kind})
    return {"spans": sorted(spans, key=lambda s: s["start_char"]), "decisions": decisions, "conflict": conflict}


def _merged(text: str | None, dictionary: list[dict] | None, entities: list[dict] | None) -> dict:
    return {"spans": [], "decisions": [], "conflict": False} if text is None else merge(text, dictionary or [], entities or [])


def merge_spans(text: Column, dictionary: Column, entities: Column) -> Column:
    """merge() for each row, as a struct of spans, decisions and conflict."""
    return rows.mapped(lambda: _merged, _MERGED, text, dictionary, entities, returns=RESULT)


def splice(text: Column, spans: Column, placeholder: str = "Person") -> Column:
    """The text with a placeholder for each of the sorted, disjoint spans."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.concat(a["out"], F.substring(text, a["at"] + 1, s["start_char"] - a["at"]), F.lit(placeholder)).alias("out"), s["end_char"].alias("at")
    )
    end = F.aggregate(F.array_sort(spans, lambda a, b: a["start_char"] - b["start_char"]), start, step)
    return F.when(text.isNotNull() & spans.isNotNull(), F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))).otherwise(text)


def _finder(dictionary: DataFrame) -> Callable[[], Callable[[str | None, str, str], list[dict]]]:
    """Makes a function, once for a task, of a text, its domain and subject: the places of the domain's terms, then of the subject's."""
    base, own = terms_by_domain(dictionary)

    def make():
        by_domain = {d: compiled(a) for d, a in base.items()}
        by_subject = {(d, s): compiled(a) for d, each in own.items() for s, a in each.items()}
        return lambda t, d, s: locate(t, by_domain.get(d)) + locate(t, by_subject.get((d, s)))

    return make


def dictionary_spans(df: DataFrame, dictionary: DataFrame, text: str = "text_full", out: str = "dictionary_spans") -> DataFrame:
    """All places of the terms of a row's domain, then those of its subject; domain and subject must be there."""
    rows.small_batches(df.sparkSession)
    return df.withColumn(out, rows.mapped(_finder(dictionary), _SPANS, F.col(text), F.col("domain"), F.col("subject"), returns=f"array<{_STRUCT}>"))


def found_and_merged(df: DataFrame, dictionary: DataFrame, text: str, entities: str, out: str) -> DataFrame:
    """dictionary_spans() and merge_spans() in one: a text goes to one worker, once."""
    rows.small_batches(df.sparkSession)
    finder = _finder(dictionary)

    def make():
        find = finder()
        return lambda t, d, s, e: _merged(t, find(t, d, s), e)

    return df.withColumn(out, rows.mapped(make, _MERGED, F.col(text), F.col("domain"), F.col("subject"), F.col(entities), returns=RESULT))


def ner_input(df: DataFrame) -> DataFrame:
    """Distinct prepared texts about people, each with a stable id."""
    some = df.where((F.col("text_preparation_status") == "prepared") & F.col("domain").isin(*PEOPLE)).select("text_full").distinct()
    return some.select(F.sha2("text_full", 256).alias("text_id"), "text_full")


def recognize(texts: DataFrame, recognizer, batch: int = 64) -> DataFrame:
    """entities_json for each text by an injected recogniser of a list of texts: lists of (start, end, label).

    Only PERSON is kept, without outer white space and possessives.
    """

    rows.small_batches(texts.sparkSession)

    def run(batches):
        for some in batches:
            for lo in range(0, some.num_rows, batch):
                ids, part = (c.slice(lo, batch) for c in some.columns)
                part, out = part.to_pylist(), []
                for text, found in zip(part, recognizer(part), strict=True):
                    spans = [clean_person_span(text, a, b) for a, b, label in found if label == "PERSON"]
                    out.append(json.dumps([{"start_char": a, "end_char": b, "entity": text[a:b]} for a, b in filter(None, spans)], ensure_ascii=False))
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], ["text_id", "entities_json"])

    return texts.select("text_id", "text_full").mapInArrow(run, "text_id string, entities_json string")


def combine(masked: DataFrame, dictionary: DataFrame, entities: DataFrame, version: str = "dictionary_ner_v1") -> DataFrame:
    """Masked rows again, by the dictionary's and the recognised spans of the original text.

    Earlier columns stay under names ending in _dictionary. The dictionary's spans alone must give
    the earlier masked text; a row where they do not is an error. `entities`: text_id, entities_json.
    """
    old = [c for c in masked.columns if c in ("text_anonymized", "prompt_anonymized", "eligible_anonymized_metrics") or c.startswith("anonymization_")]
    df = masked.select("*", *(F.col(c).alias(f"{c}_dictionary") for c in old))
    scope = (F.col("text_preparation_status") == "prepared") & F.col("domain").isin(*PEOPLE)
    df = df.withColumn("ner_text_id", F.when(scope, F.sha2("text_full", 256)))
    named = entities.select(F.col("text_id").alias("__t"), F.from_json("entities_json", ENTITY_JSON).alias("__e"))
    df = df.join(named, F.col("ner_text_id") == F.col("__t"), "left").drop("__t")
    df = found_and_merged(df.withColumn("__text", F.when(scope, F.col("text_full"))), dictionary, "__text", "__e", "__m")
    df = df.withColumns({"ner_spans": F.when(scope, F.col("__m.spans")), "ner_decisions": F.when(scope, F.col("__m.decisions"))})
    only = F.filter("ner_spans", lambda s: s["source"] != "ner")
    replay = splice(F.col("text_full"), only)
    text = F.when(replay.eqNullSafe(F.col("text_anonymized_dictionary")), splice(F.col("text_full"), F.col("ner_spans"))).otherwise(F.raise_error(F.lit("the dictionary's spans do not give its masked text")))
    length = F.length("prompt")
    inside = F.transform(F.filter("ner_spans", lambda s: s["start_char"] < length), lambda s: F.struct(s["start_char"].alias("start_char"), F.least(s["end_char"], length).alias("end_char"), s["source"].alias("source")))
    df = df.withColumn("__p", inside)
    pick = lambda new, c: F.when(scope, new).otherwise(F.col(c))
    df = df.withColumns(
        {
            "text_anonymized": pick(text, "text_anonymized"),
            "prompt_anonymized": pick(splice(F.col("prompt"), F.col("__p")), "prompt_anonymized"),
            "anonymization_n_replacements": pick(F.size("ner_spans"), "anonymization_n_replacements"),
            "anonymization_n_prompt_replacements": pick(F.size("__p"), "anonymization_n_prompt_replacements"),
            "anonymization_policy": F.lit(version),
            "ner_applied": scope,
            "ner_n_added": F.when(scope, F.size(F.filter("ner_spans", lambda s: s["source"] == "ner"))).otherwise(0),
            "ner_overlap_conflict": F.when(scope, F.col("__m.conflict")).otherwise(False),
            "ner_crosses_prompt_boundary": F.when(scope, F.exists("ner_spans", lambda s: (s["start_char"] < length) & (s["end_char"] > length))).otherwise(False),
        }
    )
    return update_review(df.drop("__e", "__m", "__p", "__text"), dictionary)


def update_review(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Status, residual names, review and eligibility after spans were merged; the language gate stays."""
    ready, scope = F.col("text_preparation_status") == "prepared", F.col("ner_applied")
    status = F.when(F.col("anonymization_n_replacements") == 0, "no_entity_match").when(F.col("anonymization_n_prompt_replacements") == 0, "no_prompt_match").otherwise("applied")
    df = df.withColumns({"anonymization_status": F.when(scope, status).otherwise(F.col("anonymization_status")), "anonymization_residual_name_candidate": T.flag(ready & F.col("domain").isin(*PEOPLE) & residual_name(F.col("subject"), F.col("text_anonymized")))})
    df = df.drop("anonymization_review_required", "anonymization_review_reason", "eligible_anonymized_metrics")
    return review_columns(df, dictionary, ((F.col("ner_overlap_conflict"), "overlap_conflict"), (F.col("ner_crosses_prompt_boundary"), "crosses_prompt_boundary")))


def combined_summary(df: DataFrame) -> DataFrame:
    n = F.count_if
    return df.groupBy("model_key", "domain").agg(
        F.count("*").alias("n_records"), n(F.col("text_preparation_status") == "prepared").alias("n_prepared"), n("ner_applied").alias("n_ner"), n(F.col("text_anonymized") != F.col("text_anonymized_dictionary")).alias("n_changed"),
        F.sum("ner_n_added").alias("n_added_mentions"), n("ner_overlap_conflict").alias("n_overlap_conflicts"), n("anonymization_review_required").alias("n_review"), n("eligible_anonymized_metrics").alias("n_eligible"),
    )


def span_log(df: DataFrame, key: tuple[str, ...] = ("model_key", "prompt_id", "repetition")) -> DataFrame:
    """One row a span with what stood there.

    The outer form, whose empty rows are dropped after it: Spark lets no filter on the spans slip below their
    step, which would then run twice.
    """
    out = df.where("ner_applied").select(*key, "text_full", F.explode_outer("ner_spans").alias("s")).where("s IS NOT NULL")
    return out.select(*key, "s.*", F.substring("text_full", F.col("s.start_char") + 1, F.col("s.end_char") - F.col("s.start_char")).alias("entity"))


def decision_log(df: DataFrame, key: tuple[str, ...] = ("model_key", "prompt_id", "repetition")) -> DataFrame:
    """One row a recognised entity and what became of it; the outer form as in span_log()."""
    return df.where("ner_applied").select(*key, F.inline_outer("ner_decisions")).where("decision IS NOT NULL")


def person_preview(text: str, entities: list[dict]) -> str:
    """Splice Person at PERSON entities; overlapping or wrong ones are errors."""
    some = sorted((e for e in entities if e.get("label", "PERSON") == "PERSON"), key=lambda e: e["start_char"])
    out, at = [], 0
    for e in some:
        if e["start_char"] < at or not e["start_char"] < e["end_char"] <= len(text) or text[e["start_char"] : e["end_char"]] != e["entity"]:
            raise ValueError(f"overlapping or wrong entity: {e}")
        out += [text[at : e["start_char"]], "Person"]
        at = e["end_char"]
    return "".join([*out, text[at:]])


def pilot_sample(texts: DataFrame, n: int, diagnostic: str) -> DataFrame:
    """n texts by a stable hash, and the first text outside them that holds `diagnostic`, marked by sample_kind.

    n is the feature's limit.
    """
    drawn = texts.orderBy(F.md5(F.concat(F.lit("42:"), "text_id").cast("binary")), "text_id").limit(n).withColumn("sample_kind", F.lit("random"))
    rest = texts.where(F.contains("text_full", F.lit(diagnostic))).join(drawn.select("text_id"), "text_id", "left_anti")
    return drawn.unionByName(rest.orderBy("text_id").limit(1).withColumn("sample_kind", F.lit("diagnostic")).select(*drawn.columns))


def pilot(texts: DataFrame, recognizer, batch: int = 64) -> tuple[DataFrame, dict[str, float]]:
    """Entities of a sample, one row each, and how long recognition took for how many texts."""
    import time

    began = time.perf_counter()
    found = recognize(texts, recognizer, batch).persist()
    n = found.count()
    took = time.perf_counter() - began
    rows = found.select("text_id", F.inline(F.from_json("entities_json", ENTITY_JSON)))
    return rows, {"texts": n, "seconds": took, "texts_per_second": n / took if took else 0.0}
