"""Around the generation of continuations: model inputs, batches and resuming, sentence ends, templates.

Models are injected: a generator is a function of (list of inputs, seed) that returns as many texts.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from promptlens.functions import text as T

# Abbreviations that no sentence ends with, and what may close a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof rev hon st sr jr gen lt col capt sgt sen rep gov vs etc fig eq vol no pp ed inc ltd corp co dept approx est jan feb mar apr jun jul aug sep sept oct nov dec".split())
CLOSERS = "\"'’”)]}"
_DIGIT = r"[\p{Nd}\p{Numeric_Type=Digit}]"
#: A stop that ends a sentence, with what closes it: marks count always, a full stop unless one of these stands around it.
SENTENCE_END = regex.compile(
    rf"""(?: [!?]
    | (?<!\.) \. (?!\.)                                            # no ellipsis
      (?<! {_DIGIT} \. (?= {_DIGIT} ) )                             # no number
      (?<! (?<![A-Za-z]) (?: [A-Z] | (?i: {"|".join(sorted(ABBREVIATIONS))} ) ) \. )  # no initial, no abbreviation
      (?<! (?: (?<![\w\p{{No}}]) [A-Za-z] \. )+ [A-Za-z] \. )                      # no acronym
    ) [{regex.escape(CLOSERS)}!?]*+ (?= [\s\x1c-\x1f] | \Z )""",
    regex.X,
)


def model_input(prompt: Column, mode: str = "raw", prefix: str | None = None) -> Column:
    """The prompt as it is, or after an instruction."""
    if mode == "raw":
        if prefix:
            raise ValueError("raw mode takes no prefix")
        return prompt
    if mode != "instruction_prefix":
        raise ValueError(f"unknown mode: {mode}")
    if prefix is None or not prefix.strip():
        raise ValueError("a prefix must not be blank")
    return F.concat(F.lit(prefix), prompt)


def few_shot(prompt: Column, examples: list[tuple[str, str]], instruction: str) -> Column:
    """An instruction, examples, and the prompt left open."""
    shown = "\n\n".join(f"Prompt: {a}\nContinuation: {b}" for a, b in examples)
    return F.concat(F.lit(f"{instruction}\n\n{shown}\n\nPrompt: "), prompt, F.lit("\nContinuation:"))


first_sentence = T.first_sentence


def completion(ids: Column, ends: list[int]) -> tuple[Column, Column]:
    """How many ids stand before the first end token, and whether there was one."""
    place = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), F.size(ids)), lambda i: F.when(F.element_at(ids, i).isin(*ends), i)), lambda i: i.isNotNull()))
    place = F.when(F.size(ids) > 0, place)
    return F.coalesce(place - 1, F.size(ids)), F.when(place.isNotNull(), "eos_token").otherwise("max_new_tokens")


def sentence_end(prompt: str, continuation: str, final: bool = False) -> int | None:
    """Where in the continuation its first sentence ends, or None.

    Boundaries wholly inside the prompt do not count, but what stands there is seen. Without `final`,
    more text must follow, so that a stop just generated is not taken for the end.
    """
    whole = prompt + continuation
    found = SENTENCE_END.search(whole, len(prompt))
    if found is None or not (final or whole[found.end() :].strip()):
        return None
    return found.end() - len(prompt)


def trim_to_sentence(df: DataFrame, prompt: str = "prompt", raw: str = "generation_raw") -> DataFrame:
    """sentence_end_char (null without a boundary) and generation, cut there."""

    @F.pandas_udf("int")
    def run(prompts: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or t is None else sentence_end(p, t, final=True) for p, t in zip(prompts, texts, strict=True)], dtype="Int32")

    df = df.withColumn("sentence_end_char", run(F.col(prompt), F.col(raw)))
    return df.withColumn("generation", F.when(F.col("sentence_end_char").isNull(), F.col(raw)).otherwise(F.substring(F.col(raw), F.lit(1), F.col("sentence_end_char"))))


def batches(occurrences: DataFrame, size: int, base_seed: int) -> DataFrame:
    """batch_index and batch_seed from the record's place: the same whatever is already done."""
    index = F.floor((F.col("record_order") - 1) / size)
    return occurrences.withColumns({"batch_index": index, "batch_seed": F.lit(base_seed) + index})


def unexpected(done: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Finished records that no occurrence asks for."""
    return done.join(occurrences.select("record_id"), "record_id", "left_anti")


def load_checkpoint(done: DataFrame) -> DataFrame:
    """Finished records; a missing or repeated record_id is an error."""
    if "record_id" not in done.columns:
        raise ValueError("no record_id")
    r = done.agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("d")).first()
    if r.n != r.d:
        raise ValueError(f"{r.n - r.d} records without an id or with one that others have")
    return done


def generate(occurrences: DataFrame, generator: Callable[[list[str], int], list[str]], size: int = 8, base_seed: int = 42, done: DataFrame | None = None) -> DataFrame:
    """generation and status for each occurrence that no finished batch holds.

    A batch is generated as a whole, so a batch with any record missing is done again. Blank inputs
    are skipped. Batches are spread over the cluster; one is never split.
    """
    todo = batches(occurrences, size, base_seed)
    if done is not None:
        have = load_checkpoint(done).select("record_id", F.lit(True).alias("__done"))
        state = todo.join(have, "record_id", "left").groupBy("batch_index").agg(F.count("*").alias("n"), F.count("__done").alias("d"))
        todo = todo.join(state.where("n > d").select("batch_index"), "batch_index", "left_semi").select(*todo.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("record_order")
        blank = pdf["model_input"].isna() | (pdf["model_input"].fillna("").str.strip() == "")
        texts = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
        if (~blank).any():
            made = generator(pdf.loc[~blank, "model_input"].tolist(), int(pdf["batch_seed"].iloc[0]))
            if len(made) != (~blank).sum():
                raise ValueError("the generator returned another number of texts")
            texts[~blank] = made
        return pdf.assign(generation=texts, status=["skipped_empty_prompt" if b else "ok" for b in blank])

    schema = S.StructType([*todo.schema.fields, S.StructField("generation", S.StringType()), S.StructField("status", S.StringType())])
    return todo.groupBy("batch_index").applyInPandas(run, schema)


def http_generator(url: str, model: str, options: dict | None = None, timeout: float = 120.0) -> Callable[[list[str], int], list[str | None]]:
    """A generator that asks a local model server for each text; a failed call gives None instead of ending the run.

    The server takes {"model", "prompt", "options", "stream": false} and answers {"response"}.
    """
    import json
    import urllib.request

    def run(texts: list[str], seed: int) -> list[str | None]:
        out: list[str | None] = []
        for text in texts:
            body = json.dumps({"model": model, "prompt": text, "options": {**(options or {}), "seed": seed}, "stream": False}).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                    out.append(json.load(answer)["response"])
            except (OSError, ValueError, KeyError):
                out.append(None)
        return out

    return run


def server_has(url: str, model: str, timeout: float = 5.0) -> bool:
    """Whether a model server answers and lists the model ({"models": [{"name"}]})."""
    import json
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return any(m.get("name", "").split(":")[0] == model.split(":")[0] for m in json.load(answer).get("models", []))
    except (OSError, ValueError):
        return False
