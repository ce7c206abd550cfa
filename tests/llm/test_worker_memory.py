"""What a Python worker holds while it encodes, and after it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from promptlens.llm import arrowtext, bpe

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")


def task_of(module):
    """What a task of a module's operator does to a worker before its first batch."""

    def run(batches):
        yield from batches

    run.__module__ = module
    list(arrowtext.trimmed(run)(iter([])))


def test_encoding_a_batch_takes_a_bounded_room(spark, monkeypatch):
    runs = []
    monkeypatch.setattr(bpe, "trimmed", lambda run: runs.append(run) or run)
    bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, decoded="decoded")
    rng = random.Random(1)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(pool, k=1000)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(texts)], ["doc_id", "text", "raw"])
    bpe.coder(PATH)
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in runs[0](iter([batch])))
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert rows == len(texts) and peak < 40e6, peak


def test_long_words_are_encoded_whole_but_not_remembered():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    coder, rng = bpe.ForcedBoundaryBPE(PATH), random.Random(2)
    for _ in range(3):
        long = ["".join(rng.choice("abcdé") for _ in range(5000)) for _ in range(40)]
        text = " ".join([*long, "short words stay", *long])
        assert np.frombuffer(coder.encode(text.encode()), np.int32).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(coder.key) == 3 and len(coder.bytes) == len("shortwordsstay")


def test_decoding_many_is_decoding_each():
    coder = bpe.ForcedBoundaryBPE(PATH)
    lists = [[], [5], list(range(400, 420)), [5, 5], []]
    assert coder.texts(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == [coder.decode(x) for x in lists]


@pytest.mark.parametrize("module, stays", [("promptlens.llm.quality", False), ("promptlens.llm.bpe", True)])
def test_other_operators_let_the_encoder_go(module, stays):
    bpe.coder(PATH)
    task_of(module)
    assert (bpe.coder.cache_info().currsize > 0) == stays


@pytest.mark.parametrize("module, stays", [("promptlens.llm.bpe", False), ("promptlens.llm.substring", True)])
def test_other_operators_let_the_powers_go(module, stays):
    before = [x.copy() for x in arrowtext.powers(1000)]
    task_of(module)
    assert all((len(x) >= 1000) == stays for x in arrowtext._powers[arrowtext.PRIME])
    assert all((x == y).all() for x, y in zip(arrowtext.powers(1000), before, strict=True))
