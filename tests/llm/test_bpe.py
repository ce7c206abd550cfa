import random

import numpy as np
import pytest

from promptlens.llm import arrowtext, bpe

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    return lib


def corpus(seed, n=400):
    rng = random.Random(seed)
    alphabet = ["a", "qz", "the", "é", "é", "ß", "İ", "日本", "1", "'s", "'RE", "!", "<|endoftext|>", "<|", "", "\u0085", " ", "x" * 70, "\x00", "😀", "ab", "ba"]
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6)))
    pool = [word() for _ in range(300)]
    return [rng.choice([" ", "\n", "  "]).join(rng.choice(pool) if rng.random() < 0.7 else word() for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("cache", [20, 500_000])
def test_words_are_remembered_and_forgotten(library, monkeypatch, cache):
    monkeypatch.setattr(bpe, "CACHE", cache)
    coder = bpe.ForcedBoundaryBPE(PATH)
    for text in corpus(1) * 2:
        assert np.frombuffer(coder.encode(text.encode()), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(coder.key) <= cache and len(coder.ids) == coder.at[3].sum() and len(coder.bytes) == coder.at[1].sum()


@pytest.mark.parametrize("bits", [0, 3])
def test_words_of_one_fingerprint_stay_apart(library, monkeypatch, bits):
    """With fingerprints of a few bits nearly all words collide: the bytes decide."""
    few = lambda data, lo, hi: arrowtext.word_values(data, lo, hi) % np.uint64(1 << bits)
    monkeypatch.setattr(bpe, "word_values", few)
    coder = bpe.ForcedBoundaryBPE(PATH)
    for text in [w * 3 for w in ("abcdefghij klmnopqrst abcdefghij uvwxyzabcd ", "ninecharsx otherchars ninecharsx ")]:
        assert np.frombuffer(coder.encode(text.encode()), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.ForcedBoundaryBPE(PATH.replace("word_bpe_49k", "byte_bpe_50k"))


def test_columns_with_clashing_names_and_repeated_rows(spark, library):
    rows = [(1, "Hello world", "x", 7), (1, "Hello world", "x", 7), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__text` string, `raw` int")
    out = bpe.encode(df, PATH, decoded="decoded")
    assert out.columns == ["doc_id", "text", "__text", "raw", "ids", "decoded"]
    got = [tuple(r) for r in out.orderBy("doc_id").collect()]
    ids = library.encode("Hello world", add_special_tokens=False).ids
    assert got == [(1, "Hello world", "x", 7, ids, library.decode(ids, skip_special_tokens=False))] * 2 + [(2, None, None, None, [], "")]
