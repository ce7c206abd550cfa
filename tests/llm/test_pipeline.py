import random

import pytest

import corpus_pipeline as cp
from tests.llm.test_jaccard import shingles
from tests.llm.test_substring import brute_bytes


def documents(seed=3):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(500)] + ["é", "straße", "日本語"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = line(60)
    docs = [(i, line(rng.randint(20, 200)), "en", rng.choice(["a", "b", None])) for i in range(80)]
    docs += [(100 + i, docs[i][1], "fr", "b") for i in range(10)]
    docs += [(120 + i, line(40) + " " + passage + " " + line(30), "de", "c") for i in range(12)]
    docs += [(140, None, "en", "a"), (141, "", "en", "a"), (142, "x " * 200, "en", "a"), (143, "### | ### " * 8, None, "a"), (None, line(50), "en", "a"), (5, docs[5][1], "en", "b"), (144, line(40), None, None)]
    return [(d, t, lang, s, len(t) if t else None) for d, t, lang, s in docs]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = documents()
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    kept = frame(spark, docs)
    seen = []
    for name, stage in cp.STAGES:
        before = [tuple(r) for r in kept.collect()]
        out = stage(spark, kept, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        seen.append((name, before, [tuple(r) for r in kept.collect()]))
        if name != "bpe":
            assert kept.columns == list(cp.COLUMNS)
    (_, raw, good), (_, _, alone), (_, _, clean), (_, _, mixed), (_, _, coded) = seen
    ids = [r[0] for r in good]
    assert not {140, 141, 142, 143} & set(ids) and set(range(80)) <= set(ids) and None in ids
    assert set(good) <= set(raw)
    # one of each group stays
    sets = {r: shingles(r[1], 5) for r in good}
    want = {r for r in good if not any(100 * len(sets[r] & sets[o]) >= 80 * len(sets[r] | sets[o]) and (o[0] is None, o[0] or 0, str(o)) < (r[0] is None, r[0] or 0, str(r)) for o in good if o != r)}
    assert {r[:2] for r in alone} == {r[:2] for r in want} and len(alone) == len(want)
    brute = {(d, k) for d, _, _, _, k in brute_bytes([(r[0], r[1]) for r in alone], 200)}
    assert {(r[0], r[1].encode()) for r in clean} == brute and all(r[4] == len(r[1]) for r in clean)
    assert all(mixed.count(r) <= 2 * clean.count(r) for r in mixed) and set(mixed) <= set(clean)
    size = lambda rows: sum(len(r[1].split()) for r in rows)
    assert abs(size(mixed) - 1.5 * size(clean)) < 0.1 * size(clean)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(cp.vocabulary())
    assert sorted((str(r[0]), r[3]) for r in coded) == sorted((str(r[0]), lib.encode(r[1], add_special_tokens=False).ids) for r in mixed)
    assert sorted(map(str, cp.run(spark, str(tmp_path)).collect())) == sorted(map(str, kept.collect()))


def test_empty(spark):
    docs = frame(spark, [])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_one_row(spark, name):
    text = " ".join(f"plain{i}" for i in range(30))
    out = dict(cp.STAGES)[name](spark, frame(spark, [(1, text, "en", "a", len(text))]), "")
    assert out.count() in ((1, 2) if name == "mixing" else (1,))
