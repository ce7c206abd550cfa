"""The verdict held to expectation-maximisation said again, document by document and without patterns."""

import math
import os
import random

import pytest

from promptlens.llm import quality

SF = "/root/testdata/sf0.1"


def votes_of(r):
    """The rules, in words: good, bad, or nothing."""
    n, lines = max(r["n_words"], 1), max(r["n_lines"], 1)
    mean = r["word_chars"] / n
    say = lambda good, bad: -1 if bad else 1 if good else 0
    return [
        say(False, r["n_words"] < 5),
        say(False, mean < 1.5 or mean > 20),
        say(r["n_symbols"] == 0, r["n_symbols"] * 100 > r["n_words"] * 10),
        say(r["n_dup_lines"] == 0, r["n_dup_lines"] * 10 > lines * 3),
        say(r["n_repeat_words"] == 0, r["n_repeat_words"] * 100 > n * 20),
        say(r["n_letters"] * 100 >= r["word_chars"] * 93, r["n_letters"] * 100 < r["word_chars"] * 80),
    ]


def brute(rows, strength=1000.0):
    votes = [votes_of(r) for r in rows]
    prior, chance = 0.85, [[(0.5, 0.5)] * 6, [(0.04, 0.96)] * 6]  # class: bad, good; rule: chance of a bad and a good vote

    def posterior(v):
        weigh = [math.log(1 - prior), math.log(prior)]
        for k in (0, 1):
            weigh[k] += sum(math.log(chance[k][j][x > 0]) for j, x in enumerate(v) if x)
        return 1 / (1 + math.exp(weigh[0] - weigh[1]))

    for _ in range(200):
        good = [posterior(v) for v in votes]
        old = prior, chance
        new = []
        for k, (b, g) in enumerate([(0.5, 0.5), (0.04, 0.96)]):
            line = []
            for j in range(6):
                bad_votes = sum((p if k else 1 - p) for p, v in zip(good, votes) if v[j] < 0) + strength * b
                good_votes = sum((p if k else 1 - p) for p, v in zip(good, votes) if v[j] > 0) + strength * g
                line.append((bad_votes / (bad_votes + good_votes), good_votes / (bad_votes + good_votes)))
            new.append(line)
        prior, chance = (sum(good) + strength * 0.85) / (len(votes) + strength), new
        if abs(prior - old[0]) + max(abs(a - b) for k in (0, 1) for x, y in zip(chance[k], old[1][k]) for a, b in zip(x, y)) < 1e-10:
            break
    return [posterior(v) for v in votes]


def test_verdict(spark):
    rng = random.Random(3)
    words = ["the", "a", "naïve", "house", "x#y", "|", "12", "...", "foo", "bar", "same", "line\n", "Same line here\n", "%%%"]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 8, 14])]) for _ in range(rng.randint(0, 60))) for _ in range(250)] + [None, "", "one two three four five six seven eight nine ten eleven"] * 2
    rows = [r.asDict() for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert {r["kept"] for r in rows} == {True, False}
    for r, p in zip(rows, brute(rows), strict=True):
        assert r["votes"] == votes_of(r) and r["p_good"] == pytest.approx(p, abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_labels_that_no_rule_has_seen(spark):
    """The model has no labels; over those of the table it finds most bad documents that the base rule keeps, and few good ones."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.99 * len(good)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 5), (1, "a b c", 5, 5)], "doc_id long, text string, kept int, n_words int")
    assert [r.n_words for r in quality.judge(df).collect()] == [3, 3]
