import math
import random
import zlib
from collections import Counter

import pytest

from promptlens.llm.katz import CUT, discounts, katz_scores


def tokens(t):
    return ["".join(c.lower() if c.isascii() else c for c in w.decode()) for w in (t or "").encode().split()] + ["</s>"]


class Brute:
    def __init__(self, docs, least=2):
        train = [tokens(t) for d, t in docs if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
        self.c = Counter(w for t in train for w in t)
        self.total = sum(self.c.values())
        pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
        self.ctx = Counter(p for t in train for p in ["<s>", *t[:-1]])
        d1 = discounts(Counter(c for c in self.c.values() if c <= CUT + 1))
        given = sum((d1[c - 1] if c <= CUT else 1) * c for c in self.c.values())
        shrink = 1.0 if given < self.total or not self.total else self.total / (self.total + 1)
        self.uni = {w: shrink * (d1[c - 1] if c <= CUT else 1) * c / self.total for w, c in self.c.items()}
        self.unseen = 1 - sum(self.uni.values()) if self.total else 1.0
        d2 = discounts(Counter(c for c in pairs.values() if c <= CUT + 1))
        self.bi = {}
        for (h, w), c in pairs.items():
            if c >= least:
                self.bi.setdefault(h, {})[w] = (d2[c - 1] if c <= CUT else 1) * c / self.ctx[h]
        self.alpha = {}
        for h, s in self.bi.items():
            most = 1 - 1 / (self.ctx[h] + 1)
            kept = sum(s.values())
            if kept > most:
                self.bi[h] = s = {w: p * most / kept for w, p in s.items()}
            self.alpha[h] = (1 - sum(s.values())) / (1 - sum(self.uni[w] for w in s))

    def p(self, w, h):
        if w in self.bi.get(h, {}):
            return self.bi[h][w]
        return self.alpha.get(h, 1.0) * self.uni.get(w, self.unseen)

    def row(self, d, t):
        tk = tokens(t)
        base = sum(math.log10((self.c[w] + 0.1) / (self.total + 0.1 * (len(self.c) + 1))) for w in tk)
        score = sum(math.log10(self.p(w, h)) for h, w in zip(["<s>", *tk], tk))
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
        return d, held, len(tk), sum(self.c[w] > 0 for w in tk), self.total, base, score


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(200)] + ["é", "É", "日本"]
    docs = []
    for i in range(n):
        w, out = rng.choice(vocab), []
        for _ in range(rng.randint(0, 60)):
            out.append(w)
            w = vocab[(vocab.index(w) * 7 + rng.randrange(3)) % len(vocab)] if w in vocab and rng.random() < 0.8 else rng.choice([rng.choice(vocab), rng.choice(vocab) + str(rng.randrange(9))])
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(out)))
    return [*docs, (None, "W1 w2"), (7, None), (7, "W3 " * 300), (10**12, ""), (5, "never seen before")]


@pytest.mark.parametrize("n,parts,hot", [(400, 5, None), (400, 4, 0.003), (30, 1, 0.01), (0, 3, None)])
def test_matches_brute_force_and_sums_to_one(spark, n, parts, hot):
    docs = corpus(n, n)
    brute = Brute(docs)
    for h in [*list(brute.bi)[:50], "nowhere"]:
        assert abs(sum(brute.p(w, h) for w in brute.c) + brute.alpha.get(h, 1.0) * brute.unseen - 1) < 1e-9
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, p int").repartition(3)
    got = sorted((tuple(r) for r in katz_scores(df, partitions=parts, hot_share=hot).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted((brute.row(*d) for d in docs), key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-7) and g[6] == pytest.approx(w[6], abs=1e-7)
    if n >= 400:
        held = [r for r in got if r[1]]
        assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_empty(spark):
    assert katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
