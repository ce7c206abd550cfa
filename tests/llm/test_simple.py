import hashlib
import random

import pytest

from promptlens.llm import bpe, html, mixing, quality, sharding

PATH = __import__("public_tokenizers").path("word_bpe_49k.json")


def texts():
    rng = random.Random(4)
    alphabet = ["a", "b", "th", "é", "É", "ß", "İ", "Σ", "日本", "1", "2", "'s", "'LL", "!", ".", "́", " ", " ", "\x1c", "\x00", "😀", "<|endoftext|>", "<|EndOfText|>", "<|", " ", "\n", "\t", "Hello", "world", "_", "½", "é", "\u0085", "ǅ", "ﬁ", "\x7f"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    return out + ["", " ", "Don't STOP<|startoftext|>now", "x" * 3000, "zqxj qqqq wvvvk jjj", "word " * 500, None]


def test_bpe_matches_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    docs = texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, ids long")
    got = {r.doc_id: r for r in bpe.encode(df, PATH, decoded="decoded").collect()}
    for i, t in enumerate(docs):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids, (t, got[i].ids, ids)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(df, PATH), PATH).select("doc_id", "decoded").collect()
    assert all(got[r.doc_id].decoded == r.decoded for r in again)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_cuts_are_certain():
    from tokenizers import Tokenizer

    coder, library = bpe.ForcedBoundaryBPE(PATH), Tokenizer.from_file(PATH)
    assert any(len(coder.cuts(w)) > 1 for w in ("zqxj", "qqjjxx", "vkqz"))
    for w in ("zqxj", "hello", "qqjjxx", "vkqz"):
        assert coder.encode(w.encode()) == __import__("numpy").array(library.encode(w, add_special_tokens=False).ids, "int32").tobytes()


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 251)
    # brute force: every shard claims the best free slot of its full preference list, in turns
    number = lambda s, salt: int.from_bytes(hashlib.sha256(f"{salt}:{s}".encode()).digest()[:8], "big")
    order = {s: [(number(s, "offset") % 251 + j * (number(s, "skip") % 250 + 1)) % 251 for j in range(251)] for s in names}
    taken = {}
    while len(taken) < 251:
        for i, s in enumerate(names):
            if len(taken) < 251:
                taken[next(x for x in order[s] if x not in taken)] = i
    assert table == [taken[i] for i in range(251)]
    assert max(map(table.count, range(7))) - min(map(table.count, range(7))) <= 1
    fewer = sharding.lookup_table(names[:-1], 251)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 251 * 0.35
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2**40, None)], "doc_id long, slot string")
    rows = sharding.assign_shards(df, "doc_id", names, 251).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == 1}) == 1
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 251 and r.shard == names[table[r.slot]]
    assert sharding.assign_shards(df.limit(0), "doc_id", names, 251).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "b", "b", "b", "c", "é", "Z", None])) for i in range(3000)]
    docs += [(None, "x y", "a"), (5, None, "a"), (7, "", "empty"), (7, "", "empty")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, size int")
    rows = mixing.systematic_mix(df).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    took = {}
    for r in rows:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.copies * r.size
        took[r.source] = took.get(r.source, 0) + r.taken
    assert len(rows) == len(docs)
    assert all(abs(took[s] - want[s]) <= max(60, 0.03 * want[s]) for s in took)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.systematic_mix(df.repartition(3)).collect()))
    assert mixing.systematic_mix(df.limit(0)).count() == 0


def brute_counts(text):
    b = (text or "").encode()
    w = b.split()
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {j for p in seen.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in b.split(b"\n") if x.split()]
    return len(w), sum(len(x.decode()) for x in w), sum(b.count(c) for c in b"#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rng = random.Random(9)
    pool = ["the", "a", "é#", "日本", "x|y", "\n", "\n", "\r", "\t", "foo bar", "same line here\n", "&amp;"]
    docs = [rng.choice(["", " "]).join(rng.choice(pool) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["", None, "\n\n", "Is " * 40]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(docs)], "doc_id long, text string, kept string")
    for r in quality.judge(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute_counts(r.text), r
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.judge(df.limit(0)).count() == 0


def test_label_model_finds_accuracies():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    acc = [0.95, 0.8, 0.65, 0.9]
    votes = np.stack([np.where(rng.random(20000) < 0.2, 0, np.where(rng.random(20000) < a, truth, ~truth) * 2 - 1) for a in acc], 1)
    pat, n = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(pat, n.astype(float), strength=1e-3)
    assert abs(model.prior - 0.7) < 0.05
    right = ((model.posterior(votes) > 0.5) == truth).mean()
    assert right > 0.93
    assert np.abs(model.chance[1, :, 1] - acc).max() < 0.05 and np.abs(model.chance[0, :, 0] - acc).max() < 0.08


def test_html_extraction(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=1>Menu</a></ul></nav><div class="cookie-notice">We use cookies, a lot, really.</div>
<div id="wrap"><div class="content"><h1>A &amp; B</h1><p>First   paragraph, with commas, and <a href=x>a link</a>, and more words here.<p>Second one&nbsp;is
 long enough, too, to be scored as a paragraph.<script>bad()</script><br>after<ul><li>item one<li>item two</ul><blockquote>quoted words</blockquote></div>
<aside>Side</aside><div class="comments"><p>A reader comment, with commas, and length, that must not show.</p></div></div>
<form><p>Subscribe now, please, it is free, and good.</p></form><footer>&copy; 2020</footer></body></html>"""
    want = "A & B\nFirst paragraph, with commas, and a link, and more words here.\nSecond one is long enough, too, to be scored as a paragraph. after\nitem one\nitem two\nquoted words"
    pages = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>short"), (5, "u", "<article><p>Cut off here &lt;b&gt; <a hre"), (6, "u", "<div>" * 5000 + "deep text, very deep, in the page" + "</div>" * 5000), (7, None, "no tags at all, just text that is long")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract_text(df).collect()}
    assert got[1] == want
    assert got[2] == got[3] == "" and got[4] == "short" and got[5] == "Cut off here <b>" and got[6].startswith("deep") and got[7].startswith("no tags")
    assert html.extract_text(df.limit(0)).count() == 0


PARAGRAPHS = ["First paragraph of the story, with commas, several words, and enough text to score well.", "Second paragraph goes on, at some length, to say more about the same subject, and ends.", "Third paragraph, short but fine, closes the article with a last thought about everything."]
BODY = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)


@pytest.mark.parametrize("page", [
    f'<div id="header"><a href="/">Home</a></div><div id="content"><h1>Title</h1>{BODY}</div><div id="sidebar"><p>Popular posts, many of them, are listed here for you.</p></div>',
    f'<body><h1>Title</h1>{BODY}<div class="comments"><h2>Comments</h2><p>I like this, really, a lot, more than that.</p></div></body>',
    f'<body><div class="cookie-banner"><p>We use cookies to make this site better, faster, and so on.</p></div><div class="with-sidebar"><div class="post"><h1>Title</h1>{BODY}</div><form><p>Join our list, now, it is free.</p></form></div>',
    f'<table><tr><td><a href=a>Menu one</a><br><a href=b>Menu two</a></td><td><h1>Title</h1>{BODY}</td></tr></table>',
    f'<article><h1>Title</h1><div class="notice">Sign in to read more, please.</div>{BODY}<ul><li><a href=1>Related one</a><li><a href=2>Related two</a></ul><aside>Aside, text, here.</aside></article><article class="comment"><p>Nice, thanks, a lot.</p></article>',
    f'<div class="container"><h1>Title</h1>' + "".join(f'<div class="sec"><p>{x}</p></div>' for x in PARAGRAPHS) + "</div>",
])
def test_html_layouts(page):
    assert html.main_text(page) == "\n".join(["Title", *PARAGRAPHS])
