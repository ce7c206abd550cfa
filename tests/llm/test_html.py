"""Tree scoring held to a scorer that walks a parsed tree by recursion, and pages that once lost text or time."""

import html as entities
import random
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from promptlens.llm import html
from promptlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Element:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []  # children: elements and strings


class Reader(HTMLParser):
    """A tree of well-formed pages."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        e = Element(tag, dict(attrs), self.at)
        self.at.children.append(e)
        self.at = e

    def handle_endtag(self, tag):
        self.at = self.at.parent

    def handle_data(self, data):
        self.at.children.append(data)


def brute(page):
    """The method said again: recursion over the tree, sums taken anew for each element."""
    root = Reader(page).root

    def named(e):
        return set(re.findall(r"[a-z]+", e.attrs.get("class", ""))) if e.tag not in ("html", "body", "main") else set()

    def dropped(e):
        words = named(e)
        return e.tag in html.DROPPED or e.tag == "header" and not above(e, ("article", "main")) or bool(words & html.UNLIKELY and e.tag != "article" or words & html.ALWAYS) or e.parent is not None and dropped(e.parent)

    def doubtful(e):
        words = named(e)
        return bool(words & html.DOUBTFUL) and not words & html.UNLIKELY and e.tag != "article"

    def above(e, tags):
        e = e.parent
        while e is not None and e.tag not in tags:
            e = e.parent
        return e

    blocks, links = [], {}

    def walk(e, buffer, linked):
        """Blocks of text in order: (element, text, characters in links)."""
        for c in e.children:
            if isinstance(c, str):
                buffer.append((c, linked))
            elif dropped(c):
                if c.tag in html.BLOCK:
                    flush(e, buffer)
            else:
                if c.tag == "a":
                    links[id(owner(e))] = links.get(id(owner(e)), 0) + 1
                if c.tag in html.BLOCK:
                    flush(e, buffer)
                    walk(c, buffer, linked)
                    flush(c, buffer)
                else:
                    walk(c, buffer, linked or c.tag == "a")

    def owner(e):
        while e.tag not in html.BLOCK and e.parent is not None:
            e = e.parent
        return e

    def flush(e, buffer):
        text = " ".join("".join(t for t, _ in buffer).split())
        if text:
            blocks.append((owner(e), text, min(len(text), sum(len(" ".join(t.split())) for t, a in buffer if a))))
        buffer.clear()

    walk(root, [], False)

    def inside(x, e):
        while x is not None and x is not e:
            x = x.parent
        return x is e

    def sums(e):
        own = [b for b in blocks if inside(b[0], e)]
        return sum(len(b[1]) for b in own), sum(b[2] for b in own)

    def every(e):
        yield e
        for c in e.children:
            if not isinstance(c, str):
                yield from every(c)

    nodes = [e for e in every(root) if not dropped(e) or e is root]

    def doubted(e):
        text, linked = sums(e)
        return doubtful(e) and (linked > text / 2 if e.tag == "p" else text < html.LITTLE or linked > text / 3)

    gone = [e for e in nodes if doubted(e)]
    blocks = [b for b in blocks if not any(inside(b[0], g) for g in gone)]

    def worth(b):
        return 0.0 if len(b[1]) < html.LONG or b[0].tag in html.HEADINGS else (1 + b[1].count(",") + min(len(b[1]) / 100, 3)) * (1 - b[2] / len(b[1]))

    def base(e):
        if e.tag in ("article", "main"):
            return (1 if e.tag == "article" else 0.75) * sum(worth(b) for b in blocks if inside(b[0], e))
        out = 0.0
        for b in blocks:
            up, level = b[0].parent if b[0].tag in html.PARAGRAPH else b[0], 1
            while up is not None and level <= 6:
                if up is e:
                    out += worth(b) / level if level < 3 else worth(b) / (3 * level)
                up, level = up.parent, level + 1
        return out

    def score(e):
        text, linked = sums(e)
        likely = named(e) & html.LIKELY and not doubtful(e)
        weight = 25 * (e.tag in ("article", "main")) + 25 * bool(likely)
        return (base(e) + (weight if base(e) else 0)) * (1 - linked / text if text else 1)

    if not blocks:
        return ""
    some = [(score(e), -i, e) for i, e in enumerate(nodes) if any(worth(b) and inside(b[0], e) for b in blocks) and score(e)]
    best = max(some, key=lambda x: x[:2])[2] if some else next((e for t in ("article", "main", "body") for e in nodes if e.tag == t and sums(e)[0]), root)
    keep = [best]
    if best.parent is not None and best.tag not in ("main", "body", "html"):
        for e in best.parent.children:
            if not isinstance(e, str) and e is not best and not dropped(e) and sums(e)[0]:
                text, linked = sums(e)
                if best.tag != "article" and score(e) >= max(10.0, 0.2 * score(best)) or e.tag == "p" and (text > 80 and linked / text < 0.25 or best.tag != "article" and linked == 0) or e.tag == "h1":
                    keep.append(e)

    def menu(e):
        text, linked = sums(e)
        return e.tag in html.LISTS and text and linked > 0.6 * text and sum(n for x in every(e) for n in [links.get(id(x), 0)]) > 1

    menus = [e for k in keep for e in every(k) if e is not k and menu(e)]
    return "\n".join(t for o, t, _ in blocks if any(inside(o, k) for k in keep) and not any(inside(o, m) for m in menus))


def page(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta,", "gamma", "delta.", "a &amp; b", "été,", "x  y"])
    line = lambda n: " ".join(word() for _ in range(n))

    def link():
        return f'<a href="/{rng.randint(1, 9)}">{line(rng.randint(1, 3))}</a>'

    def part(depth):
        kind = rng.random()
        if depth <= 0 or kind < 0.45:
            return f"<p>{line(rng.randint(2, 50))}{' ' + link() if rng.random() < 0.3 else ''} {line(rng.randint(0, 5))}</p>"
        if kind < 0.55:
            return "<ul>" + "".join(f"<li>{link() if rng.random() < 0.7 else line(8)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.6:
            return f"<h1>{line(4)}</h1>"
        if kind < 0.65:
            return f"<nav>{link()}{link()}</nav>"
        tag = rng.choice(["div", "div", "section", "article", "main", "header", "blockquote"])
        name = rng.choice(["", "", ' class="content"', ' class="cookie-notice"', ' class="related"', ' class="share-price"', ' class="comments"', ' class="alert box"'])
        return f"<{tag}{name}>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    return "<html><body>" + "".join(part(4) for _ in range(rng.randint(1, 5))) + "</body></html>"


@pytest.mark.parametrize("seed", range(60))
def test_same_as_brute_force(seed):
    made = page(seed)
    assert html.main_text(made) == brute(made), made


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")
def test_query_against_the_pages_own_layout(spark):
    """The pages of the tables hold one article each: its blocks, read by patterns."""
    want = {}
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want[r["page_id"]] = "\n".join(x for x in lines if x)
    got = QUERIES["op10_html_extraction"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_quotes_open_values_only_after_an_equals_sign():
    text = "First paragraph, which readers see. They don't mind it."
    for attrs in ("class=x data-t='it's fine'", "title='a' b", "it's", 'data-x="1>2"', "x=a'b", "x = 'a>b'", "='", "data-hidden x='class=ad'"):
        assert html.main_text(f"<p {attrs}>{text}</p>") == text, attrs
    assert html.main_text(f'<div>{text}</div><a href="x>never closed, with a comma</a>') != ""


def test_doubtful_names_drop_what_holds_little():
    long = "The share price rose, and fell, and rose again on Monday, said a person who knows, at some length about all of it."
    body = f'<article><h1>T</h1><p class="alert">An alert, that the article holds.</p><div class="share-price"><p>{long}</p></div><div class="social">Follow us</div><p>{long}</p></article>'
    assert html.main_text(body) == f"T\nAn alert, that the article holds.\n{long}\n{long}"


@pytest.mark.parametrize("made", ["<span>" * 100_000 + "<div></div>" * 100_000 + "some text, here", "<div>" * 100_000 + "text here, long enough, to score it" + "</b>" * 100_000, "<b>" * 100_000 + "<p>x</p>" + "</i></b>" * 100_000, "<span>word<div></div>" * 50_000, "<ul><li><a href=x>aa</a>" * 30_000, "<article><p>word, and words" * 30_000, '<a href="x>' * 50_000])
def test_time_grows_with_length(made):
    began = time.process_time()
    html.main_text(made)
    assert time.process_time() - began < 6


def test_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "<p>a, b", "x", 5), (1, "<p>a, b", "x", 5), (None, None, None, None)], "page_id long, html string, `__html` string, raw int")
    out = html.extract_text(df)
    assert out.columns == ["page_id", "__html", "raw", "text"]
    assert sorted(map(str, out.collect())) == sorted(map(str, [*out.where("page_id = 1").collect(), *out.where("page_id is null").collect()]))
    assert [r.text for r in out.orderBy(out.page_id.desc()).collect()] == ["a, b", "a, b", ""]
