"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less with each level; an
article has the points of all its paragraphs, a main element three quarters of them. Points are
discounted by the share of a container's text that stands in links. The best container is kept
whole, with the siblings that score well, without navigation, boilerplate, forms, scripts and reader
comments. Class and id names that surely mark such parts drop them; names that only may mark them
drop what also holds little text or many links.

Edge cases: a null or empty page gives an empty text and 0 characters; a page cut off inside a tag
loses that tag only; unclosed elements end with their parent. Nothing is cut short: pages of any
length are read whole, in time that grows with their length, and depth is not bounded (no recursion).
Rows that repeat are read one by one; other columns stay as they are, whatever their names, but for
those named like the output or the page's.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tr",), "tfoot": ("tbody", "tr", "td", "th"), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}
#: What a paragraph that is still open does not reach across.
BARRIER = frozenset("table td th button caption html body div section article blockquote li".split())
#: Elements that never hold main text.
DROPPED = RAW | frozenset("nav aside footer form button select option input datalist svg canvas object dialog menu head audio video map progress meter search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tablist".split())
#: Words of class and id names that mark what is not the article, and those that may.
UNLIKELY = frozenset(
    "ad ads adv advert advertisement advertising adsense adbox sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars comment comments disqus respond replies masthead pagination pager copyright disclaimer toc footer skip".split()
)
DOUBTFUL = frozenset("alert banner reply share sharing social related recommended recommendations toolbar widget widgets hidden tags".split())
UNLIKELY_WHOLE = frozenset("header site-header page-header topbar top-bar site-footer page-footer side-bar side".split())
ALWAYS = frozenset("comment comments ad ads advert sponsored".split())
LIKELY = frozenset("article content post entry story main text body prose".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl div table section menu tbody tr td li p".split())
PARAGRAPH = frozenset("p pre li td th dd dt figcaption".split())
#: Characters from which a block earns points, and up to which a doubtful part holds little text.
LONG, LITTLE = 25, 100

# A quote opens a value only after an equals sign; a value that no quote closes ends with its tag.
_ATTRS = r"""((?:[\s/]+|=?[^\s=>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*|(?=>)|\Z))?|=)*+)"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*){_ATTRS}(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Node:
    """An element: its place in the tree, and what its subtree holds."""

    __slots__ = ("tag", "parent", "order", "end", "depth", "dropped", "doubtful", "framed", "weight", "points", "full", "text", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, order: int, depth: int):
        self.tag, self.parent, self.order, self.end, self.depth = tag, parent, order, order + 1, depth
        self.dropped = parent is not None and parent.dropped
        #: Whether it stands in an article or main element.
        self.framed = parent is not None and (parent.framed or parent.tag in ("article", "main"))
        self.doubtful = False
        self.weight = self.points = self.full = 0.0
        self.text = self.linked = self.links = 0

    def judge(self, attrs: str) -> None:
        """Drop, doubt or weigh the element by its name and attributes."""
        tag = self.tag
        if tag in DROPPED or tag == "header" and not self.framed:
            self.dropped = True
            return
        if tag in ("article", "main"):
            self.weight += 25
        for m in _ATTR.finditer(attrs) if attrs and not attrs.isspace() else ():
            key, raw = m[1].lower(), m[2] or m[3] or m[4] or ""
            value = raw.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDE.search(value) or key == "role" and value.strip() in DROPPED_ROLES:
                self.dropped = True
            elif key == "role" and value.strip() in ("main", "article"):
                self.weight += 25
            elif key in ("class", "id") and tag not in ("html", "body", "main"):
                names = {x.lower() for x in _NAME.findall(raw)}
                sure, may = names & UNLIKELY or set(value.split()) & UNLIKELY_WHOLE, names & DOUBTFUL
                if names & {"with", "has", "no", "without"}:
                    sure = may = None  # a layout is named after what stands beside the article
                if sure and tag != "article" or names & ALWAYS:
                    self.dropped = True
                elif may and tag != "article":
                    self.doubtful = True
                elif names & LIKELY:
                    self.weight += 25


class Tree:
    """A page's elements in order, and its blocks of text: (element, text, characters of it in links)."""

    def __init__(self, page: str):
        self.root = Node("#root", None, 0, 0)
        self.nodes, self.blocks = [self.root], []
        # the open elements: all, by name, those of blocks, and those that end a paragraph's reach
        self.path, self.by_tag = [self.root], defaultdict(list)
        self.open_blocks, self.barriers = [self.root], []
        self.buffer: list[str] = []
        self.linked = self.links = 0
        self._read(page)
        del self.path, self.by_tag, self.open_blocks, self.barriers, self.buffer

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                owner = self.open_blocks[-1]
                self.blocks.append((owner, text, min(self.linked, len(text))))
                owner.links += self.links
            self.buffer.clear()
        self.linked = self.links = 0

    def _say(self, text: str) -> None:
        if self.path[-1].dropped or not text:
            return
        if "&" in text:
            text = html.unescape(text)
        self.buffer.append(text)
        if self.by_tag["a"]:
            self.linked += len(" ".join(text.split()))

    def _open(self, tag: str, attrs: str) -> Node:
        node = Node(tag, self.path[-1], len(self.nodes), len(self.path))
        self.nodes.append(node)
        if not node.dropped:
            node.judge(attrs)
        if tag not in RAW:
            self.path.append(node)
            self.by_tag[tag].append(node)
            if tag in BLOCK:
                self.open_blocks.append(node)
            if tag in BARRIER:
                self.barriers.append(node)
        if tag == "a":
            self.links += 1
        return node

    def _close(self, node: Node) -> None:
        """End node and all that is open in it."""
        while True:
            last = self.path[-1]
            if last.tag in BLOCK:
                self._flush()
                self.open_blocks.pop()
            if last.tag in BARRIER:
                self.barriers.pop()
            self.path.pop()
            self.by_tag[last.tag].pop()
            last.end = len(self.nodes)
            if last is node:
                return

    def _innermost(self, tags: tuple[str, ...]) -> Node | None:
        return max((self.by_tag[t][-1] for t in tags if self.by_tag[t]), key=lambda n: n.depth, default=None)

    def _start(self, tag: str) -> None:
        """End what the beginning of a block ends."""
        self._flush()
        p = self._innermost(("p",))
        if p is not None and tag not in ("html", "body", "head", "option") and (not self.barriers or p.depth > self.barriers[-1].depth):
            self._close(p)
        if tag in CLOSES:
            node, stop = self._innermost(CLOSES[tag]), self._innermost(SCOPE.get(tag, ("table",)))
            if node is not None and (stop is None or node.depth > stop.depth):
                self._close(node)
                if tag in ("tbody", "tfoot") and self.path[-1].tag in ("tbody", "thead", "tr"):
                    self._close(self.path[-1])

    def _read(self, page: str) -> None:
        at = 0
        while (m := _TAG.search(page, at)) is not None:
            if m.start() > at:
                self._say(page[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, attrs = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                node = self._innermost((tag,))
                # the end of an inline element does not reach out of its block
                if node is not None and (tag in BLOCK or node.depth > self.open_blocks[-1].depth):
                    self._close(node)
                elif tag in BLOCK:
                    self._flush()
            elif tag == "br":
                self._say(" ")
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
            else:
                if tag in BLOCK:
                    self._start(tag)
                node = self._open(tag, attrs)
                if tag in RAW:
                    end = _ENDS[tag].search(page, at)
                    at = end.end() if end else len(page)
                elif attrs.endswith("/") and tag not in BLOCK:
                    self._close(node)
        if at < len(page):
            self._say(page[at:])
        if len(self.path) > 1:
            self._close(self.path[1])
        self._flush()
        self.root.end = len(self.nodes)


def points(text: str, linked: int) -> float:
    """What a paragraph passes on."""
    return (1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def score(n: Node) -> float:
    base = n.full if n.tag == "article" else 0.75 * n.full if n.tag == "main" else n.points
    return (base + (n.weight if base else 0)) * (1 - n.linked / n.text if n.text else 1)


def _covered(spans: list[tuple[int, int]], size: int) -> list[bool]:
    """Which of the elements stand in one of the ranges."""
    step, out, open_ = [0] * (size + 1), [], 0
    for lo, hi in spans:
        step[lo] += 1
        step[hi] -= 1
    for x in step[:size]:
        open_ += x
        out.append(open_ > 0)
    return out


def _weigh(tree: Tree, blocks: list[tuple[Node, str, int]]) -> None:
    """Give each element its points and the sums of its subtree."""
    for n in tree.nodes:
        n.points = n.full = 0.0
        n.text = n.linked = 0
    for owner, text, linked in blocks:
        owner.text += len(text)
        owner.linked += linked
        if len(text) < LONG or owner.tag in HEADINGS:
            continue
        worth = points(text, linked)
        owner.full += worth
        up, level = (owner.parent if owner.tag in PARAGRAPH and owner.parent is not None else owner), 1
        while up is not None and level <= 6:
            up.points += worth / level if level < 3 else worth / (3 * level)
            up, level = up.parent, level + 1
    for n in reversed(tree.nodes):
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.linked += n.linked
            n.parent.full += n.full


def _chosen(tree: Tree) -> list[str]:
    nodes, blocks = tree.nodes, tree.blocks
    if not blocks:
        return []
    _weigh(tree, blocks)
    doubted = [(n.order, n.end) for n in nodes if n.doubtful and (n.linked > n.text / 2 if n.tag == "p" else n.text < LITTLE or n.linked > n.text / 3)]
    if doubted:
        gone = _covered(doubted, len(nodes))
        blocks = [b for b in blocks if not gone[b[0].order]]
        _weigh(tree, blocks)
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.links += n.links
    best = max((n for n in nodes if n.full and not n.dropped and score(n)), key=lambda n: (score(n), -n.order), default=None)
    if best is None:
        best = next((n for tag in ("article", "main", "body") for n in nodes if n.tag == tag and n.text), tree.root)
    keep = [best]
    if best.parent is not None and best.tag not in ("main", "body", "html"):
        least, framed = max(10.0, 0.2 * score(best)), best.tag == "article"
        for n in nodes[best.parent.order : best.parent.end]:
            if n.parent is best.parent and n is not best and not n.dropped and n.text:
                density = n.linked / n.text
                # an article is whole; beside it stand at most its title and lines of its own
                if not framed and score(n) >= least or n.tag == "p" and (n.text > 80 and density < 0.25 or not framed and density == 0) or n.tag == "h1":
                    keep.append(n)
    # inside, lists of links are menus
    menus = [(n.order, n.end) for k in keep for n in nodes[k.order + 1 : k.end] if n.tag in LISTS and n.links > 1 and n.text and n.linked > 0.6 * n.text]
    show, hide = _covered([(k.order, k.end) for k in keep], len(nodes)), _covered(menus, len(nodes))
    return [text for owner, text, _ in blocks if show[owner.order] and not hide[owner.order]]


def main_text(page: str | None) -> str:
    """The article's blocks in page order, one a line."""
    return "\n".join(_chosen(Tree(page))) if page else ""


def extract_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """The given columns and the main text of each page (empty if there is none); no row is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1)
            texts = pa.array([main_text(x.as_py()) for x in pages], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], schema.names)

    kept, raw = [c for c in df.columns if c not in (out, html_col)], "raw"
    while raw.lower() in {c.lower() for c in df.columns}:
        raw += "_"
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html_col}`").cast("string").alias(raw))
    schema = source.drop(raw).schema.add(out, "string")
    return source.mapInArrow(run, schema)


def with_length(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("n_chars", F.length(text).cast("long"))
