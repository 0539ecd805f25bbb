"""Main text of web pages by a style tree of each site.

The element trees of all pages of a host are merged: elements with the same chain of names from the page's root are one
node. A node knows in how many pages it is, how its pages arrange its children (presentation) and which texts, links and
images stand directly in it (content). Entropies over the pages weigh both: what looks and reads alike on every page
is furniture of the site, what differs is content. Branches of low importance are then removed from each page.

Names come first. Elements whose name, class or role says what they are (a menu, an advert, an article) need no
statistics, and a site may hold one page only; entropy decides on the rest.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh
from ledgerloom.session import stored

# Names of HTML and words that authors use for parts of pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe noembed noframes".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
FURNITURE_TAGS = set(
    "head nav footer aside form script style noscript template textarea title iframe button select option input dialog menu "
    "svg canvas object embed applet audio video map fieldset datalist noembed noframes".split()
)
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion "
    "banner banners sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie "
    "cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay comment comments disqus "
    "respond replies reply share sharing social related recommended recommendations widget widgets toolbar pagination pager "
    "paginator login signup search copyright legal disclaimer skip".split()
)
HARMLESS_WORDS = set("has with without no open closed article main page site body".split())
ARTICLE_WORDS = set(
    "content main article post entry story maincontent articlebody articlecontent postcontent postbody entrycontent".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"},
}
# What is not left when a start tag closes an open element of the same kind.
FENCES = set("ul ol dl table tbody thead tfoot tr div section article main blockquote".split())
# Start tags that close an open paragraph.
BLOCKS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
HEAD = set("meta link title style script base noscript template".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*>", re.S
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?<![\w-])(hidden)(?![\w-])")
WORD = re.compile(r"[a-z]+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}

LEAST_PAGES = 4  # pages of a node before its entropies say anything
LOW = 0.2  # importance below which a branch goes
HIGH = 0.5  # importance that a node of the site must have, else its pages are copies and entropies say nothing
COPIES = 8  # times what is left that branches may hold of a page's text; of more, they are an article with many copies
DAMP = 0.9  # weight of what lies below, to the power of the number of arrangements


@dataclass(slots=True)
class Node:
    """An element of a page; ``key`` is the hash of its chain of names, ``parts`` holds texts and child nodes in order."""

    tag: str
    key: int
    depth: int
    parent: Node | None
    furniture: bool = False
    article: int = 0  # 3 article, 2 main, 1 named like one
    header: bool = False  # of an article: only its headings are text
    inside: bool = False  # an article or below one
    parts: list = field(default_factory=list)
    marks: list[str] = field(default_factory=list)  # links and images


@functools.lru_cache(4096)
def _named(whole: str) -> tuple[str, dict[str, str], bool, int, bool, str]:
    """Of a start tag: its name and attributes, whether it is furniture, how much it is an article, whether it is a
    header, and its style: name, class, id and role without long numbers."""
    start = NAME.match(whole)
    tag, attributes = start[1].lower(), {}
    for m in ATTRIBUTE.finditer(whole, start.end()):
        if m[3]:
            attributes["hidden"] = ""
        else:
            attributes.setdefault(m[1].lower(), html.unescape(m[2].strip("\"'")))
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()
    role = attributes.get("role", "").strip().lower()
    article = max({"article": 3, "main": 2}.get(tag, 0), {"article": 3, "main": 2}.get(role, 0))
    furniture = tag in FURNITURE_TAGS or role in FURNITURE_ROLES or "hidden" in attributes
    furniture |= attributes.get("aria-hidden") == "true" and tag not in INLINE
    furniture |= "display:none" in attributes.get("style", "").replace(" ", "").lower()
    header = tag == "header"
    if attributes.get("itemprop") == "articleBody":
        article = max(article, 1)
    if tag != "main":
        for name in names:
            words = set(WORD.findall(name))
            if words & FURNITURE_WORDS and not words & HARMLESS_WORDS:
                furniture = True
            elif "".join(WORD.findall(name)) in ARTICLE_WORDS:
                article = max(article, 1)
            header |= "header" in words and tag not in HEADINGS and not article
    style = " ".join([tag, *sorted({re.sub(r"\d{3,}", "", n) for n in names}), role]).strip()
    return tag, attributes, furniture, article, header, style


@functools.lru_cache(256)
def _nest(tag: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def _after(text: str, place: int, tag: str) -> int:
    """Where the element ends whose start tag ends at ``place``; -1 if its end tag is missing."""
    depth = 1
    for m in _nest(tag).finditer(text, place):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m.end()
    return -1


def parse(text: str) -> Node:
    """The element tree of a page, as browsers read it in the cases that matter for text: unclosed paragraphs, list
    items and table cells end where the next begins, end tags that nothing opened are ignored, scripts end at their
    own end tag only. Inline elements are part of their block's text; furniture with an end tag is passed over."""
    root = at = Node("html", 0, 0, None)
    opened: Counter = Counter()
    unclosed: set[str] = set()
    place = 0

    def leave(node: Node) -> None:
        """Closes ``node`` and all that is open in it."""
        nonlocal at
        while at is not node:
            opened[at.tag] -= 1
            at = at.parent
        opened[at.tag] -= 1
        at = at.parent

    while True:
        m = TOKEN.search(text, place)
        piece = text[place:] if m is None else text[place : m.start()]
        if piece:
            at.parts.append(html.unescape(piece) if "&" in piece else piece)
        if m is None:
            return root
        place, whole = m.end(), m[0]
        if whole[1] in "!?":
            continue
        if whole[1] == "/":
            tag = NAME.match(whole)[1].lower()
            if opened[tag] > 0:
                node = at
                while node.tag != tag:
                    node = node.parent
                leave(node)
            elif tag not in INLINE:
                at.parts.append(" ")
            continue
        tag, attributes, furniture, article, header, style = _named(whole)
        if opened["head"] > 0 and tag not in HEAD:
            node = at
            while node.tag != "head":
                node = node.parent
            leave(node)
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            end = ENDS[tag].search(text, place)
            place = len(text) if end is None else end.end()
            if tag not in INLINE:
                at.parts.append(" ")
            continue
        if tag in INLINE and not furniture:
            if tag == "br":
                at.parts.append(" ")
            elif tag == "img" and attributes.get("src"):
                at.marks.append("img " + attributes["src"])
            elif tag == "a" and attributes.get("href"):
                at.marks.append("a " + attributes["href"])
            continue
        if tag in BLOCKS and opened["p"] > 0:
            node = at
            while node.parent is not None and node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                leave(node)
        same = CLOSES.get(tag)
        if same and any([opened[x] > 0 for x in same]):
            node = at
            while node.parent is not None and node.tag not in FENCES and node.tag not in same:
                node = node.parent
            if node.tag in same:
                leave(node)
        inside = at.inside or article > 0
        furniture |= header and not inside
        if furniture and tag not in CLOSES and tag not in INLINE and tag not in VOID and tag not in unclosed:
            end = place if whole.endswith("/>") else _after(text, place, tag)
            if end >= 0:
                at.parts.append(" ")
                place = end
                continue
            unclosed.add(tag)
        node = Node(tag, xxhash.xxh64_intdigest(style, seed=at.key), at.depth + 1, at, furniture, article, header, inside)
        at.parts.append(node)
        if tag not in VOID and not whole.endswith("/>"):
            at = node
            opened[tag] += 1


def roots(tree: Node) -> list[Node]:
    """Where the main text lies: the outermost articles, else main elements, else those named so, else the page."""
    best, found = 0, []
    stack = [tree]
    while stack:
        node = stack.pop()
        if node.furniture:
            continue
        if node.article > best:
            best, found = node.article, []
        if node.article and node.article == best:
            up = node.parent
            while up is not None and up.article != best:
                up = up.parent
            if up is None:
                found.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return found or [tree]


def _pruned(root: Node) -> Iterator[tuple[Node, list]]:
    """Nodes of a root in page order with the parts that names leave: no furniture, of headers only their headings."""
    stack = [(root, False)]
    while stack:
        node, header = stack.pop()
        header = (header or node.header) and node.tag not in HEADINGS
        parts = []
        for x in node.parts:
            if isinstance(x, Node):
                if not x.furniture:
                    parts.append(x)
            elif not header:
                parts.append(x)
        yield node, parts
        stack += [(x, header) for x in reversed(parts) if isinstance(x, Node)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def gather(root: Node, rows: dict) -> None:
    """Adds one page's root to ``rows``: (node, parent, depth, kind, item) -> [n, s].

    Kind 0 is the node itself, n pages and s its share of its parent's children; kind 1 an arrangement of children, n
    pages; kind 2 a text, link or image, n occurrences and s the sum of c ln c over pages with c occurrences.
    """
    kids: dict[int, dict[int, None]] = defaultdict(dict)
    items: dict[int, Counter] = defaultdict(Counter)
    seen: dict[int, tuple[int, int]] = {}
    base = root.depth
    for node, parts in _pruned(root):
        own = root.key if node is root else node.key
        seen.setdefault(own, (0 if node is root else node.parent.key, node.depth - base))
        if node is not root:
            kids[node.parent.key][own] = None
        said = " ".join(" ".join(x for x in parts if isinstance(x, str)).split())
        if said:
            items[own][xxhash.xxh64_intdigest(said)] += 1
        for mark in node.marks:
            items[own][xxhash.xxh64_intdigest(mark)] += 1
    for own, (parent, depth) in seen.items():
        among = len(kids[parent]) if parent in kids and own in kids[parent] else 1
        where = (_signed(own), _signed(parent), depth)
        found = rows[(*where, 0, 0)]
        found[0] += 1
        found[1] += 1 / among
        found = rows[(*where, 1, _signed(xxhash.xxh64_intdigest(",".join(map(str, kids[own])))) if own in kids else 0)]
        found[0] += 1
        for item, c in items[own].items():
            found = rows[(*where, 2, _signed(item))]
            found[0] += c
            found[1] += c * math.log(c)


def importance(nodes: pd.DataFrame) -> dict[int, float]:
    """Importance of each node of one site: columns node, parent, depth, pages, share, styles, style_sum, items, item_sum.

    Presentation: the entropy of the arrangements, in units of ln pages. Content: one less the mean entropy of the
    texts, links and images. A node of both weighs its content like one more child. Children that are too rare to be
    here count as important.
    """
    below: dict[int, list[tuple[float, float]]] = defaultdict(list)
    out: dict[int, float] = {}
    for r in nodes.sort_values("depth", ascending=False, kind="stable").itertuples(index=False):
        unit = math.log(r.pages) if r.pages > 1 else 1.0
        looks = max(0.0, min(1.0, (math.log(r.pages) - r.style_sum / r.pages) / unit))
        own = 1 - max(0.0, min(1.0, r.item_sum / r.items / unit)) if r.items else None
        kids = below.pop(r.node, [])
        covered = sum(s for s, _ in kids) / r.pages
        if r.styles == 1 and not kids and covered == 0 and own is not None:
            value = own
        elif not kids and own is None:
            value = 1.0
        else:
            inner = sum(s * v for s, v in kids) / r.pages + max(0.0, 1 - covered) if kids else 1.0
            if own is not None:
                inner = (inner + own) / 2
            weight = DAMP ** max(1, r.styles)
            value = (1 - weight) * looks + weight * inner
        out[r.node] = value
        if r.depth:
            below[r.parent].append((r.share, value))
    return out


def low_branches(nodes: pd.DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Nodes of one site that go: unimportant with all below them, if the site has anything important to compare with."""
    value = importance(nodes)
    if max(value.values(), default=0.0) < high:
        return []
    rows = list(nodes.sort_values("depth", ascending=False, kind="stable").itertuples(index=False))
    keeps: set[int] = set()  # nodes that are important or have something important below
    for r in rows:
        if value[r.node] >= low or r.node in keeps:
            keeps |= {r.node, r.parent} if r.depth else {r.node}
    return [int(r.node) for r in rows if r.depth and r.node not in keeps]


def main_text(tree: Node, gone: set[int]) -> str:
    """The text of a page without the branches in ``gone``; if those hold nearly all of it, nothing goes (``COPIES``)."""
    kept: list[str] = []
    every: list[str] = []
    for root in roots(tree):
        stack: list = [(root, False, False)]
        while stack:
            node, header, out = stack.pop()
            if node.__class__ is str:
                every.append(node)
                if not out:
                    kept.append(node)
                continue
            header = (header or node.header) and node.tag not in HEADINGS
            out = out or node is not root and bool(gone) and _signed(node.key) in gone
            edge = (" ", False, out)
            stack.append(edge)
            for x in reversed(node.parts):
                if x.__class__ is str:
                    if not header:
                        stack.append((x, False, out))
                elif not x.furniture:
                    stack.append((x, header, out))
            stack.append(edge)
    text = " ".join("".join(kept).split())
    if gone:
        full = " ".join("".join(every).split())
        if COPIES * len(text) < len(full) - len(text):
            return full
    return text


def _host(url):
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def site_branches(pages: DataFrame, site: str, markup: str) -> DataFrame:
    """(site, gone array<long>): the unimportant branches of every site that has any.

    Each task sums what its pages show before anything is shuffled; only hashes and counts move. A site's nodes meet
    in one group when they lie in ``LEAST_PAGES`` pages or more, so their number is that of repeated chains of names.
    """

    def collect(frames):
        for frame in frames:
            found: dict = defaultdict(lambda: [0, 0.0])
            for name, text in zip(frame["site"], frame["markup"], strict=True):
                rows: dict = defaultdict(lambda: [0, 0.0])
                for root in roots(parse(text or "")):
                    gather(root, rows)
                for key, (n, s) in rows.items():
                    total = found[(name, *key)]
                    total[0] += n
                    total[1] += s
            yield pd.DataFrame(
                [(*k, n, s) for k, (n, s) in found.items()],
                columns=["site", "node", "parent", "depth", "kind", "item", "n", "s"],
            )

    slim = pages.select(F.col(site).alias("site"), F.col(markup).cast("string").alias("markup"))
    shape = "site long, node long, parent long, depth int, kind int, item long, n long, s double"
    marks = slim.mapInPandas(collect, shape).groupBy("site", "node", "parent", "depth", "kind", "item")
    marks = marks.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    def of(kind: int, value):
        return F.when(F.col("kind") == kind, value)

    nodes = marks.groupBy("site", "node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.max(of(0, F.col("n"))).alias("pages"),
        F.sum(of(0, F.col("s"))).alias("share"), F.count(of(1, F.lit(1))).alias("styles"),
        F.sum(of(1, F.col("n") * F.log("n"))).alias("style_sum"), F.count(of(2, F.lit(1))).alias("items"),
        F.coalesce(F.sum(of(2, F.log("n") - F.col("s") / F.col("n"))), F.lit(0.0)).alias("item_sum"),
    )
    nodes = nodes.where(F.col("pages") >= LEAST_PAGES)

    def decide(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        gone = low_branches(frame)
        return pd.DataFrame([(key[0], gone)] if gone else [], columns=["site", "gone"])

    return nodes.groupBy("site").applyInPandas(decide, "site long, gone array<long>")


def extract_main(pages: DataFrame, markup: str = "html", url: str = "url") -> DataFrame:
    """Every row of ``pages`` with ``text`` (the main text) and ``n_chars`` (its code points) in place of ``markup``.

    The main text lies in the page's articles (``roots``), without elements that their names mark as furniture and
    without branches of low importance in the site's style tree. White space, also that of blocks and line breaks, is one
    space; character references are decoded. A null or empty page has an empty text. Pages without a host are one
    site; a site of fewer than four pages loses only what names mark. Repeated rows are pages each; an empty table gives
    an empty result; columns named text or n_chars are replaced, others pass.

    Pages are read twice and never shuffled for the statistics. Decisions, one row per site that has any, are written
    and joined, so Spark may send them to all tasks if they are small and can split the pages of a large site if not.
    """
    name, gone = fresh(pages, "site", "gone")
    marked = pages.withColumn(name, F.xxhash64(_host(F.col(url))))
    low = stored(site_branches(marked, name, markup).toDF(name, gone), "low-branches")
    rows = marked.join(low, name, "left")

    @F.pandas_udf("string")
    def text_of(markups: pd.Series, branches: pd.Series) -> pd.Series:
        out = []
        for text, nodes in zip(markups, branches, strict=True):
            out.append(main_text(parse(text), set() if nodes is None else set(nodes.tolist())) if text else "")
        return pd.Series(out, dtype=object)

    rows = rows.withColumn("text", text_of(F.col(markup).cast("string"), F.col(gone)))
    return rows.withColumn("n_chars", F.length("text").cast("long")).drop(name, gone, *([markup] if markup != "text" else []))
