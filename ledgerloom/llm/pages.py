"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<(?=[!?/a-zA-Z])[^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!-)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Elements whose content is code and is not parsed.
RAW = {"script", "style", "textarea", "noscript", "iframe", "template", "title", "xmp", "noframes"}
#: Elements that are never part of an article.
ASIDE = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "input", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that may hold a whole article.
CONTAINER = {"article", "blockquote", "body", "div", "html", "main", "section", "table", "tbody", "td"}
#: An element that opens closes an open one of these, up to the nearest bound.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: Words of class, id and role names of what surrounds an article.
AROUND = re.compile(
    r"^(ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|alert|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|rail|widget\w*|footer|foot|masthead|topbar|toolbar|comments?|commentlist|respond|replies|reply|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|pagination|pager|tags|byline-links|complementary|contentinfo|navigation)$"
)
#: Words before one of these that say whether there is one, or sort what there is: the element itself is none. Words behind one that mean its box.
ABOUT = {"has", "no", "with", "without", "is", "tag", "category", "hide", "show", "not"}
BOX = {"list", "section", "box", "area", "wrap", "wrapper", "container", "block", "bar", "links", "posts", "items", "item", "content", "inner", "row", "panel", "group", "icons", "buttons", "form", "title", "text", "body", "meta", "module"}
#: Elements that hold an article rather than surround one.
HOLDERS = {"article", "main", "h1"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…]")
SPACES = re.compile(r"[ \t\n\r\f\v ]+")


def surrounds(tag: str, attributes: str, inside_article: bool) -> bool:
    """By its element, or hidden."""
    if tag in ASIDE or (tag == "header" and not inside_article):
        return True
    return bool(attributes) and tag not in ("html", "body", "main", "article") and bool(HIDDEN.search(attributes))


def named(tag: str, attributes: str) -> int:
    """What the element's names say: 2 if one is that of a surrounding, 1 if one ends in such a word ("site-footer", "comment-list"), else 0.

    A name of parts means what its last part says; parts that mean a box say nothing, and "has-sidebar" or "comments-open" is no sidebar and no comment.
    """
    if not attributes or tag in ("html", "body", "main"):
        return 0
    names = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)).lower().split()
    if tag == "article":
        return 2 * any(name in ("comment", "comments", "reply") for name in names)
    if any(AROUND.match(name) for name in names):
        return 2
    for name in names:
        parts = [w for w in re.split(r"[-_]+", name) if w]
        while len(parts) > 1 and parts[-1] in BOX:
            parts.pop()
        if parts and parts[0] not in ABOUT and parts[-1] != "side" and AROUND.match(parts[-1]):
            return 1
    return 0


class Node:
    """A run of text of one block: its tag path, its innermost block element, its text and how much of it is link text."""

    __slots__ = ("away", "element", "linked", "parts", "path")

    def __init__(self, path: int, element: int, away: tuple[int, ...]):
        self.path, self.element, self.away, self.parts, self.linked = path, element, away, [], 0


class Page:
    """Text nodes of a page in order, without what surrounds the article by its element; nodes know the elements around them that are named as surroundings.

    Block elements have numbers in the order they open (0: none) and tag paths have numbers too, both with their parents, so that work grows with
    the page however deep it nests: open elements are looked up by their tags, and elements close once.
    """

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.tags, self.parent = [""], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.depth, self.heading = [0], [False]
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, surrounding, innermost block element, its tag path
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[int] = []  # places of block elements
        self.node: Node | None = None
        #: Of each element named as a surrounding: how sure its name is, and whether it holds an article, a main part or the page's heading.
        self.names: list[list] = []
        self.inside: list[tuple[int, int]] = []  # those that are open: place in the stack, number
        self.read(page)

    def text(self, s: str) -> None:
        if not s or (self.stack and self.stack[-1][1]):
            return
        if self.node is None:
            element, path = self.stack[-1][2:] if self.stack else (0, 0)
            self.node = Node(path, element, tuple(k for _, k in self.inside))
            self.nodes.append(self.node)
        s = html.unescape(s)
        self.node.parts.append(s)
        if self.open.get("a"):
            self.node.linked += len(s.strip())

    def push(self, tag: str, away: bool) -> None:
        element, path = self.stack[-1][2:] if self.stack else (0, 0)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
            self.tags.append(tag)
            self.parent.append(element)
            element, under = len(self.tags) - 1, path
            path = self.paths.setdefault((under, tag), len(self.depth))
            if path == len(self.depth):
                self.depth.append(self.depth[under] + 1)
                self.heading.append(self.heading[under] or (under > 0 and tag in HEADINGS))
        self.stack.append((tag, away, element, path))

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if self.inside and self.inside[-1][0] == len(self.stack):
                self.inside.pop()
                self.node = None
            if tag in BLOCK:
                self.blocks.pop()

    def innermost(self, tags: set[str]) -> int:
        """The place of the innermost open element of these, or -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def end_others(self, tag: str) -> None:
        """What an element that opens closes: a block ends an open paragraph, an item the one before it."""
        ends, bounds = CLOSES.get(tag, (set(), set()))
        if tag not in BLOCK:
            if tag in CLOSES and self.stack and self.stack[-1][0] in ends:
                self.close(len(self.stack) - 1)
        elif not ends:
            if self.blocks and self.stack[self.blocks[-1]][0] == "p":
                self.close(self.blocks[-1])
        else:
            while (place := self.innermost(ends | {"p"})) > self.innermost(bounds):
                self.close(place)

    def read(self, page: str) -> None:
        at, raw = 0, None
        for m in TOKEN.finditer(page):
            if m.start() < at:
                continue
            if raw:
                if m[0][:2] == "</" and (m[2] or m[5] or "").lower() == raw:
                    raw = None
                else:
                    continue
            else:
                self.text(page[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attributes = m[3] or m[6] or ""
            if tag in BLOCK:
                self.node = None
            if m[1] or m[4]:
                if self.open.get(tag):
                    self.close(self.open[tag][-1])
                continue
            if tag in VOID:
                if tag in ("br", "hr") and self.node is not None:
                    self.node.parts.append(" ")
                continue
            self.end_others(tag)
            away = bool(self.stack and self.stack[-1][1]) or surrounds(tag, attributes, self.innermost({"article", "main"}) >= 0)
            if tag == "button" and self.node is not None and self.blocks and self.stack[self.blocks[-1]][0] == "p":
                away = self.stack[-1][1]  # a word of a sentence
            if tag in HOLDERS:
                for _, k in self.inside:
                    self.names[k][1] = True
            if not attributes.rstrip().endswith("/"):
                sure = 0 if away else named(tag, attributes)
                self.push(tag, away)
                if sure:
                    self.names.append([sure, tag == "article" and sure < 2])
                    self.inside.append((len(self.stack) - 1, len(self.names) - 1))
                    self.node = None
                if tag in RAW:
                    raw = tag
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.start() if end else len(page)
        if not raw:
            self.text(page[at:])


def kept_nodes(page: Page) -> list[tuple[Node, str]]:
    """Nodes with text that lie in no surrounding by name. A named element that holds an article, a main part or the page's heading is none, nor one whose name
    only ends in such a word and that has half of the text; if nothing were left, names count for nothing."""
    rows = [(n, t) for n in page.nodes if (t := SPACES.sub(" ", "".join(n.parts)).strip())]
    size = [0] * len(page.names)
    for n, t in rows:
        for k in n.away:
            size[k] += len(t)
    total = sum(len(t) for _, t in rows)
    gone = [not holds and (sure == 2 or 2 * size[k] < total) for k, (sure, holds) in enumerate(page.names)]
    return [(n, t) for n, t in rows if not any(gone[k] for k in n.away)] or rows


def select(page: Page, smooth: int = 1, share: float = 0.35) -> list[str]:
    """Blocks of the article.

    Every tag path has a text ratio (characters a node) and a punctuation ratio (marks a node). Along the page both are
    smoothed over `smooth` neighbours with Gaussian weights and multiplied; a path's score is the mean of its nodes'. Paths over
    `share` of the mean score by characters are content. All <article> elements with content that are in no other one are the article if they hold seven tenths
    of the content, together with content that lies between them or in their <main>; else it is the innermost element that holds all content. In it, headings
    and nodes of other paths stay if they are not mostly links.
    """
    rows = kept_nodes(page)
    if not rows:
        return []
    stats: dict[int, list[float]] = {}
    for n, t in rows:
        s = stats.setdefault(n.path, [0, 0, 0, 0])
        for i, v in enumerate((1, len(t), len(PUNCTUATION.findall(t)), min(n.linked, len(t)))):
            s[i] += v
    length = [stats[n.path][1] / stats[n.path][0] for n, _ in rows]
    marks = [(stats[n.path][2] + 0.5) / stats[n.path][0] for n, _ in rows]
    weight = [exp(-k * k / 2) for k in range(-smooth, smooth + 1)]

    def smoothed(x: list[float]) -> list[float]:
        pad = [x[0]] * smooth + x + [x[-1]] * smooth
        return [sum(w * pad[i + k] for k, w in enumerate(weight)) / sum(weight) for i in range(len(x))]

    fused = [a * b for a, b in zip(smoothed(length), smoothed(marks), strict=True)]
    score: dict[int, float] = {}
    for (n, _), f in zip(rows, fused, strict=True):
        score[n.path] = score.get(n.path, 0) + f / stats[n.path][0]
    chars = sum(len(t) for _, t in rows)
    mean = sum(score[n.path] * len(t) for n, t in rows) / chars
    linky = lambda p: stats[p][3] > 0.5 * stats[p][1]
    content = {p for p in score if score[p] >= share * mean and not linky(p)} or {max(score, key=lambda p: score[p])}
    held = [0] * len(page.tags)
    for n, t in rows:
        if n.path in content:
            held[n.element] += len(t)
    last = list(range(len(held)))  # an element's descendants have the numbers up to this one
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
        last[page.parent[e]] = max(last[page.parent[e]], last[e])
    holds = [e for e in range(1, len(held)) if held[e] and page.tags[e] in CONTAINER]
    articles: list[int] = []
    for e in holds:
        if page.tags[e] == "article" and not (articles and e <= last[articles[-1]]):
            articles.append(e)
    around = 0
    if sum(held[e] for e in articles) < 0.7 * held[0]:
        around, articles = 0, []
        article = max((e for e in holds if held[e] == held[0]), default=None)
        wide = article is None or any(n.element == article and page.depth[n.path] <= 2 for n, _ in rows)
    else:
        article, wide = None, False
        above = page.parent[articles[0]]
        while above and not (page.tags[above] == "main" or (len(articles) > 1 and last[above] >= articles[-1])):
            above = page.parent[above]
        around = above
    out = []
    for n, t in rows:
        if articles:
            inside = any(e <= n.element <= last[e] for e in articles)
            if inside or (around and around <= n.element <= last[around] and n.path in content):
                if n.path in content or n.linked <= 0.5 * len(t) or inside and page.tags[n.element] == "li":
                    out.append(t)
            continue
        if article is not None and not article <= n.element <= last[article]:
            continue
        if n.path in content or (n.linked <= 0.5 * len(t) and (not wide or page.heading[n.path] or not linky(n.path))):
            out.append(t)
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(select(Page(page or "")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """The main text of every page, from its whole html.

    Defined cases: null or empty html, or none but surroundings: empty text; unclosed, crossed or cut-off tags are
    repaired as read; character references without a semicolon are decoded where HTML knows them; repeated rows are read
    each; other columns are ignored. Returns page_id, url, text, n_chars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
