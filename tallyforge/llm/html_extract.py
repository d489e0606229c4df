"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density,
those of the blocks before and after it, and what its enclosing elements say (inside the page's
article, inside an element or class that marks boilerplate wholly or in part, a heading). A decision tree trained in
numpy on the small labelled table below decides which blocks are kept.
"""

from __future__ import annotations

import html as html_std
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Elements whose contents are never page text and in which tags are not parsed.
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
#: Elements that mark what is not part of the article.
AROUND = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "head", "select", "button", "svg", "object", "audio", "video", "canvas", "fieldset", "datalist"}
#: Elements that hold the article.
BODY = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are tracked while open; paragraphs and the like need not be.
HOLDERS = AROUND | BODY | {"div", "section", "ul", "ol", "dl", "table", "figure", "details", "center", "blockquote"}
#: Elements that end a block of text.
BREAKS = HOLDERS | HEADINGS | {"p", "li", "tr", "td", "th", "dt", "dd", "pre", "hr", "body", "html", "address", "figcaption", "caption", "thead", "tbody", "tfoot", "summary", "legend", "option", "optgroup"}
#: Words in class, id and role that mark boilerplate.
MARK = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|byline|captcha|comments?|commentlist|cookies?|consent|copyright|dialog|disqus|footer|foot|gdpr|header|masthead|menu|modal|"
    r"nav\w*|newsletter|notice|overlay|pagination|pager|paywall|popup|privacy|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|"
    r"subscribe\w*|tags|teaser|toolbar|tracking|trending|widget|contentinfo|complementary|navigation|alert"
)
#: Last parts of a name that say nothing of what it holds: a comment-list holds comments.
SHELLS = {"area", "bar", "block", "body", "box", "container", "content", "form", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "posts", "region", "right", "section", "slot", "top", "unit", "wrap", "wrapper"}
#: Header words, which inside an article stand for its own header.
OWN_HEADER = {"header", "masthead"}
TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z))""", re.DOTALL)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)

def marked(named: str, inside: bool) -> float:
    """How far a class, id or role marks boilerplate: 1 if its head word does, 0.5 if another part does.

    The head of a name is its last part that isn't a shell or a number: ``search`` alone or in
    ``search-box``, but ``results`` in ``search-results``.
    """
    found = 0.0
    for name in named.lower().split():
        parts = [p for p in re.split(r"[_\W\d]+", name) if p]
        while len(parts) > 1 and parts[-1] in SHELLS:
            parts.pop()
        hits = [bool(MARK.fullmatch(p)) and not (inside and p in OWN_HEADER) for p in parts]
        if hits and hits[-1]:
            return 1.0
        if any(hits):
            found = 0.5
    return found


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "around", "heading")
#: Labelled blocks: the features in the order above, and whether the block is article text.
#: in_article: 1 inside the page's article, -1 outside of it, 0 when the page marks none.
LABELLED = np.array(
    [
        # menus, headers and notices above an article that is marked as such
        (1, 1.0, 0, 0.0, 1, 1.0, -1, 1, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, -1, 1, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, -1, 1, 0, 0), (25, 0.0, 1, 1.0, 9, 0.0, -1, 1, 0, 0),
        (40, 0.1, 2, 1.0, 60, 0.0, -1, 0, 0, 0), (12, 0.0, 8, 0.0, 90, 0.0, -1, 0, 1, 0), (3, 0.0, 80, 0.0, 0, 0.0, -1, 1, 0, 0), (11, 0.0, 120, 0.0, 0, 0.0, -1, 1, 0, 0),
        (70, 0.0, 60, 0.0, 20, 0.5, -1, 1, 0, 0), (150, 0.0, 1, 1.0, 12, 0.0, -1, 1, 0, 0), (30, 0.0, 40, 0.0, 0, 0.0, -1, 0, 0, 0), (200, 0.02, 9, 0.0, 30, 0.0, -1, 0, 0, 0),
        # text of such an article, of any length
        (9, 0.0, 8, 0.0, 9, 0.0, 1, 0, 1, 1), (9, 0.0, 9, 0.0, 120, 0.0, 1, 0, 0, 1), (120, 0.0, 9, 0.0, 60, 0.0, 1, 0, 0, 1), (1, 0.0, 200, 0.0, 45, 0.0, 1, 0, 0, 1),
        (2, 0.0, 90, 0.0, 8, 0.0, 1, 0, 0, 1), (1, 0.0, 1, 0.0, 11, 0.0, 1, 0, 0, 1), (300, 0.05, 1, 0.0, 9, 0.0, 1, 0, 0, 1), (4, 1.0, 80, 0.0, 90, 0.0, 1, 0, 0, 1),
        (15, 0.6, 40, 0.0, 3, 1.0, 1, 0, 0, 1), (5, 0.0, 100, 0.1, 100, 0.0, 1, 0, 1, 1), (800, 0.0, 20, 0.0, 11, 0.0, 1, 0, 0, 1), (1, 0.0, 8, 0.0, 0, 0.0, 1, 0, 0, 1),
        # what stands inside it without being part of it
        (12, 0.0, 90, 0.0, 80, 0.0, 1, 1, 0, 0), (60, 0.0, 100, 0.0, 30, 0.0, 1, 1, 0, 0), (2, 1.0, 60, 0.0, 2, 1.0, 1, 1, 0, 0), (140, 0.0, 90, 0.0, 40, 0.0, 1, 1, 0, 0), (3, 0.0, 90, 0.0, 60, 0.0, 1, 1, 1, 0),
        # pages that mark no article: long blocks with few links and their short neighbours
        (80, 0.0, 40, 0.0, 90, 0.0, 0, 0, 0, 1), (35, 0.05, 8, 0.0, 70, 0.0, 0, 0, 0, 1), (120, 0.1, 3, 1.0, 2, 1.0, 0, 0, 0, 1), (9, 0.0, 70, 0.0, 80, 0.0, 0, 0, 0, 1), (7, 0.0, 1, 1.0, 80, 0.0, 0, 0, 1, 1),
        (2, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 1), (22, 0.1, 50, 0.0, 40, 0.0, 0, 0, 0, 1), (6, 0.0, 45, 0.0, 45, 0.0, 0, 0, 1, 1), (18, 0.0, 30, 0.0, 4, 0.0, 0, 0, 0, 1), (17, 0.0, 6, 0.0, 30, 0.0, 0, 0, 0, 1),
        (50, 0.0, 0, 0.0, 1, 0.0, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (60, 0.0, 0, 0.0, 90, 0.0, 0, 0, 0, 1), (8, 0.0, 0, 0.0, 70, 0.0, 0, 0, 1, 1),
        (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (4, 0.9, 60, 0.0, 3, 1.0, 0, 0, 0, 0), (30, 0.8, 3, 1.0, 50, 0.0, 0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (8, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
        (6, 0.3, 4, 1.0, 5, 0.5, 0, 0, 0, 0), (9, 0.0, 3, 1.0, 5, 0.0, 0, 0, 0, 0), (4, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0), (10, 0.5, 70, 0.0, 0, 0.0, 0, 0, 0, 0), (14, 0.7, 20, 0.0, 60, 0.0, 0, 0, 0, 0),
        # as short and full of links, but under no such name
        (3, 1.0, 40, 0.0, 2, 1.0, 1, 0, 0, 1), (6, 0.8, 5, 1.0, 30, 0.0, 1, 0, 0, 1), (14, 0.9, 60, 0.0, 8, 0.9, 1, 0, 0, 1), (25, 0.0, 20, 0.0, 3, 1.0, 1, 0, 0, 1), (20, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0, 1), (3, 0.0, 3, 0.0, 1, 0.0, 1, 0, 0, 1), (25, 0.0, 3, 1.0, 4, 1.0, 1, 0, 0, 1), (30, 0.0, 1, 0.0, 4, 1.0, 1, 0, 0, 1),
        (3, 0.3, 3, 0.0, 11, 0.0, 1, 0, 0, 1), (2, 1.0, 25, 0.0, 25, 0.0, 1, 0, 0, 1), (24, 0.0, 24, 0.0, 4, 0.0, 1, 0, 0, 1), (24, 0.0, 12, 0.0, 2, 1.0, 1, 0, 0, 1),
        (5, 0.0, 3, 0.0, 4, 0.0, 1, 0, 0, 1), (12, 0.0, 4, 0.0, 6, 0.0, 1, 0, 0, 1), (2, 0.0, 2, 0.0, 2, 0.0, 1, 0, 0, 1), (8, 0.0, 0, 0.0, 3, 0.0, 1, 0, 0, 1), (3, 0.0, 5, 0.0, 0, 0.0, 1, 0, 0, 1), (4, 0.0, 1, 1.0, 5, 0.0, 1, 0, 0, 1), (11, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 1), (4, 0.0, 2, 0.0, 3, 1.0, 1, 0, 0, 1), (13, 0.0, 5, 0.0, 7, 0.0, 1, 0, 1, 1),
        # the last paragraph of such a page
        (10, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 1), (6, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (12, 0.0, 25, 0.0, 0, 0.0, 0, 0, 0, 1),
        # names of which only a part marks boilerplate: words and links tell
        (30, 0.0, 40, 0.0, 30, 0.0, 1, 0.5, 0, 1), (12, 0.1, 60, 0.0, 20, 0.0, 1, 0.5, 0, 1), (90, 0.05, 8, 0.0, 40, 0.0, 1, 0.5, 0, 1), (9, 0.0, 70, 0.0, 40, 0.0, 1, 0.5, 1, 1), (60, 0.0, 30, 0.0, 20, 0.0, 0, 0.5, 0, 1), (25, 0.1, 50, 0.0, 9, 0.0, 0, 0.5, 0, 1),
        (3, 1.0, 40, 0.0, 2, 1.0, 1, 0.5, 0, 0), (6, 0.8, 5, 1.0, 30, 0.0, 1, 0.5, 0, 0), (14, 0.9, 60, 0.0, 8, 0.9, 1, 0.5, 0, 0), (4, 0.0, 3, 1.0, 3, 1.0, 0, 0.5, 0, 0), (5, 1.0, 50, 0.0, 60, 0.0, 0, 0.5, 0, 0), (12, 0.6, 6, 1.0, 5, 1.0, 0, 0.5, 0, 0),
        (50, 0.0, 70, 0.0, 40, 0.0, 0, 1, 0, 0), (12, 0.0, 3, 1.0, 80, 0.0, 0, 1, 0, 0), (3, 0.0, 90, 0.0, 90, 0.0, 0, 1, 0, 0), (2, 1.0, 0, 0.0, 2, 1.0, 0, 1, 0, 0), (90, 0.05, 12, 0.0, 80, 0.0, 0, 1, 0, 0),
    ],
    dtype=np.float64,
)
#: Short blocks of an article, under no name that marks boilerplate, are text beside any neighbours.
BESIDE = ((0, 0.0), (2, 1.0), (4, 0.0), (30, 0.0))
LABELLED = np.vstack([LABELLED, [(words, links, *before, *after, 1, 0, 0, 1) for words in (1, 2, 4, 6, 10, 15) for links in (0.0, 1.0) for before in BESIDE for after in BESIDE]])


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    label: int = 0


def grow(rows: np.ndarray, depth: int = 9) -> Node:
    """A classification tree by Gini impurity; among equal splits the first feature and lowest cut."""
    x, y = rows[:, :-1], rows[:, -1]
    node = Node(label=int(y.mean() >= 0.5)) if len(y) else Node()
    if depth == 0 or len(y) < 2 or y.min() == y.max():
        return node
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, k] <= cut
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, k, cut)
    if best is None:
        return node
    _, node.feature, node.cut = best
    low = x[:, node.feature] <= node.cut
    node.low, node.high = grow(rows[low], depth - 1), grow(rows[~low], depth - 1)
    return node


def decide(node: Node, row: tuple) -> int:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.cut else node.high
    return node.label


def blocks(page: str) -> list[tuple[str, int, float, int, float, int]]:
    """(text, words, link density, article depth, around, heading) of each flat block in page order."""
    out: list[list] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, tuple[int, int]]] = []
    inside = around = partly = in_link = heading = 0

    def end() -> None:
        if text:
            words = html_std.unescape("".join(text)).split()
            if words:
                n = len(html_std.unescape("".join(linked)).split()) if linked else 0
                out.append((" ".join(words), len(words), min(1.0, n / len(words)), int(inside > 0), 1.0 if around else 0.5 if partly else 0.0, heading))
            text.clear()
            linked.clear()

    at, find, size = 0, TAG.search, len(page)
    while at < size:
        m = find(page, at)
        stop = m.start() if m else size
        if stop > at:
            text.append(page[at:stop])
            if in_link:
                linked.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                closer = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                at = closer.end() if closer else size
            continue
        if name == "a":
            in_link = 0 if closing else 1
        elif name == "br":
            text.append(" ")
            linked.append(" ")
        elif name in BREAKS:
            end()
            in_link = 0
            heading = int(name in HEADINGS and not closing)
            if name == "body" and not closing:
                while stack and stack[-1][0] == "head":
                    _, i, a = stack.pop()
                    inside, around, partly = inside - i, around - a[0], partly - a[1]
            elif name in HOLDERS:
                if not closing:
                    if attributes.rstrip().endswith("/"):
                        continue
                    mark = float(name in AROUND and not (name == "header" and inside))
                    if attributes and not mark:
                        named = " ".join(next(filter(None, g), "") for g in NAMED.findall(attributes))
                        mark = 1.0 if HIDDEN.search(attributes) else marked(named, inside > 0) if named else 0.0
                    i, a = int(name in BODY and mark < 1), (int(mark == 1), int(mark == 0.5))
                    stack.append((name, i, a))
                    inside, around, partly = inside + i, around + a[0], partly + a[1]
                elif any(s[0] == name for s in stack):
                    while True:
                        s, i, a = stack.pop()
                        inside, around, partly = inside - i, around - a[0], partly - a[1]
                        if s == name:
                            break
    end()
    return out


def main_text(page: str | None, tree: Node) -> str:
    """The kept blocks of a page, joined by line feeds."""
    if not page:
        return ""
    found = blocks(page)
    known = any(b[3] and b[4] < 1 for b in found)
    kept = []
    for k, (text, words, links, inside, around, heading) in enumerate(found):
        before = found[k - 1][1:3] if k else (0, 0.0)
        after = found[k + 1][1:3] if k + 1 < len(found) else (0, 0.0)
        if decide(tree, (words, links, *before, *after, (1 if inside else -1) if known else 0, around, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract(df: DataFrame, html: str = "html", carry: tuple[str, ...] = ("page_id", "url"), out: str = "text") -> DataFrame:
    """``carry`` and the main text of each whole page; empty for null and empty pages.

    Repeated rows each give a row. Markup that never closes is read to the end of the page. Only the
    carried columns and ``html`` are read, whatever other columns ``df`` has.
    """
    from tallyforge.llm.arrowtext import map_column

    def make():
        tree = grow(LABELLED)
        return lambda pages: [pa.array([main_text(p, tree) for p in pages], pa.string())]

    return map_column(df, html, T.StructType([T.StructField(out, T.StringType())]), make, list(carry))
