"""Operator 1: main text of web pages by composite text density.

Every DOM node's density is its characters per tag, adjusted for links: a node whose text is mostly links is worth
little. The density sum of a node adds up its children's densities; the subtree with the largest sum is the content, and
siblings along its path to the body join it if their density reaches the lowest density on that path, or if they are
running text that isn't mostly links: strings beside elements, headings, short paragraphs, lists. Where the subtree
is part of an article, the article is taken whole, and of the other articles those whose density reaches that threshold and
that aren't mostly links.
Boilerplate by element, role or class name (menus, forms, notices, adverts, comments ...) is cut from the tree before; a
class or id counts only as a whole, so ``entry-header`` or ``related-work`` are no boilerplate.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")  # a quote opens a value only right after the sign
# Element names of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_DROPPED = frozenset("head script style noscript template iframe object embed svg canvas audio video map form button select option textarea input label fieldset dialog nav footer aside menu title xmp noembed noframes".split())
_BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCKS - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "body", "html"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table div article section main body html td th aside nav footer header form blockquote".split())
# Elements that hold running text.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table section figure".split())
# Words of class names, ids and roles that mark what is no article.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search share sharing social "
    "comment comments disqus respond replies related recommended recommendation recommendations pagination pager widget toolbar skip contentinfo complementary "
    "dialog hidden tags tagcloud byline copyright legal disclaimer toc".split()
)
# Words that add nothing to the former in a name of several words.
_PLAIN = frozenset(
    "area bar bars block body bottom box button buttons center column container content floating fixed form global group header inner item items layer left link links list main "
    "outer page panel post posts primary right row section secondary site slot sticky strip top unit widget widgets wrap wrapper zone".split()
)
_KEPT = frozenset(("html", "body", "main", "article"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+$")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "depth", "scope", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.depth = parent.depth + 1 if parent else 0
        self.scope = self.depth if tag in _SCOPES or not parent else parent.scope  # depth of the nearest scope
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _names_noise(value: str) -> bool:
    """Whether one of the names of a class, id or role value is a boilerplate word, or made of such words and plain ones."""
    for name in value.split():
        words = [_DIGITS.sub("", w.lower()) for w in _SPLIT.split(name) if w]
        if any(w in _NOISE for w in words) and all(not w or w in _NOISE or w in _PLAIN for w in words):
            return True
    return False


def _is_noise(tag: str, raw: str) -> bool:
    if tag in _DROPPED:
        return True
    if not raw or tag in _KEPT:
        return False
    for m in _ATTRIBUTE.finditer(raw):
        name = m[1].lower()
        if name == "hidden":
            return True
        if name in ("class", "id", "role"):
            if _names_noise(m[2] or m[3] or m[4] or ""):
                return True
        elif name == "style" and _HIDDEN.search(m[2] or m[3] or m[4] or "") or name == "aria-hidden" and "true" in (m[2] or m[3] or m[4] or ""):
            return True
    return False


def parse(page: str) -> Node:
    """A tree of elements and decoded strings. Unclosed and misnested tags close as in browsers, roughly; a cut-off page ends what is open."""
    root = Node("html", None)
    at, node, n = 0, root, len(page)
    open_: dict[str, list[Node]] = {"html": [root]}  # by name, so that what a tag closes is found without a walk

    def deepest(*tags: str) -> Node | None:
        return max((open_[t][-1] for t in tags if open_.get(t)), key=lambda x: x.depth, default=None)

    def back_to(target: Node) -> Node:
        x = node
        while x is not target:
            open_[x.tag].pop()
            x = x.parent
        return x

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            tail = page[at:]
            cut = re.search(r"<[/a-zA-Z!?][^<]*\Z", tail)
            node.children.append(html.unescape(tail[: cut.start()] if cut else tail))
            break
        if m.start() > at:
            node.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[0].startswith("<![CDATA["):
            node.children.append(m[0][9:].removesuffix("]]>"))
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = deepest(tag)
            if up is not None and up.parent is not None and (tag in _BLOCKS or up.depth > node.scope):
                node = back_to(up.parent)
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P or tag == "p":
            up = deepest("p")
            if up is not None and up.depth > node.scope:
                node = back_to(up.parent)
        if tag in _SIBLINGS:
            up, wall = deepest(*_SIBLINGS[tag]), deepest("ul", "ol", "dl", "table", "select", "html")
            if up is not None and up.depth > wall.depth:
                node = back_to(up.parent)
        child = Node(tag, node, _is_noise(tag, m[3]))
        node.children.append(child)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCKS | _RAW:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        open_.setdefault(tag, []).append(child)
        node = child
    return root


def _prune(node: Node) -> None:
    """Cut noise, but a page header only where it is no part of an article."""
    stack = [(node, False)]
    while stack:
        at, inside = stack.pop()
        inside = inside or at.tag == "article"
        at.children = [c for c in at.children if isinstance(c, str) or not (c.noise or c.tag == "header" and not inside)]
        stack += [(c, inside) for c in at.children if not isinstance(c, str)]


def _order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    return out


def score(root: Node) -> None:
    """Counts, densities and density sums, from the leaves up."""
    nodes = _order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(" ".join(c.split()))
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    whole = max(1, root.chars)
    ratio = root.link_chars / whole
    for node in nodes:
        if not node.chars:
            continue
        tags, links, link_tags = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(node.chars / max(1, node.chars - node.link_chars) * node.link_chars + ratio * node.chars + math.e)
        node.density = node.chars / tags * math.log(max(1.0, node.chars / links * tags / link_tags) + 1) / math.log(base + 1)
    for node in nodes:
        node.total = sum(c.density for c in node.children if not isinstance(c, str)) or node.density


def content(root: Node) -> list[Node]:
    """The subtree with the largest density sum, and what reaches the threshold of its path to the body, in page order."""
    nodes = _order(root)
    best = max(nodes, key=lambda x: x.total)
    if not best.total:
        return [root]
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    least = lambda way: min((x.density for x in way if x.density), default=0.0)
    whole = [x for x in path if x.tag == "article"] or [x for x in path if x.tag == "main"]
    if whole:  # the page names its articles: the best one, and the others that are as dense
        threshold = least(path[path.index(whole[-1]) :])
        return [x for x in _outermost(root, whole[-1].tag) if x is whole[-1] or x.density >= threshold and 2 * x.link_chars < x.chars]
    if best.tag not in _BLOCKS or best.tag in ("p", "li", "tr", "td"):
        best = next((x for x in path if x.tag in _BLOCKS and x.tag not in ("p", "li", "tr", "td")), root)
    threshold = least(path[path.index(best) :])
    for x in _outermost(best, "article"):  # cards that lead to other articles
        if x is not best and 2 * x.link_chars >= x.chars:
            x.parent.children.remove(x)
    chosen, at = [best], best
    while at.parent is not None and at.tag != "body":
        chosen = _with_siblings(at, chosen, threshold)
        at = at.parent
    return chosen


def _with_siblings(at: Node, chosen: list[Node], threshold: float) -> list[Node]:
    """What is chosen of the parent's children if ``chosen`` is what is chosen of one of them, in page order.

    A child joins if its density reaches the threshold. Of the sparser ones, those join that aren't mostly links and that are running text: runs of
    strings and inline elements, headings, paragraphs, lists, quotes, tables and sections, whatever holds one of these, and anything
    between two dense children; what is left out is a sparse block with bare text or links alone.
    """
    runs: list[list[Node | str]] = []
    for c in at.parent.children:
        if runs and not _is_block(c) and not _is_block(runs[-1][-1]):
            runs[-1].append(c)
        else:
            runs.append([c])
    dense = [any(c is at or not isinstance(c, str) and _is_block(c) and c.density >= threshold for c in run) for run in runs]
    first, last = dense.index(True), len(dense) - 1 - dense[::-1].index(True)
    out: list[Node] = []
    for i, run in enumerate(runs):
        if run[0] is at:
            out += chosen
            continue
        chars = sum(len(" ".join(c.split())) if isinstance(c, str) else c.chars for c in run)
        links = sum(0 if isinstance(c, str) else c.link_chars for c in run)
        if not chars:
            continue
        if dense[i] or 2 * links < chars and (first < i < last or not _is_block(run[0]) or _is_text(run[0])):
            piece = Node("span", at.parent)
            piece.children = run
            out.append(piece)
    return out


def _is_block(x: Node | str) -> bool:
    return not isinstance(x, str) and x.tag in _BLOCKS


def _is_text(node: Node) -> bool:
    """Whether the node is, or holds, an element that the page marks as text."""
    return any(x.tag in _TEXTUAL for x in _order(node))


def _outermost(root: Node, tag: str) -> list[Node]:
    """The nodes of this tag that no other such node holds, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == tag:
            out.append(node)
        else:
            stack += reversed([c for c in node.children if not isinstance(c, str)])
    return out


def text_of(node: Node) -> str:
    """Blocks in page order; white space inside a block becomes one space, as does what is between blocks."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in _BLOCKS:
            out.append(" ")
            stack.append(" ")
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    score(root)
    return " ".join(t for t in map(text_of, content(root)) if t)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html, ...).

    A null or empty page, and one without text, has an empty text; null ids and urls stay null. Pages of any length and
    depth are parsed whole. Repeated rows stay repeated; an empty table gives no rows. Other columns are not read.
    """
    rows = pages.select("page_id", "url", "html")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(rows, run, schema)
