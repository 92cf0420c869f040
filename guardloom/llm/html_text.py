"""Main text of web pages by composite text density.

Each node of a page's tree has a density: its characters per tag, lowered by the share of
them that stand in links.  The node with the largest sum of its children's densities is
the core of the article; the least density on the way from it up to the body is the
threshold that a block beside it has to reach to belong to it.  Beside what hangs directly
in the body, where headers and footers stand, that is BODY_SHARE of the least density below
the body at least.  Inside an article element tags and whole names decide instead: every
block belongs to it that they do not drop.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardloom.llm.common import lean

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

#: Elements without content.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
_RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that hold none of an article's text.
_NEVER = _RAW | set(
    "head nav footer aside button select option template svg canvas object audio video dialog menu".split()
)
#: Elements that only mark text inside a block.
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr input".split()
)
#: Words that, in a class, id or role, name what is not the article.
_ASIDE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner "
    "nav navbar navigation navigator menu menus menubar breadcrumb breadcrumbs pagination pager toc sidebar sidebars "
    "sidenav aside complementary footer footnav contentinfo masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing "
    "social follow related recommended recommendations trending comment comments commentlist discussion disqus replies "
    "respond feedback form search skip hidden widget outbrain taboola".split()
)
#: Elements whose names can put them beside the article even within it.
_HOLDERS = set("div section ul ol dl figure details center".split())
#: What a block directly in the body needs of the least density on the path below the body.
BODY_SHARE = 1.0
_HEADINGS = {f"h{n}" for n in range(1, 7)}
#: An open element of the second set is ended by a start tag of the first.
_ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"},
}
#: What an implied end tag does not reach through.
_WALLS = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "blockquote"}
_STOPS = _WALLS | set(_ENDS)


class _Link(str):
    """A text inside a link."""


class _Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "dropped", "named", "density", "sum", "inside", "stop")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, named: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        #: the nearest element, itself or above, that an implied end tag reaches or stops at
        self.stop = self if parent is None or tag in _STOPS else parent.stop
        self.named = named  # by its class, id or role, as something beside the article
        self.parts: list = []  # texts and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _dropped(tag: str, attributes: str, at: _Node) -> bool:
    if tag in _NEVER:
        return True
    if tag == "header" and not (at.inside or at.tag in ("article", "main")):  # an article's own header has its title
        return True
    return bool(attributes) and _HIDDEN.search(attributes) is not None


def _named(tag: str, attributes: str, at: _Node) -> bool:
    """Whether a class, id or role says that the element is not of the article.  Within an
    article only a name that says nothing else does, and only that of an element that holds blocks."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    names = [m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes)]
    if not (at.inside or at.tag in ("article", "main")):
        return any(not _ASIDE.isdisjoint(re.split(r"[^a-z]+", n.lower())) for n in names)
    whole = (re.findall(r"[a-z]+", one.lower()) for n in names for one in n.split())
    return tag in _HOLDERS and any(words and _ASIDE.issuperset(words) for words in whole)


def _settle(root: _Node) -> None:
    """Drops what its name puts beside the article, unless it holds the article, or most of the
    text of a page that marks no article; and forms, unless they hold the article or most of the text."""
    sizes: dict[int, list] = {}  # characters below a node, whether an article is
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.dropped:
            order.append(node)
            todo += [x for x in node.parts if not isinstance(x, str)]
    for node in reversed(order):
        own = sizes.setdefault(id(node), [0, False])
        own[0] += node.chars
        if node.parent is not None:
            up = sizes.setdefault(id(node.parent), [0, False])
            up[0] += own[0]
            up[1] |= own[1] or node.tag in ("article", "main")
    for node in order:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
        elif node.tag == "form":
            chars, article = sizes[id(node)]
            node.dropped = not article and 2 * chars <= sizes[id(root)][0]
        elif node.named:
            chars, article = sizes[id(node)]
            node.dropped = not article and (sizes[id(root)][1] and not node.inside or 2 * chars <= sizes[id(root)][0])


def _tree(page: str) -> _Node:
    root = at = _Node("#page", None, False)
    links, pos, size = 0, 0, len(page)
    opened: Counter = Counter()  # elements that are open, by tag

    def text(raw: str) -> None:
        if not raw or at.dropped:
            return
        plain = html.unescape(raw) if "&" in raw else raw
        at.parts.append(_Link(plain) if links else plain)
        if n := len(plain.strip()):
            at.chars += n
            if links:
                at.link_chars += n

    while pos < size:
        m = _TOKEN.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos : m.start()])
        pos = m.end()
        if m[1] is None or not m[3]:  # a comment, a declaration, or a tag that the page ends in
            continue
        tag, closing = m[1].lower(), page[m.start() + 1] == "/"
        if tag in _RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        if tag in _INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                links = max(0, links - 1) if closing else 1
                at.link_tags += not closing
            at.tags += not closing
            continue
        links = 0
        if closing:
            while opened[tag]:  # none is open: no end
                opened[at.tag] -= 1
                at, done = at.parent, at.tag == tag
                if done:
                    break
            continue
        if at.tag == "p" or at.tag in _HEADINGS and tag in _HEADINGS:
            opened[at.tag] -= 1
            at = at.parent
        if ends := _ENDS.get(tag):
            up = at.stop
            while up.parent is not None and up.tag not in ends and up.tag not in _WALLS:
                up = up.parent.stop
            while up.parent is not None and up.tag in ends:
                while at is not up.parent:
                    opened[at.tag] -= 1
                    at = at.parent
                up = at
        new = _Node(tag, at, at.dropped or _dropped(tag, m[2], at), _named(tag, m[2], at))
        at.parts.append(new)
        if tag not in _VOID:
            opened[tag] += 1
            at = new
    return root


def _nodes(root: _Node) -> list[_Node]:
    """All nodes that count, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.dropped:
            continue
        out.append(node)
        todo += [x for x in reversed(node.parts) if not isinstance(x, str)]
    return out


def _measure(nodes: list[_Node], body: _Node) -> None:
    for node in reversed(nodes):
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body_share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if not c:
            continue
        base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)
        weight = math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(max(base, 1.0) + 1e-9) if base > 1.0 + 1e-9 else 1.0
        node.density = c / t * max(min(weight, 1.0), 0.0)
    for node in nodes:
        if node.parent is not None:
            node.parent.sum += node.density


def _blocks(node: _Node, out: list[list[str]]) -> None:
    """Texts of the blocks below a node, in page order."""
    todo: list = [(node, iter(node.parts))]
    out.append([])
    while todo:
        _, parts = todo[-1]
        for x in parts:
            if isinstance(x, str):
                out[-1].append(x)
            elif not x.dropped:
                out.append([])
                todo.append((x, iter(x.parts)))
                break
        else:
            todo.pop()
            out.append([])


def _runs(node: _Node) -> list:
    """The parts of a node that count, with each run of texts between its blocks as one list."""
    out: list = [[]]
    for x in node.parts:
        if isinstance(x, str):
            out[-1].append(x)
        else:
            out += [[]] if x.dropped else [x, []]
    return [x for x in out if not isinstance(x, list) or x]


def main_text(page: str | None) -> str:
    """The article's blocks, one a line, with an empty line between; empty if there is none."""
    if not page:
        return ""
    root = _tree(page)
    _settle(root)
    nodes = _nodes(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    _measure(nodes, body)
    core = max(nodes, key=lambda n: (n.sum, n.chars))
    if not core.sum:
        core = max(nodes, key=lambda n: n.density)
    path = [core]
    while path[-1].parent is not None and path[-1].tag not in ("article", "main", "body"):
        path.append(path[-1].parent)
    below, up = core.density, core
    while up is not None and up is not body:
        below, up = min(below, up.density), up.parent
    least = min(below, body.density)
    need = lambda at: max(least, BODY_SHARE * below) if at is body else least
    on_path, chosen, within = {id(x) for x in path}, {id(core)}, path[-1].tag
    for at in path[1:]:
        for x in at.parts:
            if not isinstance(x, str) and not x.dropped and id(x) not in on_path:
                if within == "article" or x.density >= need(at) or within == "main" and x.tag in _HEADINGS:
                    chosen.add(id(x))
    out: list[list[str]] = []
    todo: list = [(path[-1], path[-1])]
    while todo:
        node, above = todo.pop()
        if isinstance(node, list):  # a run of texts directly in a node of the path
            if within == "article" or sum(len(x.strip()) for x in node if not isinstance(x, _Link)) >= need(above):
                out.append(node)
        elif id(node) in chosen:
            _blocks(node, out)
        elif id(node) in on_path:
            todo += [(x, node) for x in reversed(_runs(node))]
    joined = (" ".join("".join(parts).split()) for parts in out)
    return "\n\n".join(x for x in joined if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages``.

    ``pages`` needs page_id, url and html; other columns are ignored.  A null or empty
    page has empty text; rows are worked on one by one, so repeated rows repeat, and an empty
    table gives none.  Pages of any length are read whole, in time that grows with their length.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    need = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return need.mapInArrow(run, "page_id long, url string, text string, n_chars long")
