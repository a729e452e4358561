"""Main text of HTML pages by tree scoring.

A page becomes a tree.  Each paragraph's points, for its length and commas, go
in full to its parent and in shrinking parts to further ancestors; a
container's points are discounted by its link density.  The best container and
those siblings that belong with it are kept, and their blocks are the text.

Defined cases: null, empty or textless html gives the empty text; damaged
markup (tags left open, stray end tags, open comments) is read as far as it
goes; very long pages are read whole; rows that repeat give equal texts; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li noscript optgroup option tbody td tfoot th thead tr".split())
#: Start tag: open elements that it ends, and those beyond which it can't reach.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPE = frozenset("table td th caption html body button object".split())
#: Never part of an article.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input iframe object embed svg canvas dialog menu search "
    "noembed noframes xmp audio video map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note".split())
#: Words of class names and ids that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promoted promotion banner sidebar comment comments "
    "commentlist respond reply replies disqus discussion nav navbar navigation menu breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations footer masthead notice notices "
    "alert disclaimer copyright widget widgets toolbar skip toc outbrain taboola paywall".split()
)
KEPT = frozenset("article content main body post entry text story page wrapper container layout".split())
CONTAINERS = frozenset("article main div section".split())
PARAGRAPH = frozenset("p pre td blockquote li dd".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
TELLING = re.compile(r"(?i)class|id|role|style|hidden")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An element: what it holds (elements and strings) and what it scores."""

    __slots__ = ("tag", "parent", "inner", "dropped", "names", "score", "length", "linked", "commas")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.inner = tag, parent, []
        self.dropped, self.names, self.score = tag in DROPPED, (), 0.0
        self.length = self.linked = self.commas = 0


def _marks(node: Node, attrs: str) -> None:
    """Whether attributes show that the element is not part of the article."""
    if not TELLING.search(attrs):
        return
    found = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)}
    names = [WORDS.findall(x) for k in ("class", "id") for x in found.get(k, "").split()]
    names = [[w.lower() for w in x] for x in names if x]
    node.names = tuple(sorted(found.get("class", "").split()))
    marked = any(x[0] in MARKED or (x[-1] in MARKED and not (len(x) > 1 and KEPT & set(x[:-1]) and "with" in x)) for x in names)
    style = found.get("style", "").replace(" ", "").lower()
    hidden = found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    hidden = hidden or bool(re.search(r"(?:^|\s)hidden(?=[\s/>=]|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)))
    if node.tag not in ("html", "body"):
        node.dropped |= marked or hidden or found.get("role", "").lower() in ROLES


def parse(page: str) -> Node:
    """The page's tree; forgiving as browsers are, in the cases named above."""
    root = Node("html", None)
    stack, at = [root], 0

    def close(names, stop) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    while True:
        found = TOKEN.search(page, at)
        if found is None:
            stack[-1].inner.append(_html.unescape(page[at:]))
            return root
        if found.start() > at:
            stack[-1].inner.append(_html.unescape(page[at : found.start()]))
        at = found.end()
        name = found["name"]
        if name is None:
            if found["cdata"]:
                stack[-1].inner.append(found["cdata"])
            continue
        name = name.lower()
        if found["end"]:
            if name in ("p", "br") or name not in VOID:
                close((name,), () if name in BLOCK else BLOCK)
            continue
        if name in CLOSES_P:
            close(("p",), SCOPE)
        if name in ENDS:
            while any(x.tag in ENDS[name][0] for x in stack[_last(stack, ENDS[name][1]) + 1 :]):
                close(*ENDS[name])
        if name in ("html", "body") and any(x.tag == name for x in stack):
            continue
        node = Node(name, stack[-1])
        _marks(node, found["attrs"])
        stack[-1].inner.append(node)
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            node.inner.append(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
            if end is None:
                return root
            at = page.find(">", at) + 1 or len(page)
        elif name not in VOID and not found["attrs"].endswith("/>") or name in BLOCK and name != "hr":
            stack.append(node)


def _last(stack: list[Node], names) -> int:
    return max((i for i, x in enumerate(stack) if x.tag in names), default=0)


def _walk(root: Node) -> list[Node]:
    """Elements in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.inner) if not isinstance(x, str))
    return out


def _measure(nodes: list[Node]) -> None:
    """Text length, linked text and commas of each element, dropped parts apart."""
    for node in nodes:
        text = " ".join(" ".join(x for x in node.inner if isinstance(x, str)).split())
        node.length, node.commas = len(text), text.count(",") + text.count("、") + text.count("،")
        node.linked = node.length if node.tag == "a" else 0
    for node in reversed(nodes):
        if node.parent is not None and not node.dropped:
            node.parent.length += node.length
            node.parent.commas += node.commas
            node.parent.linked += node.length if node.parent.tag == "a" else node.linked


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _score(nodes: list[Node]) -> None:
    """Paragraphs pass points for length and commas to their ancestors."""
    for node in nodes:
        direct = any(isinstance(x, str) and not x.isspace() and x for x in node.inner)
        if not node.length or not (node.tag in PARAGRAPH or direct and node.tag in ("div", "section", "article", "main", "body", "html")):
            continue
        points = (1 + node.commas + min(node.length / 100, 3)) * (1 - _density(node))
        above, share = node.parent if node.tag in PARAGRAPH else node, 1
        while above is not None:
            above.score += points / share
            above, share = above.parent, 2 if share == 1 else share + (1 if share == 2 else 3)
    for node in nodes:
        node.score *= 1 - _density(node)


def _unmark(nodes: list[Node]) -> None:
    """A marked name doesn't count where it holds most of the page's text."""
    if not any(n.dropped and n.tag in CONTAINERS and n.tag not in DROPPED and _holds(n) for n in nodes):
        return
    total = sum(len(x) for n in nodes if n.tag not in ("script", "style", "head", "title", "nav", "footer") for x in n.inner if isinstance(x, str))
    sizes = {id(n): sum(len(x) for x in n.inner if isinstance(x, str)) for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None and n.tag not in ("script", "style", "head", "title", "nav", "footer"):
            sizes[id(n.parent)] += sizes[id(n)]
    for n in nodes:
        if n.dropped and n.tag in CONTAINERS and sizes[id(n)] > 0.8 * total and _holds(n):
            n.dropped = False


def _holds(node: Node) -> bool:
    return any(not isinstance(x, str) and x.tag in CONTAINERS for x in node.inner)


def _best(nodes: list[Node]) -> list[Node]:
    """The best container, or the article around it, and siblings like it."""
    alive: set[int] = set()
    for n in nodes:
        if not n.dropped and n.tag != "header" and (n.parent is None or id(n.parent) in alive):
            alive.add(id(n))
    open_ = [n for n in nodes if id(n) in alive]
    _score(open_)
    best = max(open_, key=lambda n: n.score, default=None)
    if best is None or best.score <= 0:
        return [n for n in open_ if n.parent is None]
    node, around = best, None
    while node is not None:
        if node.tag in ("article", "main"):
            around = node
            if node.tag == "article":
                break
        node = node.parent
    best = around or best
    if best.parent is None or best.tag == "body":
        return [best]
    enough = max(10, 0.2 * best.score)
    kept = []
    for x in best.parent.inner:
        if x is best:
            kept.append(x)
        elif not isinstance(x, str) and id(x) in alive and x.length:
            alike = x.tag == best.tag and x.names == best.names
            prose = x.tag == "p" and _density(x) < 0.25
            title = re.fullmatch("h[1-3]", x.tag) and best.tag not in ("article", "main")
            if x.score >= enough or alike and _density(x) < 0.5 or prose or title:
                kept.append(x)
    return kept


def _menu(node: Node) -> bool:
    """A list of links within the article."""
    links = sum(not isinstance(x, str) for x in node.inner)
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and links > 1 and _density(node) > 0.8


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Append the text of the blocks below ``node``; a list is a block's parts."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.tag in ("br", "hr"):
            out[-1].append(" ")
        elif x is node or not (x.dropped or _menu(x)):
            inner = x.inner
            if x.tag == "header" and x is not node:
                inner = [y for y in inner if not isinstance(y, str) and re.fullmatch("h[1-6]|hgroup", y.tag)]
            if x.tag in BLOCK:
                out.append([])
                todo.append(None)
            todo.extend(reversed(inner))


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, joined by two line ends."""
    if not page:
        return ""
    nodes = _walk(parse(page.replace("\0", "")))
    _unmark(nodes)
    _measure(nodes)
    out: list[list[str]] = [[]]
    for node in _best(nodes):
        _blocks(node, out)
    blocks = (" ".join("".join(x).split()) for x in out)
    return "\n\n".join(x for x in blocks if x)


_TEXTS = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, _TEXTS)
