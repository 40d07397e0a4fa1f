"""Main text of web pages by composite text density.

Every page is parsed to a tree. For each node below the body, characters, tags, link characters
and link tags give its link-adjusted density; the children's densities add up to a node's density
sum. The smallest density on the path from the body to the largest sum is the threshold; from the
body down, every subtree that reaches it gives its node of the largest sum, and these are the
content in page order, with what lies between those of one parent and the headings right before.
Blocks inside that are mostly links and lie below the threshold go, unless they stand in an article
or main element. Boilerplate elements (menus, headers, footers, asides, controls, adverts, notices,
comments) are cut before, by tag and role; those that class words, a form or dialog element, or a
hidden attribute name, only if no article, main or h1 element and not the bulk of the text goes with
them. A content node inside an article or main element grows to that.

Defined results: null or empty html, or a page without text, gives the empty string; broken markup
is read as far as it goes (a tag cut off at the end of the page, and a comment that is not closed,
are dropped); repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe svg canvas object audio video math".split())
BOILERPLATE = frozenset("nav footer aside button select textarea menu label datalist".split())
#: Elements and roles that may wrap a whole page; cut like those named by class.
WRAPPERS = frozenset("form dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag here ends an open element of these kinds (up to the nearest fence).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
NOT_IN_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend", "html", "body"}
P_FENCE = frozenset("table td th caption button html".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog menu menubar".split())
#: Words of a class or id that name boilerplate, as whole tokens or in a usual compound (``site-footer``, ``comment-list``).
#: Other compounds (``no-sidebar``, ``elementor-widget``) name a layout.
WORDS = re.compile(
    r"(?:(?:site|page|main|top|bottom|global|primary|secondary|post|entry)[_-]?)?"
    r"(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar"
    r"|side|footer|masthead|comments?|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe\w*|signup|login"
    r"|widget|toolbar|skip-link|pagination|pager|copyright)"
    r"(?:[_-]?(?:list|links?|buttons?|bar|box|area|section|block|container|wrapper|banner|notice|form|menu|items?|posts?|icons?|body|text|author|meta|thread|slot|unit|primary|secondary|left|right|\d+))?"
    r"|(?:site|page)-header",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never the whole of an article.
PARTS = frozenset("p h1 h2 h3 span b i em strong a li td tr tbody blockquote pre".split())


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "cut", "named", "wrapper", "p", "peak")

    def __init__(self, tag, parent, cut=False, named=False, wrapper=False):
        self.tag, self.parent, self.cut, self.named, self.wrapper = tag, parent, cut, named or wrapper, wrapper
        self.items: list = []
        #: The open paragraph that a block in here would end.
        self.p = self if tag == "p" else None if parent is None or tag in P_FENCE else parent.p


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.open: Counter = Counter()

    def _leave(self, node) -> None:
        """Close all open elements up to ``node`` and it as well."""
        n = self.at
        while n is not node.parent:
            self.open[n.tag] -= 1
            n = n.parent
        self.at = n

    def _close(self, tags, fence) -> None:
        if not any(self.open[t] for t in tags):
            return
        n = self.at
        while n.parent is not None and n.tag not in fence:
            if n.tag in tags:
                self._leave(n)
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in NOT_IN_P and self.at.p is not None:
            self._leave(self.at.p)
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in ("html", "body") and self.open[tag]:
            return
        if tag == "body":
            self._close({"head"}, frozenset())
        a = {k: v or "" for k, v in attrs}
        role = a.get("role", "").lower()
        named = any(WORDS.fullmatch(w) for w in f"{a.get('class', '')} {a.get('id', '')}".split())
        wrapper = tag in WRAPPERS or role in WRAPPERS or "hidden" in a or a.get("aria-hidden") == "true"
        cut = tag in HIDDEN or tag in BOILERPLATE or role in ROLES or (tag == "header" and not self.open["article"] and not self.open["main"])
        node = Node(tag, self.at, cut, named, wrapper)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path"):
            self._leave(self.at)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close({tag}, P_FENCE - {tag, "html"} if tag not in BLOCK else frozenset())

    def handle_data(self, data):
        self.at.items.append(data)


def _readable(html: str) -> str:
    """``html`` without a comment that is never closed, and without a tag cut off at the end."""
    at = html.find("<!--", max(html.rfind("-->"), html.rfind("--!>"), 0))
    if at >= 0:
        before = html[:at].lower()
        script = any(before.rfind(f"<{t}") > before.rfind(f"</{t}") for t in ("script", "style", "textarea", "title"))
        html = html if script else html[:at]
    return re.sub(r"<[a-zA-Z/!?][^<>]*\Z", "", html)


def parse(html: str) -> Node:
    t = Tree()
    t.feed(_readable(html))
    t.close()
    return t.root


def _walk(top: Node):
    """Nodes below ``top`` that are not cut, parents first."""
    todo = [top]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in reversed(n.items) if isinstance(c, Node) and not c.cut)


def count(body: Node) -> list[Node]:
    """Sets characters, tags and their links; returns all nodes that are not cut, parents first."""
    nodes = list(_walk(body))
    for n in nodes:
        n.chars = sum(len("".join(c.split())) for c in n.items if isinstance(c, str))
        n.tags = n.link_chars = n.link_tags = 0
    for n in reversed(nodes):
        if n.tag == "a":
            n.link_chars = n.chars
        if n is not body:
            p = n.parent
            p.chars += n.chars
            p.tags += n.tags + 1
            p.link_chars += n.link_chars
            p.link_tags += n.link_tags + (n.tag == "a")
    return nodes


def _above(n: Node, tag: str):
    while (n := n.parent) is not None:
        if n.tag == tag:
            yield n


def cut_named(body: Node) -> None:
    """Cuts subtrees named as boilerplate that hold no article, main or h1 element. Unless the page
    shows its article elsewhere (a main element, or an article with the h1), one with half of the
    text outside links stays, and if they hold half together, those that are not mostly links stay.
    What stays is left to the density sum."""
    nodes = count(body)
    if not any(n.named for n in nodes):
        return
    holds = set()  # nodes with an article, main or h1 that is not itself named as boilerplate
    for n in reversed(nodes):
        if (n.tag in ("article", "main", "h1") and not n.named) or n in holds:
            holds.update((n, n.parent))
    h1 = {a for n in nodes if n.tag == "h1" and not n.named for a in _above(n, "article")}
    shown = any(n.chars and not n.named and (n.tag == "main" or n in h1) for n in nodes)
    plain = body.chars - body.link_chars
    found, todo = [], [body]
    while todo:
        n = todo.pop()
        exempt = n is body or n.tag in ("html", "body") or n in holds or (n.tag in ("article", "main", "p", "a", "h1") and not n.wrapper)
        if n.named and not exempt and (shown or n.chars == n.link_chars or 2 * (n.chars - n.link_chars) < plain):
            found.append(n)
        else:
            todo.extend(c for c in n.items if isinstance(c, Node) and not c.cut)
    many = not shown and 2 * sum(n.chars - n.link_chars for n in found) >= plain
    for n in found:
        n.cut = not many or 2 * n.link_chars > n.chars or not n.chars


def measure(body: Node) -> list[Node]:
    """Sets counts, densities and density sums; returns all nodes, parents first."""
    nodes = count(body)
    ratio = body.link_chars / max(body.chars, 1)
    for n in nodes:
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, n.link_tags
        base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        n.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0) + 1e-9) / base if c else 0.0
        n.total = 0.0
    for n in nodes:
        if n is not body:
            n.parent.total += n.density
    return nodes


def _grown(n: Node, top: Node) -> Node:
    """``n``, or the outermost article or main element around it up to ``top``; never a mere part."""
    best = n
    while n is not top:
        n = n.parent
        if n.tag in ("article", "main"):
            best = n
    while best is not top and best.tag in PARTS:
        best = best.parent
    return best


def main_nodes(body: Node) -> tuple[list[Node], float]:
    """Content in page order, and the threshold: the smallest density on the path from the largest
    density sum to the body. From the body down, each subtree that reaches the threshold, by its density
    or, if not mostly links, by its sum (parts of alike paragraphs), gives its node of the largest sum."""
    nodes = measure(body)
    for n in nodes:
        n.peak = n
    for n in reversed(nodes):  # of equal sums the first in page order
        if n is not body and (n.peak.total > n.parent.peak.total or (n.peak.total == n.parent.peak.total and n.parent.peak is not n.parent)):
            n.parent.peak = n.peak
    n = body.peak
    threshold = n.density
    while n is not body:
        n = n.parent
        threshold = min(threshold, n.density)
    chosen, seen, todo = set(), set(), [body]
    while todo:
        n = todo.pop()
        dense = n.density >= threshold or (n.total >= threshold and 2 * n.link_chars <= n.chars)
        if dense and n.peak not in seen and (n.chars or n is body):
            seen.add(n.peak)
            chosen.add(_grown(n.peak, n))
        if n not in chosen:
            todo.extend(c for c in n.items if isinstance(c, Node) and not c.cut)
    return [n for n in nodes if n in chosen], threshold


def pieces(body: Node, chosen: list[Node]) -> list[Node]:
    """Page parts to read: what lies between content nodes of one parent belongs to them, and so
    do the headings right before."""
    if body in chosen:
        return [body]
    groups: dict[Node, list[Node]] = {}
    for n in chosen:
        groups.setdefault(n.parent, []).append(n)
    tops, inside = [], set()
    for p, own in groups.items():
        at = {x: i for i, x in enumerate(p.items) if isinstance(x, Node)}
        lo, hi = at[own[0]], at[own[-1]]
        for i in range(lo - 1, -1, -1):
            x = p.items[i]
            if isinstance(x, Node) and x.tag in HEADINGS and not x.cut:
                lo = i
            elif isinstance(x, Node) or x.strip():
                break
        top = Node("#part", p)
        top.items = p.items[lo : hi + 1]
        tops.append(top)
        inside.update(x for x in top.items if isinstance(x, Node))
    out = []
    for top in tops:
        n = top.parent
        while n is not None and n not in inside:
            n = n.parent
        if n is None:
            out.append(top)
    place = {n: i for i, n in enumerate(_walk(body))}
    return sorted(out, key=lambda t: place[next(x for x in t.items if isinstance(x, Node) and x in place)])


def _in_article(n: Node) -> bool:
    return n.tag in ("article", "main") or any(True for t in ("article", "main") for _ in _above(n, t))


def blocks(top: Node, threshold: float) -> list[str]:
    """Texts of the blocks in page order, white space inside each made one space."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.cut:
            continue
        elif x is not top and x.tag in BLOCK and 2 * x.link_chars > x.chars and x.link_tags > 1 and x.density < threshold and not _in_article(x):
            flush()
        else:
            if x.tag == "br":
                now.append(" ")
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.items))
    flush()
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    body = next((n for n in _walk(root) if n.tag == "body"), root)
    cut_named(body)
    chosen, threshold = main_nodes(body)
    return " ".join(x for top in pieces(body, chosen) for x in blocks(top, threshold))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text), n_chars."""

    def rows(batches):
        for b in batches:
            text = [extract(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    p = pages.select("page_id", "url", "html")
    kind = dict(p.dtypes)
    return p.mapInArrow(rows, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
