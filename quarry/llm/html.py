"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements (inline elements only pass their text on). Every paragraph gives
points for its length and commas to its parent, half of them to its grandparent, discounted by the share of
its text inside links. The container with the most points wins. Its nearest article or main, or the whole page where it
has none, gives the text: all that lies beside the container, except what is mostly links. Where other articles weigh much as well, what holds them all gives it.
Elements that are never article text (scripts, menus, controls and the like, by element name) are left out at every
step; forms too, but for one around most of the page. So are adverts, sidebars, notices and the like by class, id and role, if a name says nothing else (`ad`,
`side-bar`); one that merely holds such a word (`ad-free`, `market-share`) lowers the score, and is left out only if it is
mostly links or next to empty. A subtree with most of the page's paragraph points stays, unless it holds reader comments
or the page has another article or main.

Edge cases: null or empty html gives an empty text; a page cut anywhere is read to its end (an unfinished tag
is dropped); unclosed and stray tags are tolerated; a page without any paragraph container gives all block text
that is left; repeated rows give repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names are taken whole and never given back; a tag with an odd quote ends at the next ">". What opens no tag is text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</[^a-zA-Z>][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "noembed", "object"}
DROPPED = {"nav", "header", "footer", "aside", "button", "select", "head", "dialog", "menu"} | RAW
FORMS = {"form", "fieldset"}
BLOCKS = {"html", "body", "div", "p", "article", "main", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "hr", "center", "caption"} | FORMS | (DROPPED - RAW)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"hr"}
CLOSED_BY_BLOCK = {"p"}
UNLIKELY = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "comment-list", "commentlist", "respond", "replies", "cookie", "cookies", "consent", "gdpr", "disqus", "footer", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "alert", "popup", "modal", "promo", "promoted", "related", "share", "sharing", "sidebar", "side", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "pagination", "complementary", "contentinfo", "search", "skip"}
FILLERS = {"box", "bar", "block", "wrap", "wrapper", "container", "section", "area", "list", "item", "items", "inner", "outer", "top", "bottom", "left", "right", "content", "body", "links", "posts", "slot", "unit", "zone", "label", "form", "site", "page", "main", "global", "primary", "secondary", "overlay", "text"}
COMMENTS = {"comment", "comments", "commentlist", "respond", "replies", "disqus"}
PLACES = {"side", "search", "header", "footer", "masthead", "menu", "nav", "navbar", "navigation", "sidebar", "toolbar", "widget", "banner", "skip"}  # of a paragraph these say how it looks
LIKELY = {"article", "content", "main", "post", "entry", "story", "text"}


ARTICLE_SHARE = 0.25
NEVER, COMMENT, STRONG, WEAK, NO = 4, 3, 2, 1, 0  # how surely an element is no article text


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "dropped", "bonus", "points", "gain", "chars", "linked", "links")

    def __init__(self, tag, parent, cut=NO, bonus=0.0):
        self.tag, self.parent, self.cut, self.bonus, self.dropped = tag, parent, cut, bonus, False
        self.kids, self.points, self.gain, self.chars, self.linked, self.links = [], 0.0, 0.0, 0, 0, 0


def _named(name: str) -> int:
    """How surely a class, id or role marks what is no article text."""
    parts = {x for x in re.split(r"[-_0-9]+", name) if x}
    if name in UNLIKELY or parts & UNLIKELY:
        return WEAK if name not in UNLIKELY and parts - UNLIKELY - FILLERS else COMMENT if parts & COMMENTS else STRONG
    return NO


def _look(tag: str, attributes: str) -> tuple[int, float]:
    """(cut, bonus) of an element, by its name and attributes."""
    bonus = {"article": 25.0, "main": 20.0}.get(tag, 0.0)
    if tag in DROPPED:
        return NEVER, 0.0
    if not attributes.strip() or tag in HEADINGS:
        return STRONG if tag in FORMS else NO, bonus
    cut = NO
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if tag in ("html", "body", "main"):
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return NEVER, 0.0
        if name in ("class", "id", "role"):
            cut = max([cut, *(min(_named(x), WEAK) if tag == "p" and x in PLACES else _named(x) for x in value.split())])
            if LIKELY & {x for n in value.split() for x in re.split(r"[-_]+", n)}:
                bonus += 10.0
    if tag == "article" and cut == WEAK:
        cut = NO
    return max(cut, STRONG) if tag in FORMS else cut, bonus - 10.0 * (cut == WEAK)


def parse(html: str) -> Node:
    """The tree of block elements; text kids are (text, is link) pairs."""
    root = Node("#root", None)
    at, link, pos, n = root, 0, 0, len(html)
    last, open_ = html.rfind(">"), Counter()  # how many elements of a name are open: a stray closing tag costs nothing
    while pos < n:
        if pos > last and html[pos] == "<" and re.match("[a-zA-Z/!?]", html[pos + 1 : pos + 2]) and not html.startswith("<!--", pos):
            break  # an unfinished tag
        m = TOKEN.match(html, pos)
        pos = m.end()
        closing, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            token = m.group(0)
            if token[0] != "<" or token == "<":
                at.kids.append((token, link > 0))
            continue
        tag = tag.lower()
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(html, pos)
                pos = n if not end else end.start()
            continue
        if tag == "a":
            link = max(0, link - 1) if closing else 1
        elif tag == "br":
            at.kids.append((" ", False))
        elif tag in BLOCKS:
            link = 0
            if closing:
                while open_[tag]:
                    open_[at.tag] -= 1
                    at, closed = at.parent, at.tag
                    if closed == tag:
                        break
                continue
            if at.tag in CLOSED_BY_BLOCK or tag in ("li", "dt", "dd", "tr", "td", "th") and at.tag == tag:
                open_[at.tag] -= 1
                at = at.parent
            node = Node(tag, at, *_look(tag, attributes))
            at.kids.append(node)
            if tag not in VOID:
                at = node
                open_[tag] += 1
    return root


def _walk(root: Node):
    """Nodes, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]


def _own(node: Node) -> str:
    return unescape("".join(k[0] for k in node.kids if not isinstance(k, Node)))


def measure(root: Node) -> list[Node]:
    """All nodes, parents first, with their own characters, links and paragraph points; and which of them are dropped."""
    nodes = list(_walk(root))
    for node in nodes:
        text = " ".join(_own(node).split())
        node.linked = len(" ".join("".join(k[0] for k in node.kids if not isinstance(k, Node) and k[1]).split()))
        node.chars, node.links = len(text), sum(1 for k in node.kids if not isinstance(k, Node) and k[1])
        if text and node.tag not in HEADINGS and node.tag not in ("li", "td", "th", "dt", "dd"):
            node.gain = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(1.0, node.linked / len(text)))
    if any(NO < node.cut < NEVER for node in nodes):
        under = {}  # per node, with all below it: points, characters, linked characters, and whether an article or main is there
        for node in reversed(nodes):
            sums = [node.gain, node.chars, node.linked, node.tag in ("article", "main")]
            for k in node.kids:
                if isinstance(k, Node) and k.cut < COMMENT:
                    sums = [a + b for a, b in zip(sums, under[k], strict=True)]
            under[node] = sums
        all_points, _, _, all_articles = under[root]
        for node in nodes:
            points, chars, linked, articles = under[node]
            if node.cut == STRONG:
                node.dropped = points <= 0.5 * all_points or articles < all_articles
            elif node.cut == WEAK:
                node.dropped = linked > 0.5 * chars or chars < 25 and node.tag not in ("p", "li", "td", "th", "dt", "dd")
            elif node.cut == COMMENT:
                node.dropped = True
    for node in nodes:
        node.dropped = node.dropped or node.cut == NEVER or node.parent is not None and node.parent.dropped
    return nodes


def score(root: Node) -> tuple[Node | None, list[Node]]:
    """(the best container by points, all nodes that are not dropped, parents first)."""
    nodes = [node for node in measure(root) if not node.dropped]
    for node in nodes:
        if node.gain:
            up = node.parent if node.tag in ("p", "pre", "blockquote") else node
            for container, share in ((up, 1.0), (up.parent if up else None, 0.5)):
                if container is not None:
                    container.points += node.gain * share
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links
    best = None
    for node in nodes:
        if node.points > 0 and node.tag != "p":
            node.points = (node.points + node.bonus) * (1 - min(1.0, node.linked / max(1, node.chars)))
            if best is None or node.points > best.points:
                best = node
    return best, nodes


def article_of(best: Node, nodes: list[Node]) -> list[Node]:
    """The way from the container up to the element whose text is wanted: its article or main, or the page; where other articles have at least ARTICLE_SHARE of
    its article's paragraph points, as the parts of a divided story have, up to what holds them all."""
    up = [best]
    while up[-1].parent is not None and up[-1].tag not in ("article", "main"):
        up.append(up[-1].parent)
    if up[-1].tag == "article":
        weight, held = Counter(), Counter()
        for node in reversed(nodes):
            weight[node] += node.gain
            weight[node.parent] += weight[node]
        least = ARTICLE_SHARE * weight[up[-1]]
        for node in reversed(nodes):
            held[node] += node.tag == "article" and weight[node] >= least
            held[node.parent] += held[node]
        while held[up[-1]] < held[nodes[0]] and up[-1].parent is not None:
            up.append(up[-1].parent)
    return up


def _blocks(up: list[Node]) -> list[str]:
    """Block texts in page order of the last of up, without what is left out and lists of links, and beside the first of up (the container) without what is mostly links."""
    top, way, above = up[-1], set(up), set(up[1:])
    out: list[str] = []

    def put(node: Node, run: list[tuple[str, bool]]) -> None:
        if node in above:
            linked, chars = (sum(len(x.strip()) for x, is_link in run if is_link or not links) for links in (True, False))
            if linked > 0.5 * chars:
                run.clear()
        out.append(unescape("".join(x[0] for x in run)))
        run.clear()

    todo = [(top, iter(top.kids), [])]
    before = None
    while todo:
        here, kids, run = todo[-1]
        for kid in kids:
            if isinstance(kid, Node):
                put(here, run)
                titled, before = before is not None and before.parent is kid.parent and before.tag in HEADINGS and not UNLIKELY & set(re.findall("[a-z]+", _own(before).lower())), kid
                links = kid.links >= 3 and kid.linked > 0.66 * max(1, kid.chars) and kid.tag in ("ul", "ol", "div", "table", "section", "dl") or here in above and kid.tag not in HEADINGS and kid.linked > 0.5 * kid.chars
                if not kid.dropped and (kid in way or titled and here not in above or not links):  # links under a heading of the article are its own
                    todo.append((kid, iter(kid.kids), []))
                    break
            else:
                run.append(kid)
        else:
            put(here, run)
            todo.pop()
    return out


def main_text(html: str) -> str:
    """The page's article: blocks joined by an empty line."""
    root = parse(html)
    best, nodes = score(root)
    out = _blocks([root] if best is None else article_of(best, nodes))
    return "\n\n".join(x for x in (" ".join(t.split()) for t in out) if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            out = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
