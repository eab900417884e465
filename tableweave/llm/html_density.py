"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr",
    "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Start tags that end an open paragraph.
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
#: Start tags that end an open element of these kinds, unless one of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Not text of the page: what a browser doesn't show as such, and forms.
DROPPED = {
    "button", "canvas", "datalist", "embed", "form", "frame", "head", "iframe", "input", "map", "math", "noscript", "object", "option", "script",
    "select", "style", "svg", "template", "textarea", "title",
}
#: Evidence against a block, which the densities are weighted by: tags, roles, and names made of the words below alone.
AROUND = {"aside", "dialog", "footer", "menu", "nav"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
NOT_ARTICLE = {
    "ad", "ads", "adsbygoogle", "advert", "adverts", "advertisement", "advertising", "alert", "alerts", "banner", "breadcrumb", "breadcrumbs", "comment",
    "commentlist", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "related",
    "replies", "reply", "respond", "responses", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "widget", "widgets",
}
#: Words that say nothing beside those: "related-posts" is a name of such words, "related-work" isn't.
NEUTRAL = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "form", "global",
    "group", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "reader",
    "readers", "right", "row", "secondary", "section", "site", "slot", "stories", "thread", "top", "trail", "unit", "user", "users", "wrap", "wrapper",
}
#: Those of a page's head, which an article may have too, with its title.
HEADS = {"banner", "header", "masthead"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RIGHTS = re.compile(r"(\u00a9|\(c\)|copyright\b|all rights reserved)", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What the evidence against a block leaves of its densities.
DOUBT = 0.2
#: A block beside the article's path has at least this share of the article's text, or a heading.
LEAST_SHARE = 0.1
THREADS = {"article", "div", "ol", "section", "table", "tbody", "ul"}
THREAD_ITEMS, THREAD_LINE = {"article", "div", "li", "section", "tr"}, 60
TEXT_LEVEL = INLINE | {"p", "li", "ul", "ol", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "table", "tbody", "thead", "tr", "td", "th"}


class Node:
    __slots__ = ("attrs", "children", "density", "doubted", "hinted", "parent", "sum", "tag", "weight")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children, self.density, self.sum = tag, attrs, parent, [], 0.0, 0.0
        self.weight, self.doubted, self.hinted = 1.0, False, False


class Tree(HTMLParser):
    """A tolerant tree: unclosed, unopened and crossing tags give some tree, never an error."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)

    def _end(self, tags: set[str], within: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                self.at = node.parent
                within = within | ({"table"} if "tr" in tags else set())
                if not tags & {"tr"}:
                    return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and tag in {"html"} | {self.at.tag}:
            return
        if tag in ENDS_P:
            self._end({"p"}, {"table", "td", "th", "button", "object", "article", "div", "section", "main"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # in HTML the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if tag in INLINE and node.tag not in INLINE:
                return  # the end of a format that a block already closed
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def unseen(node: Node) -> bool:
    """Whether an element isn't text of the page at all."""
    a = node.attrs
    return node.tag in DROPPED or bool(a) and ("hidden" in a or a.get("aria-hidden") == "true" or bool(HIDDEN.search(a.get("style", ""))))


def evidence(node: Node, in_article: bool) -> int:
    """2 if a tag, a role or a name says that a block stands around an article, 1 if a name only has a word that would.

    All words of a name must say so, or be neutral.
    """
    a = node.attrs
    if node.tag in AROUND or node.tag == "header" and not in_article or a.get("role") in ROLES:
        return 2
    if node.tag in ("body", "html", "main") or node.tag in HEADINGS:
        return 0
    against, found = NOT_ARTICLE - HEADS if in_article else NOT_ARTICLE, 0
    for token in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = {w.lower() for w in NAME_WORD.findall(token)}
        if words & against:
            found = max(found, 2 if all(w in against or w in NEUTRAL or len(w) < 3 for w in words) else 1)
    return found


def is_thread(node: Node) -> bool:
    """Whether a block is a row of contributions, whatever it is called: at least three children of one shape that hold
    nearly all of its text, none with a heading, each a short line (who, when) before its text."""
    blocks = [c for c in node.children if not isinstance(c, str) and all_chars(c)]
    items = [c for c in blocks if c.tag in THREAD_ITEMS and (c.tag, c.attrs.get("class")) == (blocks[0].tag, blocks[0].attrs.get("class"))] if blocks else []
    if len(items) < 3 or 10 * sum(map(all_chars, items)) < 9 * all_chars(node):
        return False
    for c in items:
        parts = [all_chars(x) for x in c.children if isinstance(x, str) or all_chars(x)]
        parts = [n for n in parts if n]
        if len(parts) < 2 or parts[0] > THREAD_LINE or sum(parts) <= parts[0] * 2:
            return False
        stack = [c]
        while stack:
            x = stack.pop()
            if x.tag in HEADINGS:
                return False
            stack.extend(y for y in x.children if not isinstance(y, str))
    return True


def heavy_blocks(root: Node) -> set[int]:
    """Blocks that hold most of the page's text outside links, and its head or nearly all of that text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if not isinstance(c, str) and c.tag not in DROPPED)
    plain, linked, heads = {}, {}, {}
    for node in reversed(order):
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if not isinstance(c, str) and c.tag not in DROPPED]
        plain[id(node)] = 0 if node.tag == "a" else own + sum(plain[id(c)] for c in below)
        linked[id(node)] = sum(linked[id(c)] for c in below) + (own + sum(plain[id(c)] for c in below) if node.tag == "a" else 0)
        heads[id(node)] = node.tag in ("h1", "article", "main") or any(heads[id(c)] for c in below)
    total = plain[id(root)]
    return {id(n) for n in order if 2 * plain[id(n)] > max(total, 2 * linked[id(n)]) and (heads[id(n)] or 10 * (total - plain[id(n)]) < plain[id(n)])}


def pruned(root: Node) -> list[Node]:
    """Takes out, in place, what isn't text of the page; the nodes left, parents before children."""
    left, stack = [], [root]
    while stack:
        node = stack.pop()
        left.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not unseen(c)]
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return left


def set_weights(nodes: list[Node]) -> None:
    """What the densities of each node count: less in a block that something speaks against, unless it is most of the page."""
    heavy = heavy_blocks(nodes[0])
    inside: set[int] = set()
    for node in nodes:
        up = node.parent
        if up is not None and id(up) in inside or node.tag in ("article", "main"):
            inside.add(id(node))
        found = 0 if node.tag in INLINE or id(node) in heavy else evidence(node, id(node) in inside)
        node.hinted, node.doubted = found > 0, found > 1 or node.tag in THREADS and is_thread(node)
        node.weight = (up.weight if up is not None else 1.0) * (DOUBT if node.doubted else 1.0)


def set_densities(nodes: list[Node]) -> None:
    """Composite text density of each node, and the sum of its children's.

    density = C/T * log(C/LC * T/LT) to the base ln(C/(C-LC) * LC + LCb/Cb * C + e), with C characters, T tags, LC and LT
    those in links, b those of the whole page; a zero divisor counts as one.
    """
    chars, tags, in_links, links = {}, {}, {}, {}
    for node in reversed(nodes):
        c = sum(len("".join(x.split())) if isinstance(x, str) else chars[id(x)] for x in node.children)
        below = [x for x in node.children if not isinstance(x, str)]
        chars[id(node)], tags[id(node)] = c, sum(tags[id(x)] + 1 for x in below)
        in_links[id(node)] = c if node.tag == "a" else sum(in_links[id(x)] for x in below)
        links[id(node)] = sum(links[id(x)] + (x.tag == "a") for x in below)
    body_share = in_links[id(nodes[0])] / max(chars[id(nodes[0])], 1)
    for node in reversed(nodes):
        c, t, lc, lt = (d[id(node)] for d in (chars, tags, in_links, links))
        if c:
            base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)
            ratio = math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / math.log(base) if base > 1 else math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0))
            node.density = c / max(t, 1) * ratio
        node.sum = sum(x.density for x in node.children if not isinstance(x, str))


def chosen(nodes: list[Node]) -> Node:
    """The article's subtree: that of the largest density sum, widened along its path to the body.

    Sums and densities count by weight (``set_weights``), so names and tags move the choice without making it. The subtree
    grows out of elements that only mark up text and of parents of an only child. Then it grows to the highest node on the
    path beside which blocks reach the threshold, the least density on the path, or beside which there are only paragraphs
    and the like, so that a lead and a closing line stay. Beside the path stays what reaches the threshold, and headings and
    other text-level elements that are not mostly links. Blocks within that something speaks against go, unless their
    densities still exceed those of all the article's parts. Of equal sums the first in page order wins.
    """
    weighted = {id(n): sum(c.density * c.weight for c in n.children if not isinstance(c, str)) for n in nodes}
    best = max(nodes, key=lambda n: weighted[id(n)])
    if not weighted[id(best)]:
        return without_doubted(nodes[0], {id(nodes[0])}, 0.0)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density * n.weight for n in path)
    at = best
    while at.parent is not None and at.tag in TEXT_LEVEL:
        at = at.parent
    while at.parent is not None and at.parent.tag not in ("body", "html") and len([c for c in at.parent.children if not isinstance(c, str)]) == 1:
        at = at.parent
    above, least = path[path.index(at) :], LEAST_SHARE * all_chars(best)
    top = 0
    for k in range(1, len(above)):
        beside = [c for c in above[k].children if c is not above[k - 1] and (c.strip() if isinstance(c, str) else all_chars(c))]
        if any(reaches(c, threshold, least) for c in beside) or beside and all(isinstance(c, str) or goes_along(c) for c in beside):
            top = k
    for k in range(1, top + 1):
        above[k].children = [c for c in above[k].children if isinstance(c, str) or c is above[k - 1] or reaches(c, threshold, least) or goes_along(c)]
    if best.tag in ("body", "html"):  # all its blocks stand beside each other
        plain = [c for c in best.children if isinstance(c, str) or not c.hinted or headed(c)]
        best.children = plain if any(not isinstance(c, str) and c.tag not in TEXT_LEVEL and all_chars(c) for c in plain) else best.children
    own = max((c.density * c.weight for c in best.children if not isinstance(c, str) and not c.doubted), default=best.density * best.weight)
    return without_doubted(above[top], {id(n) for n in path}, own)


def headed(node: Node) -> bool:
    return any(not isinstance(c, str) and c.tag in HEADINGS for c in node.children)


def reaches(node: Node | str, threshold: float, least: float) -> bool:
    """Whether a block beside the path is dense enough, and not a mere line."""
    if isinstance(node, str) or node.tag in INLINE or node.density <= 0 or node.density * node.weight < threshold:
        return False
    return not node.doubted and (headed(node) or not node.hinted and (node.tag in TEXT_LEVEL or all_chars(node) >= least))


def goes_along(node: Node) -> bool:
    """Whether an element that only marks up text belongs to the text beside it."""
    return node.tag in TEXT_LEVEL and not node.doubted and 2 * linked_chars(node) <= all_chars(node) and not RIGHTS.match(text_of(node))


def without_doubted(root: Node, path: set[int], reach: float) -> Node:
    """Takes out, in place, blocks that something speaks against and whose densities don't make up for it."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not c.doubted or id(c) in path or c.density * c.weight > reach > 0]
        stack.extend(c for c in node.children if not isinstance(c, str))
    return root


def all_chars(root: Node, links_only: bool = False) -> int:
    n, stack = 0, [(root, not links_only)]
    while stack:
        node, counts = stack.pop()
        if isinstance(node, str):
            n += len("".join(node.split())) if counts else 0
        else:
            stack.extend((c, counts or node.tag == "a") for c in node.children)
    return n


def linked_chars(root: Node) -> int:
    return all_chars(root, links_only=True)


def text_of(root: Node) -> str:
    """Text of a subtree: blocks in page order, white space as one space."""
    parts, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node.tag in INLINE:
            stack.extend(reversed(node.children))
        else:
            stack.extend((" ", *reversed(node.children), " "))
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    """The article of a page; empty if it has none. Null counts as empty."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    nodes = pruned(tree.root)
    set_weights(nodes)
    set_densities(nodes)
    return text_of(chosen(nodes))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: ``<id>, <url>, text, n_chars``. Narrow: no shuffle, one page in memory at a time.

    Null and empty pages give empty texts. Repeated rows give repeated results. Extra columns are not read.
    """
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [read.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return read.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})
