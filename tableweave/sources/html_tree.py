"""A small tolerant tree of HTML, as helper of the readers in this package."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template", "noscript"}
CLOSED_BY = {"li": {"li"}, "p": {"p", "div", "table", "ul", "ol", "section", "h1", "h2", "h3", "h4"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
# Tags as most pages write them; the parser itself reads all others, and those whose content isn't markup.
_ATTRIBUTE = r"\s+([a-z][a-z-]*)=(?:\"([^\"<>&]*)\"|([a-z0-9]+)(?=[\s>]|$))"
PLAIN_START = re.compile(rf"<([a-z][a-z0-9]*)((?:{_ATTRIBUTE})*)>")
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
ATTRIBUTE = re.compile(_ATTRIBUTE)
# A page of such tags and text is read without the parser.
PLAIN = re.compile(rf"<([a-z][a-z0-9]*)((?:{_ATTRIBUTE})*)>|</([a-z][a-z0-9]*)>|([^<]+)")
OWN_CONTENT = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """This node and all below, in page order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def all(self, *tags: str) -> list[Node]:
        found, stack = [], self.children[::-1]
        while stack:
            node = stack.pop()
            if node.__class__ is Node:
                if node.tag in tags:
                    found.append(node)
                stack += node.children[::-1]
        return found

    def strings(self, skip: set[str] = HIDDEN) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in skip:
                stack.extend(reversed(node.children))

    def text(self, joint: str = "", skip: set[str] = HIDDEN) -> str:
        return joint.join(s.strip() for s in self.strings(skip) if s.strip())

    def names(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def parse_starttag(self, i: int) -> int:
        found = None if self.cdata_elem else PLAIN_START.match(self.rawdata, i)
        if not found or found[1] in OWN_CONTENT:
            return super().parse_starttag(i)
        self.handle_starttag(found[1], [(k, a or b) for k, a, b in ATTRIBUTE.findall(found[2])] if found[2] else [])
        return found.end()

    def parse_endtag(self, i: int) -> int:
        found = None if self.cdata_elem else PLAIN_END.match(self.rawdata, i)
        if not found or found[1] in OWN_CONTENT:
            return super().parse_endtag(i)
        self.handle_endtag(found[1])
        return found.end()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.at = self.at.parent or self.root
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def _plain_tree(html: str) -> Node | None:
    """What the parser makes of a page that has nothing but plain tags and text; null for any other page."""
    root = at = Node("", {}, None)
    end = 0
    for m in PLAIN.finditer(html):
        if m.start() != end:
            return None
        end = m.end()
        tag, attributes, _, _, _, closed, data = m.groups()
        if data is not None:
            at.children.append(unescape(data) if "&" in data else data)
        elif closed is not None:
            if closed in OWN_CONTENT:
                return None
            node = at
            while node.parent is not None and node.tag != closed:
                node = node.parent
            at = node.parent or at
        else:
            if tag in OWN_CONTENT:
                return None
            while at.tag in CLOSED_BY and tag in CLOSED_BY[at.tag]:
                at = at.parent or root
            node = Node(tag, {k: a or b for k, a, b in ATTRIBUTE.findall(attributes)} if attributes else {}, at)
            at.children.append(node)
            if tag not in VOID:
                at = node
    return root if end == len(html) else None


def tree_of(html: str | None) -> Node:
    if (plain := _plain_tree(html or "")) is not None:
        return plain
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
