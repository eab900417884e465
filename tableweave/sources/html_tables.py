"""Pages to tables, titles, abstracts, sections and texts. One narrow pass: a page is parsed once, in the task that reads it."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote_plus

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableweave.functions.scalars import joined_sections, plain_spaces, without_references
from tableweave.sources.html_tree import HIDDEN, Node, tree_of

TABLE = "struct<caption: string, footnote: string, headers: array<string>, rows: array<array<string>>>"
PAGE = {"title": "string", "abstract": "string", "sections": "array<struct<section: string, content: string>>", "tables": f"array<{TABLE}>", "full_text": "string"}
_ROWS = pa.list_(pa.list_(pa.string()))
_ARROW = {
    "title": pa.string(), "abstract": pa.string(), "sections": pa.list_(pa.struct([("section", pa.string()), ("content", pa.string())])),
    "tables": pa.list_(pa.struct([("caption", pa.string()), ("footnote", pa.string()), ("headers", pa.list_(pa.string())), ("rows", _ROWS)])), "full_text": pa.string(),
}
#: Pages whose results a worker holds at once.
PAGES_AT_ONCE = 256
FOOT_NAMES, CAPTION_NAMES = ("footnote", "foot", "note"), ("caption", "title")
LEVELS = 3


def grid_of(table: Node) -> tuple[list[list[str]], int]:
    """The texts of a table's cells, spans expanded, and how many of the first lines are headers (at least one).

    Superscripts are left out and parts of a cell joined without blanks. A cell that spans rows is repeated where the next
    lines begin and where they end short, so one in the middle of a line shifts what follows. A line without cells counts
    as a header.
    """
    grid, heads, spanning = [], [], {}
    for line in (r for r in table.all("tr") if _owner(r) is table):
        out: list[str] = []

        def take_open(out: list[str] = out) -> bool:
            if (k := len(out)) not in spanning:
                return False
            text, left = spanning[k]
            out.append(text)
            if left > 1:
                spanning[k] = (text, left - 1)
            else:
                del spanning[k]
            return True

        while take_open():
            pass
        cells = [c for c in line.children if isinstance(c, Node) and c.tag in ("td", "th")]
        for cell in cells:
            text, wide, high = cell.text("", HIDDEN | {"sup"}), _span(cell, "colspan"), _span(cell, "rowspan")
            for k in range(len(out), len(out) + wide):
                if high > 1:
                    spanning[k] = (text, high - 1)
            out.extend([text] * wide)
        grid.append(out)
        heads.append(all(c.tag == "th" for c in cells))
    width = max(map(len, grid), default=0)
    for out in grid:
        while len(out) < width:
            out.append(spanning[len(out)][0] if len(out) in spanning else "")
    n = next((k for k, h in enumerate(heads) if not h), len(heads))
    return grid, max(1, n)


def _owner(node: Node) -> Node | None:
    node = node.parent
    while node is not None and node.tag != "table":
        node = node.parent
    return node


def _span(cell: Node, name: str) -> int:
    if name not in cell.attrs:
        return 1
    value = cell.attrs[name].strip()
    return max(1, int(value)) if value.isdigit() else 1  # a percentage isn't a span


def table_of(node: Node) -> tuple[list[str], list[list[str]]]:
    """Headers (several lines: distinct parts joined by dots) and data lines."""
    grid, n = grid_of(node)
    if not grid:
        return [], []
    headers = []
    for column in zip(*grid[:n], strict=True):
        parts = [c for c in column if c]
        headers.append(column[0] if len(set(column)) == 1 else ".".join(parts))
    return headers, grid[n:]


def _near(table: Node, names: tuple[str, ...], tags: tuple[str, ...]) -> str:
    """The text of the nearest element around a table that has one of the tags, or one of the words in its class or id."""
    for own in table.all("caption"):
        if "caption" in tags:
            return own.text(" ")
    at: Node | None = table.parent
    for _ in range(LEVELS):
        if at is None or not at.tag:
            break
        for node in at.walk():
            inside = node
            while inside is not None and inside is not table:
                inside = inside.parent
            if inside is None and node is not at and (node.tag in tags or any(n in node.names() for n in names)):
                return node.text(" ")
        at = at.parent
    return ""


def tables_of(root: Node) -> list[dict[str, Any]]:
    """Tables with caption and footnote; a table equal to the one just before it is left out. Tables of tables don't count."""
    out: list[dict[str, Any]] = []
    for node in root.all("table"):
        if node.all("table"):
            continue
        headers, rows = table_of(node)
        found = {"caption": _near(node, CAPTION_NAMES, ("caption", "figcaption", "h2", "h3")), "footnote": _near(node, FOOT_NAMES, ()), "headers": headers, "rows": rows}
        if headers and not (out and out[-1]["headers"] == headers and out[-1]["rows"] == rows):
            out.append(found)
    return out


def script_tables(html: str, variable: str = r"[\w.]+") -> list[dict[str, Any]]:
    """Tables held as HTML in JSON that a script assigns: ``name = {...};`` with ``tables: [{title, content, footnote}]``."""
    out = []
    for m in re.finditer(rf"{variable}\s*=\s*(\{{.*?\}})\s*;", html or "", re.S):
        try:
            data = json.loads(m[1])
        except ValueError:
            continue
        for x in data.get("tables", []) if isinstance(data, dict) else []:
            for found in tables_of(tree_of(x.get("content", ""))):
                out.append(found | {"caption": x.get("title") or found["caption"], "footnote": x.get("footnote") or found["footnote"]})
    return out


def archive_tables(root: Node) -> list[dict[str, Any]]:
    """Tables as the public archive of full texts wraps them: caption, table and footnote in boxes of their own."""
    out: list[dict[str, Any]] = []
    box = lambda wrap, name: next((n for n in wrap.walk() if n.tag == "div" and name in n.attrs.get("class", "").split()), None)
    text = lambda node: "".join(node.strings(set())) if node else ""
    for wrap in root.all("div"):
        if not {"table-wrap", "anchored", "whole_rhythm"} <= set(wrap.attrs.get("class", "").split()):
            continue
        inner = box(wrap, "xtable")
        tables = inner.all("table") if inner else []
        headers, rows = table_of(tables[0]) if tables else ([], [])
        found = {"caption": text(box(wrap, "caption")), "footnote": text(box(wrap, "tblwrap-foot")), "headers": headers, "rows": rows}
        if not (out and out[-1]["headers"] == headers and out[-1]["rows"] == rows):
            out.append(found)
    return out


def archive_title(root: Node) -> str:
    """The first h1 in a group of headings that says something."""
    return next((t for g in root.all("hgroup") for h in g.all("h1") if (t := h.text(" ").strip())), "")


def archive_abstract(root: Node) -> str:
    """The paragraphs of the section that the first heading with the word abstract stands in."""
    head = next((n for n in root.walk() if n.tag in ("h2", "h3") and "abstract" in n.text("").lower()), None)
    while head is not None and head.tag != "section":
        head = head.parent
    return "\n".join(p.text(" ") for p in head.all("p")).strip() if head else ""


def tables_by(root: Node, html: str, readers: tuple[str, ...] = ("archive", "page", "script")) -> list[dict[str, Any]]:
    """Tables by the first of the readers that finds any."""
    known = {"archive": lambda: archive_tables(root), "page": lambda: tables_of(root), "script": lambda: script_tables(html)}
    return next((found for r in readers if (found := known[r]())), [])


def single_table(html: str | None) -> str | None:
    """The first table of a page as Markdown: header lines stacked, empty lines and columns out, headers filled and told apart."""
    tables = tree_of(html).all("table")
    if not tables:
        return None
    headers, rows = table_of(tables[0])
    rows = [r for r in rows if any(c.strip() for c in r)]
    keep = [k for k in range(len(headers)) if headers[k].strip() or any(r[k].strip() for r in rows)]
    blank = iter(range(len(keep)))
    names = [headers[k] if headers[k].strip() else f"Unnamed_{next(blank)}" for k in keep]
    told = [f"{n}_{names[:k].count(n)}" if names.count(n) > 1 else n for k, n in enumerate(names)]
    return markdown_of(told, [[r[k] for k in keep] for r in rows])


def single_tables(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """``keys, markdown`` of each page's first table (``single_table``), null where there is none. Narrow."""
    return _each_page(pages, keys, plain_spaces(F.col(html_col)), lambda h: {"markdown": single_table(h)}, {"markdown": ("string", pa.string())})


def title_of(root: Node) -> str:
    """The first h1 that is called a title by itself, by up to four elements around it or two below; else the first h1."""
    heads = root.all("h1")
    for h in heads:
        around, at = [h], h.parent
        for _ in range(4):
            if at is not None:
                around.append(at)
                at = at.parent
        below = [c for c in h.children if isinstance(c, Node)]
        below += [c for b in below for c in b.children if isinstance(c, Node)]
        if any("title" in n.names() for n in around + below):
            return h.text(" ")
    return heads[0].text(" ") if heads else ""


def sections_of(root: Node) -> list[dict[str, str]]:
    """Headings and the distinct lines of text until the next one, from the abstract (or the first heading) to the references."""
    out: list[dict[str, Any]] = []
    stop = False
    for node in root.walk():
        if node.tag in ("h2", "h3"):
            name = node.text(" ")
            stop = bool(re.match(r"(references|bibliography|acknowledg)", name.lower()))
            if stop:
                break
            out.append({"section": name, "lines": {}})
        elif node.tag in ("p", "li") and out and not _owner(node):
            if line := node.text(" "):
                out[-1]["lines"].setdefault(line)
        elif node.tag == "table" and out and not node.all("table"):
            out[-1]["lines"].setdefault(markdown_of(*table_of(node)))
    first = next((k for k, s in enumerate(out) if "abstract" in s["section"].lower()), 0)
    return [{"section": s["section"], "content": "\n".join(s["lines"])} for s in out[first:]]


def abstract_of(root: Node, sections: list[dict[str, str]]) -> str:
    for s in sections:
        if "abstract" in s["section"].lower():
            return s["content"]
    return sections[0]["content"] + "......" if sections else ""


def markdown_of(headers: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)]) if headers else ""


def text_of(html: str | None, tables: bool = True) -> str:
    return tree_of(html).text("\n", HIDDEN if tables else HIDDEN | {"table"})


def page_of(html: str | None, parts: tuple[str, ...] = tuple(PAGE)) -> dict[str, Any]:
    """The named parts of a page; nothing is looked for that isn't among them."""
    root = tree_of(html)
    found: dict[str, Any] = {}
    if "sections" in parts:
        found["sections"] = sections_of(root)
    if "title" in parts:
        found["title"] = archive_title(root) or title_of(root)
    if "abstract" in parts:
        found["abstract"] = archive_abstract(root) or abstract_of(root, found["sections"] if "sections" in found else sections_of(root))
    if "tables" in parts:
        found["tables"] = tables_by(root, html or "")
    if "full_text" in parts:
        found["full_text"] = root.text("\n")
    return {k: found[k] for k in parts}


def decoded_url(text: str | None) -> str | None:
    """Character references decoded once, then percent signs and pluses until nothing changes."""
    if text is None:
        return None
    text = entities.unescape(text)
    while (plain := unquote_plus(text)) != text:
        text = plain
    return text


def _each_page(pages: DataFrame, keys: list[str], html: Column, read: Callable[[str | None], dict[str, Any]], kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """``keys`` and what ``read`` gives for each page. Narrow: results leave the worker a few pages at a time."""
    schema = ", ".join([f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys] + [f"{k} {kind}" for k, (kind, _) in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(at, PAGES_AT_ONCE)
                found = [read(h.as_py()) for h in some.column(len(keys))]
                own = [pa.array([x[k] for x in found], kind) for k, (_, kind) in kinds.items()]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keys)], *own], names=[*keys, *kinds])

    return pages.select(*keys, html.alias("__html")).mapInArrow(run, schema)


def parse_pages(pages: DataFrame, keys: list[str], html_col: str = "html", parts: tuple[str, ...] = tuple(PAGE)) -> DataFrame:
    """``keys`` and the named parts (``title, abstract, sections, tables, full_text``) of each page; a null page has none of them."""
    return _each_page(pages, keys, plain_spaces(F.col(html_col)), lambda h: page_of(h, parts), {k: (PAGE[k], _ARROW[k]) for k in parts})


def page_tables(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, table_id, caption, footnote, headers, rows`` of each table of parsed pages."""
    return parsed.select(*keys, F.posexplode("tables").alias("table_id", "t")).select(*keys, "table_id", "t.*")


def texts_of_sections(articles: DataFrame, keys: list[str], sections: str = "sections") -> DataFrame:
    """``keys, text``: an article's ``array<struct<section, content>>`` as plain text, without tables and without what stands
    behind the last mention of references."""
    kinds = ", ".join(f"`{k}` {articles.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x[keys].assign(text=[text_of(t, tables=False) for t in x["__text"]])

    told = articles.select(*keys, F.coalesce(joined_sections(F.col(sections)), F.lit("")).alias("__text")).mapInPandas(run, f"{kinds}, text string")
    return told.select(*keys, without_references(F.col("text")).alias("text"))


SPANS = "table_id int, row_idx int, nth int, wide int, high int, head boolean, text string"


def written_cells(html: str | None) -> Iterator[tuple[int, int, int, int, int, bool, str]]:
    """The cells of a page's tables as they are written, with what they span; tables of tables are left out."""
    tables = [t for t in tree_of(html).all("table") if not t.all("table")]
    for n, table in enumerate(tables):
        for r, line in enumerate(table.all("tr")):
            cells = [c for c in line.children if isinstance(c, Node) and c.tag in ("td", "th")]
            for k, c in enumerate(cells):
                text = c.children[0] if len(c.children) == 1 and isinstance(c.children[0], str) else c.text(" ")
                yield n, r, k, _span(c, "colspan"), _span(c, "rowspan"), c.tag == "th", " ".join(text.split())
            if not cells:
                yield n, r, -1, 0, 1, False, ""


_SPAN_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]


def span_cells(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """``keys, table_id, row_idx, nth, wide, high, head, text`` of every table cell of pages; ``operators.spans`` does the rest."""
    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(c.split()[0] for c in SPANS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(at, PAGES_AT_ONCE)
                found = [list(written_cells(h.as_py())) for h in some.column(len(keys))]
                page = pa.array([n for n, x in enumerate(found) for _ in x], pa.int32())
                cells = list(zip(*(c for x in found for c in x), strict=True)) or [()] * len(_SPAN_TYPES)
                own = [pa.array(c, kind) for c, kind in zip(cells, _SPAN_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(page) for c in some.columns[: len(keys)]), *own], names=names)

    return pages.select(*keys, plain_spaces(F.col(html_col)).alias("__html")).mapInArrow(run, f"{kinds}, {SPANS}")


def titles_and_texts(pages: DataFrame, keys: list[str], html_col: str = "html", terminated: bool = False) -> DataFrame:
    """``keys, title, full_text`` alone, for callers that need no tables. Browsers decode some references without a semicolon
    (``&amp`` before a tag) too; ``terminated`` leaves them as written and decodes those with one alone."""
    html = F.regexp_replace(html_col, "&(?!#?[0-9A-Za-z]+;)", "&amp;") if terminated else F.col(html_col)
    return parse_pages(pages.select(*keys, html.alias("html")), keys, "html", ("title", "full_text"))
