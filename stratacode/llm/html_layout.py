"""Layout-aware text of HTML pages.

A tree builder turns tag soup into properly nested elements: omitted end tags are implied (a paragraph ends before a block, a
list item before the next, cells and rows inside their table), stray end tags are ignored and ``head`` ends where content begins.  A
renderer walks the elements as they open and close and lays out what a reader would see: blocks on lines of their own with blank lines
around paragraphs, headings, lists and tables, list markers with indentation, quoted blocks indented, preformatted text unchanged
and table cells aligned in columns.

Nothing is recursive, so depth is bounded by memory only, and every page is handled by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as st

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style template noscript".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
BLOCKS = ENDS_P | frozenset("html body caption option optgroup legend textarea".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl blockquote pre table figure hr".split())
HIDDEN = RAW | frozenset("head title template datalist select object video audio canvas svg".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset("caption colgroup tbody thead tfoot tr td th".split())
WALLS = frozenset("table td th caption html template".split())  # implied ends do not reach past these

MAX_ALIGN = 60  # a column with wider cells is separated, not padded

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_PART = re.compile(r"[^\"'>]*+([\"'>])")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``("text", content, "")``, ``("open", tag, attributes)`` and ``("close", tag, "")`` in order."""
    at, n, unclosed = 0, len(html), set()
    while at < n:
        m = _OPEN.search(html, at)
        if m is None:
            yield "text", html[at:], ""
            return
        if m.start() > at:
            yield "text", html[at : m.start()], ""
        if m[2] is None:
            mark = "-->" if m[0] == "<!--" else ">"
            end = html.find(mark, m.end())
            at = n if end < 0 else end + len(mark)
            continue
        end = m.end()
        while True:  # the tag ends at the first > outside quotes
            part = _PART.match(html, end)
            if part is None:
                end = n
                break
            end = part.end()
            if part[1] == ">":
                break
            close = -1 if part[1] in unclosed else html.find(part[1], end)
            if close < 0:
                unclosed.add(part[1])
            else:
                end = close + 1
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
            at = end
            continue
        yield "open", tag, html[m.end() : end]
        at = end
        if tag in RAW or tag in ("textarea", "title"):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = close.start() if close else n
            if tag not in RAW:
                yield "text", html[at:stop], ""
            at = stop
            if not close:
                yield "close", tag, ""


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


class Flow:
    """Lines of one text flow: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.prefixes: list[list[str]] = []  # [marker for the next line, indentation]

    def text(self, content: str, keep: bool) -> None:
        if keep:
            first, *rest = content.split("\n")
            self.line += first
            for x in rest:
                self.end(True)
                self.line += x
            return
        content = _SPACE.sub(" ", content)
        if not self.line or self.line.endswith(" "):
            content = content.lstrip(" ")
        self.line += content

    def end(self, force: bool = False) -> None:
        """Finish the line; an empty one only if forced."""
        if self.line.strip() or force:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = ""
            for p in self.prefixes:
                lead += p[0]
                p[0] = p[1]
            self.lines.append((lead + self.line).rstrip())
        self.line = ""

    def space(self) -> None:
        self.end()
        self.gap = True

    def result(self) -> list[str]:
        self.end()
        out: list[str] = []
        for x in self.lines:
            if x or (out and out[-1]):
                out.append(x)
        while out and not out[-1]:
            out.pop()
        return out


class Table:
    """Rows of cells ``(lines, columns, rows)``."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def render(self) -> list[str]:
        taken: dict[tuple[int, int], bool] = {}
        grid: list[dict[int, list[str]]] = []
        widths: dict[int, int] = {}
        for y, row in enumerate(self.rows):
            places: dict[int, list[str]] = {}
            x = 0
            for lines, columns, rows in row:
                while taken.get((y, x)):
                    x += 1
                places[x] = lines
                for dy in range(1, rows):
                    for dx in range(columns):
                        taken[y + dy, x + dx] = True
                widths.setdefault(x, 0)
                if columns == 1:
                    widths[x] = max(widths[x], *(len(line) for line in lines or [""]))
                x += columns
            grid.append(places)
        out = []
        columns = sorted(widths)
        for places in grid:
            for i in range(max((len(lines) for lines in places.values()), default=0)):
                cells = []
                for x in columns:
                    lines = places.get(x, [])
                    cell = lines[i] if i < len(lines) else ""
                    cells.append(cell if widths[x] > MAX_ALIGN else cell.ljust(widths[x]))
                out.append("  ".join(cells).rstrip())
        return out


class Page:
    """Builds the tree and renders it while elements open and close."""

    def __init__(self) -> None:
        self.flow = Flow()
        self.flows: list[Flow] = []
        self.tables: list[Table] = []
        # Open elements: (tag, displayed, visible, payload).
        self.stack: list[tuple[str, bool, bool, object]] = []
        self.kept = 0  # open elements that keep white space

    # -- the tree

    def shown(self) -> bool:
        return all(self.stack[-1][1:3]) if self.stack else True

    def start(self, tag: str, source: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.pop()
        if tag in ENDS_P:
            self.imply({"p"}, WALLS | {"button"})
        if tag == "li":
            self.imply({"li"}, WALLS | LISTS)
        elif tag in ("dd", "dt"):
            self.imply({"dd", "dt"}, WALLS | {"dl"})
        elif tag in ("option", "optgroup"):
            self.imply({"option"}, WALLS | {"select"})
        elif tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.pop()
        elif tag in TABLE_PARTS:
            if not self.tables:
                return
            inner = {"td", "th", "caption"} if tag in ("td", "th") else {"td", "th", "tr", "caption"} if tag == "tr" else TABLE_PARTS
            self.imply(inner, {"table"}, all_of_them=True)
            if tag in ("td", "th") and not any(t == "tr" for t, *_ in self.in_table()):
                self.push("tr", {})
        elif tag in ("html", "body") and any(e[0] == tag for e in self.stack):
            return
        given = attributes(source) if source.strip(" /\n\t>") else {}
        if tag in VOID:
            self.void(tag)
            return
        self.push(tag, given)

    def in_table(self):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "table":
                return self.stack[i + 1 :]
        return []

    def imply(self, tags, walls, all_of_them: bool = False) -> None:
        """Close the innermost open element of ``tags`` (or all), but none beyond a wall."""
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in tags:
                while len(self.stack) > i:
                    self.pop()
                if not all_of_them:
                    return
            elif tag in walls:
                return

    def finish(self, tag: str) -> None:
        if tag == "br":
            self.void("br")
            return
        part = tag in TABLE_PARTS or tag == "table"
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCKS or part or tag in HIDDEN:
                    while len(self.stack) > i:
                        self.pop()
                else:  # inline: elements inside stay open
                    keep = self.stack[i + 1 :]
                    if any(e[0] in BLOCKS or e[0] in TABLE_PARTS for e in keep):
                        return
                    while len(self.stack) > i:
                        self.pop()
                    self.stack.extend(keep)
                return
            if self.stack[i][0] == "table" if part else self.stack[i][0] in ("td", "th", "caption"):
                return
        if tag == "p":  # an end tag alone is an empty paragraph
            self.flow.space()

    # -- the layout

    def void(self, tag: str) -> None:
        if not self.shown():
            return
        if tag == "br":
            self.flow.end(True)
        elif tag == "hr":
            self.flow.space()

    def push(self, tag: str, given: dict[str, str]) -> None:
        parent = self.stack[-1] if self.stack else ("", True, True, None)
        style = given.get("style", "")
        displayed = parent[1] and tag not in HIDDEN and "hidden" not in given and not _NONE.search(style)
        if parent[0] == "details" and parent[3] == "closed" and tag != "summary":
            displayed = False
        visible, found = parent[2], _VISIBILITY.search(style)
        if found:
            visible = found[1].lower() not in ("hidden", "collapse")
        payload: object = None
        if tag == "details" and "open" not in given:
            payload = "closed"
        if displayed:
            if tag == "tr":
                self.tables[-1].rows.append([])
            elif tag in ("td", "th"):
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                payload = (_count(given.get("colspan")), _count(given.get("rowspan")))
                self.flows.append(self.flow)
                self.flow = Flow()
            elif tag in BLOCKS:
                nested = tag in LISTS and any(e[0] in LISTS for e in self.stack)
                self.flow.space() if tag in SPACED and not nested else self.flow.end()
                if tag == "ol":
                    payload = [_count(given.get("start"), 1) - 1]
                elif tag == "li":
                    marker = "- "
                    for e in reversed(self.stack):
                        if e[0] in LISTS:
                            if isinstance(e[3], list):
                                e[3][0] += 1
                                marker = f"{e[3][0]}. "
                            break
                    self.flow.prefixes.append([marker, " " * len(marker)])
                elif tag in ("blockquote", "dd"):
                    self.flow.prefixes.append(["  ", "  "])
        if tag == "table":
            self.tables.append(Table())
        if tag in ("pre", "textarea"):
            self.kept += 1
        self.stack.append((tag, displayed, visible, payload))

    def pop(self) -> None:
        tag, displayed, _, payload = self.stack.pop()
        if tag in ("pre", "textarea"):
            self.kept -= 1
        table = self.tables.pop() if tag == "table" else None
        if not displayed:
            return
        if tag in ("td", "th"):
            cell, self.flow = self.flow.result(), self.flows.pop()
            self.tables[-1].rows[-1].append((cell, *payload))
        elif table is not None:
            self.flow.space()
            for line in table.render():
                self.flow.line = line
                self.flow.end(True)
            self.flow.gap = True
        elif tag in BLOCKS:
            nested = tag in LISTS and any(e[0] in LISTS for e in self.stack)
            self.flow.space() if tag in SPACED and not nested else self.flow.end()
            if tag in ("li", "blockquote", "dd"):
                self.flow.prefixes.pop()

    def text(self, content: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and content.strip():
            self.pop()
        if not self.shown() or (self.stack and self.stack[-1][3] == "closed"):
            return
        self.flow.text(unescape(content), self.kept > 0)

    def result(self) -> str:
        while self.stack:
            self.pop()
        return "\n".join(self.flow.result())


def _count(value: str | None, default: int = 1) -> int:
    m = re.match(r"\s*(\d{1,4})", value or "")
    return max(1, min(1000, int(m[1]))) if m else default


def render(html: str | None) -> str:
    """Visible text of a page; empty for a null or empty page."""
    page = Page()
    for kind, value, source in tokens(html or ""):
        if kind == "text":
            page.text(value)
        elif kind == "open":
            page.start(value, source)
        else:
            page.finish(value)
    return page.result()


def extract_text(pages: DataFrame, html_col: str = "html", result_col: str = "text") -> DataFrame:
    """All columns of ``pages`` and the visible text of each page as ``result_col`` (never null).

    Null and empty pages give an empty text; rows are independent, so repeated pages give repeated texts and an empty table
    none; an input column of the name ``result_col`` is replaced.
    """
    kept = [c for c in pages.columns if c.lower() != result_col.lower() or c == html_col]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(html_col)
    if result_col == html_col:
        raise ValueError("the result needs a column of its own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, result_col])

    return rows.mapInArrow(run, st.StructType([*rows.schema.fields, st.StructField(result_col, st.StringType(), False)]))
