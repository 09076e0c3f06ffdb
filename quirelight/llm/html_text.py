"""Visible text of HTML pages by layout-aware rendering.

A tokenizer and a tree builder with implied tags (an open p ends at a block, li at li, cells and rows at the next ones, void
elements have no content) drive a renderer that writes lines as elements open and close. Nothing recurses, and every step is paid for by
bytes read or elements closed, so time is linear in the page. Inline text collapses white space, pre keeps it. Blocks stand on lines of their own;
paragraphs, headings, lists, tables, pre and quotations are set apart by a blank line. List items get "- " or their number and
are indented by their level, up to INDENT columns; table cells are aligned in columns. Not visible: comments, head, title, script, style, template,
noscript and the like, elements with the hidden attribute or an inline style of display none or visibility hidden, inputs of type hidden,
annotations of formulas, and of svg all but its text. Images give their alt text.

Bounds that keep all text: lines of a cell longer than WIDE do not widen the others; a row that alignment would blow up is written cell below cell;
tables inside DEEP others are written as plain blocks.

Defined results: null html gives empty text. Broken markup is text or is closed at the end, never an error; a tag that is cut off by the next < is
text. Rows without page_id are rendered too; repeated rows each give a row. Other columns are not passed on.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import stage

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
BODY = re.compile(r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+")
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist annotation annotation-xml".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset("td th".split())
SHOWN_INPUTS = frozenset("submit button reset text search email".split())
#: Tags that end the tags beside them when they open, up to a boundary.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
}
#: An end tag reaches no further than these.
WALLS = ("table", "td", "th", "caption", "body", "html")
INDENT, WIDE, DEEP, SPAN = 40, 60, 8, 100


class Mark:
    """A list item's mark, until its first line is written."""

    __slots__ = ("text", "pad", "done")

    def __init__(self, text: str, pad: str):
        self.text, self.pad, self.done = text, pad, False


class Sink:
    """Lines under construction: of the page, or of one table cell."""

    __slots__ = ("lines", "run", "gap", "pad", "marks")

    def __init__(self) -> None:
        self.lines: list[str] = []
        #: Inline text of the current block; \1 breaks the line, \0 begins a line whose white space stays.
        self.run: list[str] = []
        self.gap = False
        self.pad = ""
        self.marks: list[Mark] = []

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        pad = self.pad
        if self.marks:
            parts, at = [], 0
            for m in self.marks:
                parts += [" " * (len(m.pad) - at), m.text]
                at = max(at, len(m.pad)) + len(m.text)
                m.done = True
            lead = "".join(parts) + " " * (len(pad) - at)
            self.marks.clear()
            self.lines.append((lead + lines[0]).rstrip(" ") if not lines[0] else lead + lines[0])
            lines = lines[1:]
        if pad:
            self.lines.extend(pad + x if x else x for x in lines)
        else:
            self.lines.extend(lines)

    def flush(self) -> None:
        if self.run:
            text = "".join(self.run)
            self.run.clear()
            got = [x.replace("\0", "") if "\0" in x else SPACE.sub(" ", x).strip(" ") for x in text.split("\1")]
            if not got[-1]:
                got.pop()
            if any(got):
                self.put(got)

    def space(self) -> None:
        if self.lines and not self.marks:
            self.gap = True


class Element:
    __slots__ = ("tag", "seen", "mute", "pre", "svg", "block", "number", "mark", "pad", "rows", "span", "nested")

    def __init__(self, tag: str, up: Element | None, attrs: dict[str, str]):
        self.tag = tag
        style = attrs["style"].lower().replace(" ", "") if "style" in attrs else ""
        self.seen = (up is None or up.seen) and tag not in UNSEEN and "hidden" not in attrs and "display:none" not in style and "visibility:hidden" not in style
        self.svg = tag == "svg" or (up is not None and up.svg and tag != "foreignobject")
        self.mute = self.svg and tag != "text" and (tag == "svg" or up.mute)
        self.pre = tag in ("pre", "textarea", "xmp") or (up is not None and up.pre)
        self.block = tag in BLOCKS
        self.number = int(attrs["start"]) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", attrs.get("start", "")) else 1
        self.mark: Mark | None = None
        self.pad: str | None = None
        #: Of a table laid out as a grid: its rows of cells (lines, columns, rows).
        self.rows: list | None = None
        self.span = tuple(min(SPAN, int(v)) if (v := attrs.get(a, "")).isdecimal() and v.isascii() and len(v) < 6 and int(v) > 0 else 1 for a in ("colspan", "rowspan")) if tag in CELLS else (1, 1)
        self.nested = False


NOTHING: list[str] = []


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows) with cells aligned in columns, separated by " | "."""
    grid: list[list[list[str]]] = []
    below: dict[int, int] = {}
    for row in rows:
        line: list[list[str]] = []
        cells = iter(row)
        more: dict[int, int] = {}
        while True:
            if below.get(len(line), 0):
                below[len(line)] -= 1
                line.append(NOTHING)
                continue
            cell = next(cells, None)
            if cell is None:
                break
            text, wide, high = cell
            for k in range(wide):
                if high > 1:
                    more[len(line)] = high - 1
                line.append(text if k == 0 else NOTHING)
        below.update(more)
        grid.append(line)
    width = [0] * max([0, *map(len, grid)])
    for line in grid:
        for k, cell in enumerate(line):
            if cell:
                width[k] = max(width[k], max((n for n in map(len, cell) if n <= WIDE), default=0))
    out: list[str] = []
    for line in grid:
        # below the other cells' lines, only the tallest cell has text
        tall = max(range(len(line)), key=lambda k: len(line[k]), default=0)
        low = max([0, *(len(cell) for k, cell in enumerate(line) if k != tall)])
        high = len(line[tall]) if line else 0
        own = sum(sum(map(len, cell)) + len(cell) for cell in line if cell)
        if high * (sum(width[: len(line)]) + 3 * len(line)) > 4096 + 16 * own:
            for cell in line:
                out.extend(cell)
        elif len(line) == 1:
            out.extend(line[0])
        else:
            for i in range(low):
                out.append(" | ".join((cell[i] if i < len(cell) else "").ljust(width[k]) for k, cell in enumerate(line)).rstrip())
            before = "".join(" " * w + " | " for w in width[:tall])
            after = "".join(" | " + " " * w for w in width[tall + 1 : len(line)]).rstrip()
            if after:
                out.extend([before + x.ljust(width[tall]) + after for x in line[tall][low:]])
            else:
                out.extend([(before + x).rstrip() for x in line[tall][low:]])
    return out


class _Page:
    """The stack of open elements and where its tags are, and the sinks that their text goes to."""

    def __init__(self) -> None:
        self.stack = [Element("", None, {})]
        self.at: dict[str, list[int]] = {}
        self.sinks = [Sink()]
        self.tables: list[Element] = []

    def last(self, tags: tuple[str, ...]) -> int:
        """The highest place of an open element with one of the tags, or 0."""
        return max((p[-1] if (p := self.at.get(t)) else 0 for t in tags), default=0)

    def open(self, tag: str, attrs: dict[str, str]) -> Element:
        up = self.stack[-1]
        e = Element(tag, up, attrs)
        self.stack.append(e)
        self.at.setdefault(tag, []).append(len(self.stack) - 1)
        if not e.seen or not (e.block or tag == "text"):
            return e
        sink = self.sinks[-1]
        sink.flush()
        if tag in SPACED:
            e.nested = tag in LISTS and up.tag == "li"
            if not e.nested:
                sink.space()
        if tag == "table":
            if len(self.tables) < DEEP:
                e.rows = []
                self.tables.append(e)
        elif tag == "tr" and self.tables and self._own_table():
            self.tables[-1].rows.append([])
        elif tag in CELLS and self.tables and self._own_table():
            e.rows = self.tables[-1].rows
            self.sinks.append(Sink())
        elif tag == "li":
            e.pad = sink.pad
            e.mark = Mark(f"{up.number}. " if up.tag == "ol" else "- ", sink.pad)
            sink.marks.append(e.mark)
            sink.pad = " " * min(INDENT, len(sink.pad) + len(e.mark.text))
        elif tag in ("dd", "blockquote"):
            e.pad = sink.pad
            sink.pad = " " * min(INDENT, len(sink.pad) + 2)
        return e

    def _own_table(self) -> bool:
        """Whether the innermost open table is one laid out as a grid."""
        return self.stack[self.at["table"][-1]] is self.tables[-1] if self.at.get("table") else False

    def close(self) -> None:
        e = self.stack.pop()
        self.at[e.tag].pop()
        tag = e.tag
        if not e.seen or not (e.block or tag == "text"):
            return
        sink = self.sinks[-1]
        sink.flush()
        if tag == "table":
            if e.rows is not None:
                self.tables.pop()
                lines = table_lines(e.rows)
                if any(lines):
                    sink.put(lines)
        elif tag in CELLS and e.rows is not None:
            self.sinks.pop()
            if not e.rows:
                e.rows.append([])
            e.rows[-1].append((sink.lines, *e.span))
            return
        elif tag == "li":
            sink.pad = e.pad
            if e.mark.done:
                sink.gap = False
                if self.stack[-1].tag == "ol":
                    self.stack[-1].number += 1
            else:
                sink.marks.pop()
        elif tag in ("dd", "blockquote"):
            sink.pad = e.pad
        if tag in SPACED and not e.nested:
            sink.space()

    def close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.close()

    def leave(self, tags: tuple[str, ...], walls: tuple[str, ...]) -> None:
        """Close the elements with one of the tags that are not behind a wall; several may be open, as tr around td."""
        while (k := self.last(tags)) > self.last(walls):
            self.close_to(k)

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if text and top.seen and not top.mute:
            text = html.unescape(text).replace("\0", "").replace("\1", "") if "&" in text else text
            self.sinks[-1].run.append("\1".join("\0" + line for line in text.split("\n")) if top.pre else text)


def visible_text(page: str) -> str:
    """The visible text of one page."""
    page = page.replace("\0", "").replace("\1", "").replace("\r\n", "\n").replace("\r", "\n")
    p = _Page()
    done = at = 0  # text before done is written; markup is looked for from at
    final = page.rfind(">")
    while True:
        start = page.find("<", at)
        comment = start >= 0 and page.startswith("<!--", start)
        if start < 0 or (start > final and not comment):
            break
        m = None if comment else NAME.match(page, start)
        if m is None:
            if comment:
                stop = page.find("-->", start + 4)
                stop = len(page) if stop < 0 else stop + 3
            elif page[start + 1 : start + 2] in ("!", "?"):
                stop = page.find(">", start) + 1
            else:
                at = start + 1
                continue
            p.text(page[done:start])
            done = at = stop
            continue
        stop = BODY.match(page, m.end()).end()
        if page[stop : stop + 1] != ">":
            at = start + 1
            continue
        p.text(page[done:start])
        done = at = stop + 1
        tag = m[1].lower()
        if page[start + 1] == "/":
            if tag == "br":
                p.sinks[-1].run.append("\1")
            elif tag in WALLS or tag in ("tr", "tbody", "thead", "tfoot"):
                if (k := p.last((tag,))) and (tag in ("body", "html") or tag == "table" or k > p.last(("table",))):
                    p.close_to(k)
            elif (k := p.last((tag,))) > p.last(WALLS):
                p.close_to(k)
            continue
        attrs: dict[str, str] = {}
        if stop > m.end():
            for a in ATTR.finditer(page, m.end(), stop):
                attrs.setdefault(a[1].lower(), html.unescape(a[2].strip("\"'")) if a[2] else "")
        if tag in BLOCKS and p.at.get("p"):
            p.leave(("p",), WALLS)
        if tag in ENDS:
            p.leave(*ENDS[tag])
        if tag == "body":
            p.leave(("head",), ())
        if tag not in VOID:
            e = p.open(tag, attrs)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if e.seen:
                    p.text(page[at : end.start() if end else len(page)])
                done = at = end.end() if end else len(page)
                p.close()
            continue
        top = p.stack[-1]
        if not Element(tag, top, attrs).seen or top.mute:
            continue
        sink = p.sinks[-1]
        if tag == "br":
            sink.run.append("\1")
        elif tag == "hr":
            sink.flush()
            sink.space()
            sink.put(["---"])
            sink.space()
        elif tag == "img" and attrs.get("alt"):
            sink.run.append(attrs["alt"].replace("\0", "").replace("\1", ""))
        elif tag == "input" and attrs.get("type", "").lower() in SHOWN_INPUTS and attrs.get("value"):
            sink.run.append(attrs["value"].replace("\0", "").replace("\1", ""))
    p.text(page[done:])
    p.close_to(1)
    p.sinks[0].flush()
    return "\n".join(p.sinks[0].lines).strip("\n")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text of pages (page_id, html)."""
    stage.ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([visible_text(x) if x else "" for x in b.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")
