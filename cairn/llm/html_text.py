"""Text of HTML pages as it is laid out.

A tree builder with implied tags (an open ``p`` ends before a block, ``li``,
``dt``, ``td``, ``tr`` and ``option`` before their like, void elements have no
content) feeds a renderer with rules of visibility and of block spacing:

* nothing inside head, script, style, template, noscript, definitions of svg or
  math, or an element with the attribute ``hidden`` or a style of
  ``display:none`` is shown; text below ``visibility:hidden`` is not shown
  unless a nearer element is ``visibility:visible``;
* white space is collapsed except in ``pre`` and ``textarea``; blocks start on
  a new line, paragraphs and headings with an empty line between;
* list items are indented by depth with ``-`` or their number; table cells of
  one table are padded to the widest of their column and joined by two spaces;
  a cell over several columns or rows takes its place in the grid and stands in
  the first of them, and columns in which no cell begins take no room.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Workspace

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\s*(?:!important\s*)?(?=;|$)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript iframe object canvas audio video datalist title".split())
#: Not shown inside svg or math.
FOREIGN_SILENT = frozenset("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split())
#: Their content is no markup up to the end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = PARAGRAPH | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav option optgroup search section select summary caption tbody thead tfoot tr".split())
#: A start tag ends these open elements, up to a boundary.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
_CLOSES_P = PARAGRAPH | frozenset("address article aside center details dialog dir div fieldset figcaption footer form header hgroup main menu nav search section summary li dt dd".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s) if not s.isascii() else len(s)


class _Flow:
    """Lines of one block context; cells of tables have flows of their own."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # line breaks owed before the next text
        self.blank = False  # a space is owed
        self.indent = 0
        self.mark = ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self._end()
                if part:
                    self._open()
                    self.line.append(part)
            return
        words = _SPACE.sub(" ", s)
        if not words or words == " ":
            self.blank = self.blank or bool(words and self.line)
            return
        self._open()
        if (words[0] == " " or self.blank) and self.line and not self.line[-1].endswith(" "):
            self.line.append(" ")
        self.blank = words[-1] == " "
        self.line.append(words.strip(" "))

    def _open(self) -> None:
        if self.gap:
            if self.line:
                self._end()
            while self.lines and self.gap > 1 and self.lines[-1] != "":
                self.lines.append("")
            self.gap, self.blank = 0, False
        if not self.line:
            self.line.append(" " * (self.indent - len(self.mark)) + self.mark)
            self.mark = ""
            self.blank = False
            if not self.line[0]:
                self.line.pop()

    def _end(self) -> None:
        self.lines.append("".join(self.line).rstrip(" "))
        self.line, self.blank = [], False

    def block(self, lines: int) -> None:
        self.gap = max(self.gap, lines)

    def br(self) -> None:
        if self.gap and self.line:
            self._open()
        self._end()

    def put(self, lines: list[str]) -> None:
        """Ready lines (of a table) as a block."""
        if not lines:
            return
        self.block(2)
        self._open()
        pad = "".join(self.line) if self.line else " " * self.indent
        self.lines += [((pad if i == 0 else " " * len(pad)) + x).rstrip(" ") for i, x in enumerate(lines)]
        self.line = []
        self.gap = 2

    def done(self) -> list[str]:
        if self.line:
            self._end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines


class _Cell:
    def __init__(self, attrs: str):
        self.lines: list[str] = []
        self.across = _span(attrs, "colspan", 1000) or 1
        self.down = _span(attrs, "rowspan", 65534)  # 0: to the end of the table


class _Table:
    def __init__(self, outer: _Flow):
        self.outer = outer
        self.rows: list[list[_Cell]] = []
        self.captions: list[str] = []

    def _grid(self) -> list[list[tuple[int, _Cell]]]:
        """The cells of each row with the columns where they begin."""
        grid = []
        busy: list[list[int]] = []  # [first column, column after, rows left] of cells from above, in order
        for row in self.rows:
            own, at, k, new = [], 0, 0, []
            for cell in row:
                while k < len(busy) and busy[k][0] < at + 1:
                    at = max(at, busy[k][1])
                    k += 1
                own.append((at, cell))
                if cell.down != 1:
                    new.append([at, at + cell.across, cell.down or 1 << 30])
                at += cell.across
            grid.append(own)
            busy = sorted([a, b, n - 1] for a, b, n in busy + new if n > 1)
        return grid

    def lines(self) -> list[str]:
        grid = self._grid()
        used = sorted({at for row in grid for at, _ in row})
        place = {at: i for i, at in enumerate(used)}
        widths = [0] * len(used)
        wide = []
        for row in grid:
            for at, cell in row:
                w = max((_width(x) for x in cell.lines), default=0)
                last = bisect_left(used, at + cell.across) - 1
                if last == place[at]:
                    widths[last] = max(widths[last], w)
                else:
                    wide.append((last - place[at], place[at], last, w))
        # Cells over several columns widen the last of them if need be, narrow ones first.
        for _, first, last, w in sorted(wide):
            have = sum(widths[first : last + 1]) + 2 * (last - first)
            widths[last] += max(0, w - have)
        begin = [0, *accumulate(w + 2 for w in widths)]
        out = list(self.captions)
        for row in grid:
            for k in range(max((len(c.lines) for _, c in row), default=0)):
                parts, length = [], 0
                for at, cell in row:
                    if k < len(cell.lines) and cell.lines[k]:
                        pad = begin[place[at]] - length
                        parts.append(" " * pad + cell.lines[k])
                        length += pad + _width(cell.lines[k])
                out.append("".join(parts).rstrip(" "))
        return out


def _span(attrs: str, name: str, most: int) -> int:
    m = re.search(rf"(?i)(?<![^\s/\"']){name}\s*=\s*[\"']?\s*(\d+)", attrs) if name in attrs.lower() else None
    return min(most, int(m[1][:9])) if m else 1


def _shown(attrs: str) -> tuple[bool, bool | None]:
    """Whether an element is hidden with all below it, and whether its text is visible (None: as that around it)."""
    hidden, visible = False, None
    if not attrs or "hidden" not in attrs.lower() and "style" not in attrs.lower():
        return hidden, visible
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" and value.lower() != "until-found" or name == "style" and _HIDING.search(value):
            hidden = True
        if name == "style" and (v := _VISIBILITY.findall(value)):
            visible = v[-1].lower() == "visible"
    return hidden, visible


def render(source: str) -> str:
    """The visible text of a page; blocks on lines of their own.

    Time is linear in the page, but for lines of nested tables, which each
    table around them pads again, and rows that cells of many rows above reach
    into.
    """
    flow = _Flow()
    stack: list[list] = []  # [tag, hides, what to restore, whether text was visible before]
    tables: list[_Table] = []
    count: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag
    hiding = pre = 0
    visible = True
    lists: list[list] = []

    def leave() -> None:
        nonlocal flow, hiding, pre, visible
        tag, hides, old, visible = stack.pop()
        count[tag].pop()
        hiding -= hides
        if tag in ("pre", "textarea", "xmp"):
            pre -= 1
        if old is not None:
            kind, value = old
            if kind == "cell":
                lines = flow.done()
                flow, cell = value
                cell.lines = lines
            elif kind == "caption":
                table = tables[-1]
                table.captions += flow.done()
                flow = value
            elif kind == "table":
                table = tables.pop()
                if not hides:
                    flow.put(table.lines())
            elif kind == "list":
                lists.pop()
                flow.indent = value
                flow.block(1 if lists else 2)
            elif kind == "indent":
                flow.indent, flow.mark = value, ""
                flow.block(1)
        elif (tag in BLOCK or tag == "text" and count.get("svg")) and not hiding:
            flow.block(2 if tag in PARAGRAPH else 1)

    def close(tags: set[str], bounds: set[str]) -> None:
        at = max((count[t][-1] for t in tags if count.get(t)), default=-1)
        if at >= 0 and at >= max((count[t][-1] for t in bounds if count.get(t)), default=-1):
            while len(stack) > at:
                leave()

    def enter(tag: str, attrs: str) -> None:
        nonlocal flow, hiding, pre, visible
        foreign = count.get("svg") or count.get("math")
        hidden, seen = _shown(attrs)
        hides = int(tag in SILENT or bool(foreign) and tag in FOREIGN_SILENT or hidden)
        hiding += hides
        old, before = None, visible
        visible = visible if seen is None else seen
        if tag in ("pre", "textarea", "xmp"):
            pre += 1
        if not hiding:
            if tag == "table":
                tables.append(_Table(flow))
                old = ("table", None)
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                cell = _Cell(attrs)
                tables[-1].rows[-1].append(cell)
                old = ("cell", (flow, cell))
                flow = _Flow()
            elif tag == "caption" and tables:
                old = ("caption", flow)
                flow = _Flow()
            elif tag in ("ul", "ol", "menu"):
                flow.block(1 if lists else 2)
                old = ("list", flow.indent)
                start = re.search(r"\bstart\s*=\s*[\"']?(-?\d{1,9})", attrs) if tag == "ol" else None
                lists.append([tag == "ol", int(start[1]) if start else 1])
            elif tag == "li":
                flow.block(1)
                old = ("indent", flow.indent)
                ordered = lists[-1] if lists else [False, 1]
                flow.mark = f"{ordered[1]}. " if ordered[0] else "- "
                ordered[1] += 1
                flow.indent += len(flow.mark)
            elif tag in ("dd", "blockquote"):
                flow.block(2 if tag == "blockquote" else 1)
                old = ("indent", flow.indent)
                flow.indent += 2
            elif tag in BLOCK or tag == "text" and foreign:
                flow.block(2 if tag in PARAGRAPH else 1)
        count.setdefault(tag, []).append(len(stack))
        stack.append([tag, hides, old, before])

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        end = m.start() if m else n
        if end > at and not hiding and visible:
            s = html.unescape(source[at:end])
            # Text straight inside a table's rows is shown before the table.
            if s.strip() or not (tables and stack and stack[-1][0] in ("table", "tr", "tbody", "thead", "tfoot")):
                flow.text(s, bool(pre))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                if not hiding:
                    flow.br()
            elif tag == "p" and not count.get("p"):
                if not hiding:
                    flow.block(2)
            elif count.get(tag):
                # A cell's or table's end tag is not ended by tags outside of it.
                bounds = {"table"} if tag not in ("table",) else set()
                inline = tag not in BLOCK and tag not in ("td", "th", "caption")
                close({tag}, (bounds | ({"td", "th", "caption"} if inline or tag in ("p", "div", "li") else set())) - {tag})
            continue
        if tag in _CLOSES_P:
            close({"p"}, {"table", "td", "th", "caption", "button"})
        if tag in _ENDS:
            close(*_ENDS[tag])
        elif count.get("head") and tag not in SILENT and tag not in ("meta", "link", "base", "html", "head"):
            close({"head"}, set())
        if tag in VOID:
            if not hiding and not _shown(m[3])[0]:
                if tag == "br":
                    flow.br()
                elif tag == "hr":
                    flow.block(2)
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
            body = source[at : stop.start() if stop else n]
            hidden, seen = _shown(m[3])
            if tag not in SILENT and not hiding and not hidden and (visible if seen is None else seen):
                flow.text(html.unescape(body) if tag == "textarea" else body, True)
            if not stop:
                break
            close_at = source.find(">", stop.end())
            at = n if close_at < 0 else close_at + 1
            continue
        if m[3].endswith("/") and (tag in ("svg", "math") or count.get("svg") or count.get("math")):
            continue
        enter(tag, m[3] or "")
        if tag == "pre" and source.startswith("\n", at):
            at += 1
    while stack:
        leave()
    return "\n".join(flow.done())


def extract(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """``key`` and text of each row of ``pages``.

    A null page has a null text, an empty one an empty text; broken markup is
    rendered as far as it goes; repeated rows are each rendered.
    """
    Workspace(pages.sparkSession, "html")
    rows = pages.select(key, column)
    schema = f"`{key}` {rows.schema[0].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                text = [None if h is None else render(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, schema)


def html_query(pages: DataFrame) -> DataFrame:
    text = extract(pages)
    return text.select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
