"""Visible text of HTML pages, laid out as a browser would.

A tree builder turns a page's tags into properly nested open and close events:
it implies the end tags that HTML allows to be left out, ignores stray ones
and closes what the end of the page leaves open.  The events drive a layout of
nested flows: blocks begin on lines of their own, with an empty line around
paragraphs, headings, lists and tables; list items are marked and indented;
preformatted text keeps its white space; table cells stand in aligned columns.
Both steps keep explicit stacks, so depth is no limit, and each page is read
once, in time linear in its length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas svg "
                   "math datalist input area base col link meta param source track rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset menu".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form "
                           "header hgroup html legend li main nav optgroup option search section summary caption "
                           "thead tbody tfoot tr td th textarea select".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup legend caption thead tbody tfoot tr td th textarea "
                             "select".split())
#: An opening tag ends open elements of these kinds, up to a fence.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "thead": ("tr", "td", "th", "thead", "tbody", "tfoot"),
        "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tfoot": ("tr", "td", "th", "thead", "tbody", "tfoot"),
        "option": ("option",), "optgroup": ("option", "optgroup"), "rt": ("rt", "rp"), "rp": ("rt", "rp"),
        "body": ("head",)}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"),
          "optgroup": ("select",), "rt": ("ruby",), "rp": ("ruby",), "body": ()}
TABLE_PARTS = frozenset("tr td th thead tbody tfoot".split())
P_FENCES = frozenset("button caption html marquee object table td th template".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
                    re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)",
                     re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
#: Cells wider than this are not padded to, so that one long cell does not widen every row.
ALIGN = 60


def events(page: str) -> Iterator[tuple[str, str, dict]]:
    """("open", tag, attributes), ("close", tag, {}) and ("text", text, {}), properly nested."""
    stack: list[str] = []
    counts: dict[str, int] = {}

    def pop() -> tuple[str, str, dict]:
        tag = stack.pop()
        counts[tag] -= 1
        return "close", tag, {}

    def down_to(kinds, fence) -> int | None:
        """Lowest place in the stack of an element of these kinds above the nearest fence."""
        if not any(counts.get(k) for k in kinds):
            return None
        found = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in fence:
                break
            if stack[i] in kinds:
                found = i
        return found

    def nearest(tag: str, fence) -> int | None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] == tag:
                return i
            if stack[i] in fence:
                return None
        return None

    at, last_end = 0, page.rfind(">") + 1       # no tag ends behind the last ">", so none is looked for there
    while at < len(page):
        m = _TOKEN.search(page, at, last_end) if at < last_end else None
        if m is None:
            yield "text", page[at:], {}
            break
        if m.start() > at:
            yield "text", page[at:m.start()], {}
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if counts.get(tag):
                fence = () if tag in ("table", "body", "html") else ("table",) if tag in BLOCK else ("table", "td", "th")
                last = nearest(tag, fence)
                if last is not None:
                    while len(stack) > last:
                        yield pop()
            elif tag == "p":
                yield "open", "p", {}
                yield "close", "p", {}
            elif tag == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            continue
        if tag in ENDS:
            place = down_to(ENDS[tag], FENCES.get(tag, ("table",)))
            if place is not None:
                while len(stack) > place:
                    yield pop()
        if tag in CLOSES_P and counts.get("p"):
            place = down_to(("p",), P_FENCES)
            if place is not None:
                while len(stack) > place:
                    yield pop()
        found = {}
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                found.setdefault(a[1].lower(), html.unescape((a[2] or "").strip("\"'")))
        yield "open", tag, found
        if tag in VOID:
            yield "close", tag, {}
            continue
        stack.append(tag)
        counts[tag] = counts.get(tag, 0) + 1
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                yield "text", page[at:stop], {}
            yield pop()
            gt = page.find(">", stop)
            at = len(page) if end is None or gt < 0 else gt + 1
    while stack:
        yield pop()


class _Flow:
    """Lines of one block context."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0            # 1: a new line is due, 2: an empty line too
        self.space = False      # a collapsed space is due before the next word
        self.prefix: list[str] = []
        self.mark = ""          # list mark for the next line

    def words(self, text: str) -> None:
        parts = _BLANK.split(text)
        if len(parts) == 1 and not parts[0]:
            return
        first, last = not parts[0], not parts[-1]
        body = " ".join(p for p in parts if p)
        if not body:
            self.space = self.space or bool(self.line)
            return
        self._begin()
        if (self.space or first) and self.line and not self.line[-1].endswith("\n"):
            self.line.append(" ")
        self.line.append(body)
        self.space = last

    def _begin(self) -> None:
        if not self.gap:
            return
        if self.mark and not self.line:     # a list item's first block stands beside its mark
            self.gap = 0
            return
        self._end_line()
        if self.gap > 1 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0

    def _end_line(self) -> None:
        text = "".join(self.line).rstrip(" ")
        if text or self.mark:
            lead = "".join(self.prefix)
            if self.mark:
                lead = lead[:len(lead) - len(self.mark)] + self.mark
                self.mark = ""
            self.lines.append((lead + text).rstrip(" "))
        self.line, self.space = [], False

    def edge(self, gap: int) -> None:
        """The beginning or end of a block."""
        if self.line:
            self._end_line()
        self.gap = max(self.gap, gap)
        self.space = False

    def newline(self) -> None:
        self._begin()
        if self.line:
            self._end_line()
        elif self.lines:
            self.lines.append("")
        self.space = False

    def verbatim(self, text: str) -> None:
        lines = text.split("\n")
        for i, line in enumerate(lines):
            if i:
                self._raw_end()
            if line:
                self._begin()
                self.line.append(line)

    def _raw_end(self) -> None:
        if self.line:
            text = "".join(self.line)
            self.lines.append("".join(self.prefix) + text.rstrip())
            self.line = []
        elif self.lines:
            self.lines.append("")

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self._begin()
            self._end_line()
            self.line.append(line)
        self._end_line()

    def text(self) -> str:
        self._end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _grid(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (cell text, columns it spans) as lines with aligned columns."""
    widths: list[int] = []
    cut = [[(cell.split("\n"), span) for cell, span in row] for row in rows]
    for row in cut:
        column = 0
        for lines, span in row:
            while len(widths) < column + 1:
                widths.append(0)
            if span == 1:
                widths[column] = max(widths[column], max((len(x) for x in lines if len(x) <= ALIGN), default=0))
            column += span
    out = []
    for row in cut:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            parts, column = [], 0
            for lines, span in row:
                width = sum(widths[column:column + span]) + 3 * (span - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(min(width, ALIGN * span)))
                column += span
            out.append(" | ".join(parts).rstrip())
    return out


def layout(page: str | None) -> str:
    """The visible text of a page; a null or empty page has none."""
    if not page:
        return ""
    flow = _Flow()
    outer: list[tuple] = []         # flows and tables around a cell
    tables: list[list] = []         # rows of each open table
    lists: list[list] = []          # (kind, counter) of each open list
    cells: list[int] = []           # columns spanned by each open cell
    hidden = pre = 0
    opened: list[tuple[bool, str]] = []
    for kind, name, found in events(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")):
        if kind == "text":
            if not hidden:
                text = html.unescape(name) if "&" in name else name
                flow.verbatim(text) if pre else flow.words(text)
            continue
        if kind == "open":
            unseen = (name in HIDDEN or "hidden" in found
                      or ("style" in found and bool(_UNSEEN.search(found["style"])))
                      or (name == "dialog" and "open" not in found))
            opened.append((unseen, name))
            hidden += unseen
            if hidden:
                if name in ("td", "th", "table"):
                    opened[-1] = (unseen, "")
                continue
            if name == "br":
                flow.newline()
            elif name == "wbr":
                continue
            elif name in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                span = found.get("colspan", "1")
                cells.append(min(max(int(span), 1), 1000) if span.isdigit() and len(span) < 6 else 1)
                outer.append((flow, lists, pre))
                flow, lists, pre = _Flow(), [], 0
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in BLOCK:
                flow.edge(2 if name in SPACED and not (lists and name in ("ul", "ol", "menu")) else 1)
                if name == "table":
                    tables.append([])
                elif name in ("ul", "ol", "menu", "dir"):
                    start = found.get("start", "")
                    lists.append([name, int(start) - 1 if start.isdigit() and len(start) < 10 else 0])
                elif name == "li":
                    if not lists:
                        lists.append(["ul", 0])
                        opened[-1] = (unseen, "li+")
                    lists[-1][1] += 1
                    mark = f"{lists[-1][1]}. " if lists[-1][0] == "ol" else "- "
                    if flow.mark:
                        flow._end_line()
                    flow.prefix.append(" " * len(mark))
                    flow._begin()
                    flow.mark = mark
                elif name in ("blockquote", "dd"):
                    flow.prefix.append("  ")
                elif name in ("pre", "textarea"):
                    pre += 1
            continue
        unseen, name = opened.pop()
        if unseen:
            hidden -= 1
            continue
        if hidden or not name:
            continue
        if name in ("td", "th") and cells and outer:
            text = flow.text()
            flow, lists, pre = outer.pop()
            tables[-1][-1].append((text, cells.pop()))
        elif name == "table":
            rows = tables.pop()
            flow.rows(_grid([r for r in rows if r]))
            flow.edge(2)
        elif name == "tr":
            continue
        elif name in BLOCK or name == "li+":
            base = name.rstrip("+")
            if base == "li":
                flow.edge(1)
                if flow.mark:
                    flow._end_line()
                flow.prefix.pop()
                if name == "li+":
                    lists.pop()
            else:
                flow.edge(2 if base in SPACED and not (len(lists) > 1 and base in ("ul", "ol", "menu")) else 1)
                if base in ("ul", "ol", "menu", "dir"):
                    lists.pop()
                elif base in ("blockquote", "dd"):
                    flow.prefix.pop()
                elif base in ("pre", "textarea"):
                    pre -= 1
    return flow.text()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        place = batch.schema.get_field_index("html")
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            texts = [layout(p.as_py()) for p in part.column(place)]
            yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "text"])


def visible_text(pages: DataFrame) -> DataFrame:
    """``pages`` with the column text: the visible text of each whole ``html``.

    Null and empty pages have the empty text.  Rows are independent: null or
    repeated ids do no harm.  All columns stay; a column named text is replaced.
    """
    base = pages.drop("text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema.fields)
    return base.withColumn("html", F.col("html").cast("string")).mapInArrow(_render, fields + "text string")
