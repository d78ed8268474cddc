"""HTML to Markdown and plain text, as an Arrow batch job over the page table.

A page is first flattened to runs of text, each carrying the place it stands
in (heading, list item, quote, preformatted, link and emphasis around it).
Runs of one block then become one line.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from itertools import groupby, takewhile
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Tags whose content is dropped, tags that end a line, inline markers, tags without content.
DROPPED = {"script", "style", "noscript", "head", "svg", "template", "iframe"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "aside", "main", "blockquote", "li", "tr", "td",
          "th", "table", "figure", "figcaption", "address", "dt", "dd", "thead", "tbody", "tfoot", "ul", "ol", "pre",
          "h1", "h2", "h3", "h4", "h5", "h6"}
INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "kbd": "`", "samp": "`", "del": "~~", "s": "~~", "code": "`"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSING = ".,;:!?)]}"
#: Pages that are Python strings at a time.
PAGES = 64


class Place(NamedTuple):
    """Where a run of text stands; ``lead`` is a list of one marker that the first line of an item uses up."""

    dropped: bool = False
    pre: bool = False
    depth: int = 0                  # lists around
    lead: tuple[list[str], ...] = ()
    marks: tuple[tuple[int, str, str], ...] = ()      # (number of the element, opening, closing)


class Run(NamedTuple):
    block: int
    place: Place
    text: str
    glued: bool = False             # an image: text after it follows without a blank


class _Flattener(HTMLParser):
    """Reads the tags of one page into runs."""

    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.runs = base, []
        self.block = self.serial = 0
        self.open: list[tuple[str, Place]] = []
        self.names: Counter = Counter()
        self.counters: list[list] = []       # per open list: ordered or not, items so far

    @property
    def place(self) -> Place:
        return self.open[-1][1] if self.open else Place()

    def absolute(self, ref: str | None) -> str:
        try:
            return urljoin(self.base, ref or "") if self.base else ref or ""
        except ValueError:
            return ref or ""

    def handle_starttag(self, tag, attrs):
        around, given = self.place, dict(attrs)
        if tag in BLOCKS or tag in ("br", "hr"):
            self.block += 1
        if tag in VOID:
            if around.dropped:
                return
            if tag == "img":
                self.runs.append(Run(self.block, around,
                                     f"![{given.get('alt') or ''}]({self.absolute(given.get('src'))})", True))
            elif tag == "hr":
                self.runs.append(Run(self.block, Place(), "---"))
                self.block += 1
            return
        self.open.append((tag, self.inner(tag, given, around)))
        self.names[tag] += 1

    def inner(self, tag: str, given: dict, around: Place) -> Place:
        """The place inside an element."""
        self.serial += 1
        if around.dropped or tag in DROPPED:
            return around._replace(dropped=True)
        if tag in ("ul", "ol"):
            self.counters.append([tag == "ol", 0])
            return around._replace(depth=around.depth + 1)
        if tag == "li":
            return around._replace(lead=around.lead + ([self.item_marker()],))
        if tag == "blockquote":
            return around._replace(lead=around.lead + (["> "],))
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return around._replace(lead=around.lead + (["#" * int(tag[1]) + " "],))
        if tag == "pre":
            return around._replace(pre=True)
        if tag == "a":
            return self.marked(around, "[", f"]({self.absolute(given.get('href'))})")
        if tag in INLINE and not around.pre:
            return self.marked(around, INLINE[tag], INLINE[tag])
        return around

    def marked(self, around: Place, opening: str, closing: str) -> Place:
        return around._replace(marks=around.marks + ((self.serial, opening, closing),))

    def item_marker(self) -> str:
        if not self.counters:
            return "- "
        last = self.counters[-1]
        last[1] += 1
        return "  " * (len(self.counters) - 1) + (f"{last[1]}. " if last[0] else "- ")

    def handle_endtag(self, tag):
        if not self.names[tag]:
            return
        while True:
            name, place = self.open.pop()
            self.names[name] -= 1
            self.block += name in BLOCKS
            if name in ("ul", "ol") and self.counters and not place.dropped:
                self.counters.pop()
            if name == tag:
                return

    def handle_data(self, data):
        place = self.place
        text = data if place.pre else " ".join(data.split())
        if text and not place.dropped:
            self.runs.append(Run(self.block, place, text))


def _line(runs: list[Run]) -> str:
    """One block's runs as a line: a blank between them, but not before closing punctuation."""
    out, marks, gap = [], (), False
    for run in [*runs, Run(0, Place(), "")]:
        same = len(list(takewhile(lambda pair: pair[0][0] == pair[1][0], zip(marks, run.place.marks))))
        out.extend(closing for _, _, closing in reversed(marks[same:]))
        opened = run.place.marks[same:]
        if gap and run.text and (opened or run.glued or run.text[0] not in CLOSING):
            out.append(" ")
        out.extend(opening for _, opening, _ in opened)
        out.append(run.text)
        marks, gap = run.place.marks, not run.glued
    return "".join(out)


def _lead(place: Place) -> str:
    used = "".join(marker.pop() for marker in place.lead if marker)
    return used or "  " * max(0, place.depth - 1)


def to_markdown(html: str | None, base: str | None = None) -> str:
    """Markdown of one page: a line per block, blank lines only inside preformatted text.

    Null and empty pages give a single newline.  Items of nested lists are
    indented by two blanks a level; further lines of an item stand under it.
    """
    page = _Flattener(base)
    page.feed(html or "")
    page.close()
    lines: list[str] = []
    for pre, part in groupby(page.runs, key=lambda run: run.place.pre):
        if pre:
            lines += ["```", "".join(run.text for run in part).strip("\n"), "```"]
            continue
        for _, block in groupby(part, key=lambda run: run.block):
            block = list(block)
            lines.append((_lead(block[0].place) + _line(block)).rstrip())
    return "\n".join(lines).strip() + "\n"


def markdown_of(pages: DataFrame, keys: Sequence[str], html: str = "html", url: str | None = None) -> DataFrame:
    """Markdown of each page; with ``url`` links become absolute."""
    narrow = pages.select(*keys, html, *([url] if url else []))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few pages at a time are Python strings, with their Markdown
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                bases = part.column(url).to_pylist() if url else [None] * part.num_rows
                texts = [to_markdown(h, b) for h, b in zip(part.column(html).to_pylist(), bases)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in keys], pa.array(texts, pa.string())], [*keys, "markdown"])

    fields = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes if n in keys)
    return narrow.mapInArrow(render, f"{fields}, markdown string")


def plain_text(markdown: Column) -> Column:
    """Markdown without its markers, line by line: links and images keep their words, list items a dash."""
    def bare(line: Column) -> Column:
        words = F.regexp_replace(line, r"^\s*#{1,6} |[*_~`>]+", "")
        words = F.regexp_replace(words, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
        return F.regexp_replace(words, r"^(\s*)\d+\. ", "$1- ")

    lines = F.filter(F.transform(F.split(markdown, "\n"), bare), lambda line: F.trim(line) != "")
    return F.concat(F.trim(F.array_join(lines, "\n")), F.lit("\n"))
