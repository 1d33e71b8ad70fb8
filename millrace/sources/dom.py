"""Blocks of HTML pages as rows.

Pages are parsed once, in tasks. What a block holds is told by sums over the page up to its begin and its end:
characters, characters of links, paragraphs. So a block's row is small, and the page's text is kept once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C

DROPPED = {"script", "style", "nav", "footer", "iframe", "header", "aside", "noscript", "template", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"body", "article", "main", "section", "div", "td", "ul", "ol"}
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": {"p", "div", "section", "article", "main", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6"}, "li": {"li"}, "td": {"td", "tr"}, "tr": {"tr"}}
MARKS = "。，！？；：、"
COLUMNS = {
    "node": "int", "tag": "string", "depth": "int", "weight": "double", "listed": "boolean", "length": "bigint", "begin": "bigint", "links": "bigint", "paragraphs": "bigint", "quality": "double",
    "cjk": "bigint", "banner": "boolean", "items": "int", "text": "string",
}


class _Page(HTMLParser):
    """Open elements are lists ``[tag, depth, begin, links before, paragraphs before, quality before, weight, li, articles, anchors before]``."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.parts: list[str] = []
        self.at = self.links = self.paragraphs = self.dropped = self.in_link = self.anchors = 0
        self.items: list[bool] = []
        self.quality = 0.0
        self.blocks: list[tuple] = []
        self.feed(html)
        self.close()
        while self.open:
            self._end()
        self.text = " ".join(self.parts)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        while self.open and tag in ENDS.get(self.open[-1][0], ()):
            self._end()
        if self.open and tag in ("li", "article"):
            self.open[-1][7 if tag == "li" else 8] += 1
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        weight = max(0.1, 1 + sum(w for parts, w in C.WEIGHTS if any(x in names for x in parts)))
        self.open.append([tag, len(self.open) + 2, self.at, self.links, self.paragraphs, self.quality, weight, 0, 0, self.anchors])
        self.dropped += tag in DROPPED
        self.in_link += tag == "a"
        self.anchors += tag == "a" and not self.dropped

    def handle_endtag(self, tag: str) -> None:
        if any(e[0] == tag for e in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        data = " ".join(data.split())
        if data and not self.dropped:
            self.parts.append(data)
            self.at += len(data) + 1
            self.links += (len(data) + 1) * bool(self.in_link)

    def _end(self) -> str:
        tag, depth, begin, links, paragraphs, quality, weight, li, articles, anchors = self.open.pop()
        self.dropped -= tag in DROPPED
        self.in_link -= tag == "a"
        if self.dropped:
            return tag
        if tag == "p":
            text = self._text(begin)
            self.paragraphs += 1
            if len(text) >= 20:
                self.quality += 1.0 if 0.03 <= sum(c in MARKS for c in text) / len(text) <= 0.15 else 0.5
        if tag == "li":
            self.items.append(self.anchors > anchors and self.at - begin - 1 > 20)
        if tag in BLOCKS and self.at > begin:
            self.blocks.append((tag, depth, weight, li > 5 or articles > 3, begin, self.at - 1, self.links - links, self.paragraphs - paragraphs, self.quality - quality))
        return tag

    def _text(self, begin: int) -> str:
        out, left = [], self.at - begin
        for part in reversed(self.parts):
            if left <= 0:
                break
            out.append(part)
            left -= len(part) + 1
        return " ".join(reversed(out))


def parsed(html: str | None) -> list[tuple]:
    """Rows of ``COLUMNS``: the whole page first, with its text, then its blocks."""
    page = _Page(html or "")
    low = page.text.lower()
    same = len(low) == len(page.text)
    found = sorted(i for k in C.LISTING_BLOCKS for i in _all(low, k)) if same else []
    cookies = [list(_all(low, k)) for k in C.COOKIES] if same else []
    wide = np.cumsum(np.append(0, _is_cjk(page.text)))

    def shows(marks: list[int], begin: int, end: int) -> bool:
        at = bisect_left(marks, begin)
        return at < len(marks) and marks[at] < end

    def more(begin: int, end: int) -> tuple:
        return int(wide[end] - wide[begin]), sum(shows(m, begin, end) for m in cookies) >= 3

    n = len(page.text)
    rows = [(0, "page", 1, 1.0, False, n, 0, page.links, page.paragraphs, page.quality, *more(0, n), sum(page.items[:20]), page.text)]
    for i, (tag, depth, weight, listed, begin, end, links, paragraphs, quality) in enumerate(page.blocks, 1):
        rows.append((i, tag, depth, weight, listed or shows(found, begin, end), end - begin, begin, links, paragraphs, quality, *more(begin, end), 0, None))
    return rows


def _is_cjk(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (points >= 0x4E00) & (points <= 0x9FFF)


def _all(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows ``(key, node, tag, depth, weight, listed, length, begin, links, paragraphs, quality, cjk, banner, items, text)``.

    ``cjk`` counts characters, ``banner`` tells a block that speaks of cookies, and ``items`` are those of a page's first twenty list items
    that look like articles: a link in more than twenty characters.

    Node 0 is the whole page and the only one with a text, of which the others are parts. A null page is an empty one.
    """

    kind = pages.schema[key].dataType.simpleString()
    schema = f"k {kind}, " + ", ".join(f"{n} {t}" for n, t in COLUMNS.items())
    rows = pages.select(F.col(key).alias("k"), F.col(html).alias("h"))
    return rows.mapInArrow(by_pieces(lambda k, h: ((k, *r) for r in parsed(h)), schema), schema).withColumnRenamed("k", key)


#: Characters of pages, and rows made of them, that a task's Python holds at a time, about; one page's are never cut.
PIECE, ROWS = 1 << 20, 1 << 14
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def by_pieces(rows: Callable[[Any, str | None], Iterable[tuple]], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs ``rows`` over keys and pages. What is held does not grow with a batch; the key is the first column."""
    names, kinds = zip(*[c.split(" ") for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b["k"].type, *[_KINDS[k] for k in kinds[1:]]]
            put = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=list(names))
            held, size = [], 0
            for i in range(b.num_rows):
                page = b["h"][i].as_py()
                held += rows(b["k"][i].as_py(), page)
                size += len(page or "")
                if size >= PIECE or len(held) >= ROWS:
                    yield put(held)
                    held, size = [], 0
            if held:
                yield put(held)

    return run
