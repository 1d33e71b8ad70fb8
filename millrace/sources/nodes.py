"""Elements of HTML pages as rows: where each begins and ends, so that what lies within what is told by comparing numbers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import DROPPED, ENDS, VOID, by_pieces

COLUMNS = "node int, last int, parent int, depth int, tag string, id string, classes array<string>, begin bigint, length bigint"


class _Elements(HTMLParser):
    """Numbers elements as they begin; an element's last number is that of the last one that begins within it."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.parts: list[str] = []
        self.at = self.dropped = 0
        self.feed(html)
        self.close()
        while self.open:
            self._end()
        self.text = "\n".join(self.parts)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open and tag in ENDS.get(self.rows[self.open[-1]][4], ()):
            self._end()
        own, n = dict(attrs), len(self.rows)
        classes = list(dict.fromkeys((own.get("class") or "").split()))
        self.rows.append([n, n, self.open[-1] if self.open else None, len(self.open), tag, own.get("id") or None, classes, self.at, 0])
        if tag not in VOID:
            self.open.append(n)
            self.dropped += tag in DROPPED

    def handle_endtag(self, tag: str) -> None:
        if any(self.rows[n][4] == tag for n in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and not self.dropped:
            self.parts.append(data)
            self.at += len(data) + 1

    def _end(self) -> str:
        row = self.rows[self.open.pop()]
        row[1], row[8] = len(self.rows) - 1, max(self.at - row[7] - 1, 0)
        self.dropped -= row[4] in DROPPED
        return row[4]


def elements(html: str | None) -> tuple[list[tuple], str]:
    """Rows of ``COLUMNS`` in order of begin, and the page's text, strings on lines of their own; parts that no reader sees have none."""
    page = _Elements(html or "")
    return [tuple(r) for r in page.rows], page.text


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows ``(key, node, last, parent, depth, tag, id, classes, begin, length, text)``, one for each element, and one of node -1 with the page's text.

    Element ``b`` lies within ``a`` where ``a.node < b.node <= a.last``. ``begin`` and ``length`` are its place in the page's text. A null page has its
    row of node -1 alone. ``key`` must tell the pages apart.
    """

    def rows(k: Any, page: str | None) -> Iterator[tuple]:
        found, text = elements(page)
        yield k, -1, len(found) - 1, None, -1, "", None, [], 0, len(text), text
        yield from ((k, *r, None) for r in found)

    schema = f"k {pages.schema[key].dataType.simpleString()}, {COLUMNS}, text string"
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInArrow(by_pieces(rows, schema), schema).withColumnRenamed("k", key)
