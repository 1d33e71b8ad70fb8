"""Many fixed strings in many texts: site templates by parts of urls, terms that are stripped before keywords are counted.

Patterns are a table. Each has one gram of up to three characters as its anchor, the one that the fewest patterns share. Texts are cut into pieces,
each with as much of the next as the longest pattern needs; a piece's grams meet the anchors in a hash join, and what meets is compared
with the whole pattern. So the work grows with the texts and with what is found, and not with texts times patterns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources.texts import slices, utf8

#: Characters of an anchor, and of a piece of text at least.
GRAM, PIECE = 3, 64
#: Up to so many patterns are broadcast; with more of them Spark deals grams and anchors alike.
BROADCAST_ROWS = 200_000


def anchors(patterns: DataFrame, pattern: str) -> DataFrame:
    """Rows ``(pattern, len, g, gram, a)``: the gram by which each distinct pattern is found, its size, and where it stands in it."""
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern is not null and pattern <> ''").distinct()
    p = p.withColumn("len", F.length("pattern")).withColumn("g", F.least(F.lit(GRAM), "len"))
    each = p.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("g"))).alias("a")).withColumn("gram", F.substring("pattern", F.col("a") + 1, F.col("g")))
    shared = each.withColumn("n", F.count("*").over(Window.partitionBy("gram")))
    best = shared.groupBy("pattern", "len", "g").agg(F.min(F.struct("n", "a", "gram")).alias("x"))
    return best.select("pattern", "len", "g", "x.gram", "x.a")


def occurrences(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Rows ``(key, pattern, at)``: every place, from 0 in characters, at which a distinct pattern stands in a text; overlapping ones too.

    Null and empty texts and patterns have no place. Rows of ``texts`` that repeat have their places repeated. Case counts.
    """
    sizes = patterns.select(F.length(pattern).alias("n")).where("n > 0").agg(F.max("n").alias("longest"), F.count("*").alias("rows"), F.collect_set(F.least(F.lit(GRAM), "n")).alias("grams")).first()
    longest, step = sizes.longest or 1, max(PIECE, sizes.longest or 1)
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def with_next(p: Column) -> Column:
        tail = lambda i: F.coalesce(F.substring(F.get(p, i + 1), 1, longest - 1), F.lit("")) if longest > 1 else F.lit("")
        return F.transform(p, lambda x, i: F.struct(i.alias("piece"), F.length(x).alias("own"), F.concat(x, tail(i)).alias("x")))

    cut = F.get(F.transform(F.array(pieces), with_next), F.lit(0))
    d = texts.select(F.col(key), F.explode_outer(cut).alias("p")).where("p is not null").select(key, "p.*")
    d = d.withColumn("g", F.explode(F.array(*[F.lit(g) for g in sorted(sizes.grams) or [1]])))
    d = d.where(F.length("x") >= F.col("g")).withColumn("at", F.explode(F.sequence(F.lit(0), F.length("x") - F.col("g"))))
    d = d.withColumn("gram", F.substring("x", F.col("at") + 1, F.col("g")))
    known = anchors(patterns, pattern)
    d = d.join(F.broadcast(known) if sizes.rows <= BROADCAST_ROWS else known, ["g", "gram"])
    start = F.col("at") - F.col("a")
    d = d.where((start >= 0) & (start < F.col("own")) & (F.substring("x", start + 1, F.col("len")) == F.col("pattern")))
    return d.select(key, "pattern", (F.col("piece").cast("bigint") * step + start).alias("at"))


def best_template(urls: DataFrame, key: str, url: str, templates: DataFrame) -> DataFrame:
    """Rows ``(key, name, indicator)``: the template that fits each url best; urls that none fits have no row.

    ``templates`` has ``(name, ord, indicator)``. One fits if an indicator is part of the url in lower case; it counts by its longest such
    indicator, one with a dot before all without. Of equals the smaller ``ord`` wins, then the name. Null and empty indicators fit nothing.
    ``key`` must tell the rows apart.
    """
    low = urls.select(F.col(key), F.lower(F.col(url)).alias("_url"))
    found = occurrences(low, key, "_url", templates, "indicator").select(key, F.col("pattern").alias("indicator")).distinct()
    found = found.join(templates.select("name", "ord", "indicator").distinct(), "indicator")
    dotted = F.when(F.max_by("indicator", F.struct(F.length("indicator"), "indicator")).contains("."), C.DOTTED).otherwise(0)
    each = found.groupBy(key, "name", "ord").agg(F.max_by("indicator", F.struct(F.length("indicator"), "indicator")).alias("indicator"), (dotted + F.max(F.length("indicator"))).alias("fit"))
    best = each.groupBy(key).agg(F.min(F.struct((-F.col("fit")).alias("f"), "ord", "name", "indicator")).alias("x"))
    return best.select(key, "x.name", "x.indicator")


def scoped_terms(terms: DataFrame, keep: DataFrame) -> DataFrame:
    """``terms`` (``scope``, ``term``) without those in ``keep`` (``term``): what is to be kept wins in every scope."""
    return terms.select("scope", "term").distinct().join(keep.select("term"), "term", "left_anti").select("scope", "term")


def without_urls(text: Column) -> Column:
    """A text with a space in place of each url."""
    return F.regexp_replace(text, r"(?i)https?://\S+|www\.\S+", " ")


class Finder:
    """Places of a list of patterns, distinct and not empty, in bytes of UTF-8: by a gram of up to four bytes, then by the whole pattern."""

    def __init__(self, patterns: list[str]) -> None:
        self.bytes = [p.encode() for p in patterns]
        self.length = np.array([len(p) for p in self.bytes], np.int64)
        self.tables = []
        grams = [self._grams(np.frombuffer(p, np.uint8), min(len(p), 4)) for p in self.bytes]
        shared = Counter((len(p) if len(p) < 4 else 4, int(g)) for p, own in zip(self.bytes, grams) for g in set(own.tolist()))
        best = [min((shared[min(len(p), 4), int(g)], a, int(g)) for a, g in enumerate(own)) for p, own in zip(self.bytes, grams)]
        for size in range(1, 5):
            own = np.array([i for i, p in enumerate(self.bytes) if min(len(p), 4) == size], np.int64)
            if len(own):
                gram, at = np.array([best[i][2] for i in own], np.uint32), np.array([best[i][1] for i in own], np.int64)
                order = np.argsort(gram, kind="stable")
                marks = np.zeros(1 << 16, bool)
                marks[self._mark(gram)] = True
                self.tables.append((size, marks, gram[order], own[order], at[order]))

    @staticmethod
    def _mark(gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)

    @staticmethod
    def _grams(data: np.ndarray, size: int) -> np.ndarray:
        n = max(len(data) - size + 1, 0)
        out = np.zeros(n, np.uint32)
        for k in range(size):
            out |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
        return out

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(begin, pattern)`` of all places in texts that stand one behind the other; none reaches over the end of a text."""
        begins, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, marks, gram, own, at in self.tables:
            grams = self._grams(data, size)
            hit = np.flatnonzero(marks[self._mark(grams)])
            lo, hi = np.searchsorted(gram, grams[hit], "left"), np.searchsorted(gram, grams[hit], "right")
            hit, lo, n = hit[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            begin, p = np.repeat(hit, n) - at[entry], own[entry]
            fits = (begin >= 0) & (begin + self.length[p] <= len(data))
            begin, p = begin[fits], p[fits]
            text = np.searchsorted(offsets, begin, "right")
            fits = begin + self.length[p] <= offsets[np.minimum(text, len(offsets) - 1)]
            begin, p = begin[fits], p[fits]
            order = np.argsort(p, kind="stable")
            begin, p = begin[order], p[order]
            ends = np.flatnonzero(np.diff(p)) + 1
            for b in np.split(begin, ends) if len(p) else []:
                i = p[0]
                p = p[len(b) :]
                for k, x in enumerate(self.bytes[i]):
                    b = b[data[b + k] == x]
                begins.append(b)
                which.append(np.full(len(b), i))
        return np.concatenate(begins), np.concatenate(which)


def _rewritten(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and their offsets with a space in place of spans: from the left, and of those that begin together the longest."""
    order = np.lexsort((-end, begin))
    begin, end = begin[order], end[order]
    first = np.append(True, begin[1:] > begin[:-1]) if len(begin) else np.zeros(0, bool)
    begin, end = begin[first], end[first]
    following, taken, i = np.searchsorted(begin, end).tolist(), [], 0
    while i < len(following):
        taken.append(i)
        i = following[i]
    begin, end = begin[taken], end[taken]
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, begin + 1, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    data = data.copy()
    data[begin] = 32
    return data[kept], np.append(0, np.cumsum(kept))[offsets]


def stripped(docs: DataFrame, key: str, text: Column, scope: Column, terms: DataFrame) -> DataFrame:
    """Rows ``(key, text, n_terms)``: each text with a space in place of the terms of its scope and of the scope ``ALL_SCOPE``.

    From the left the longest term goes first, so the result does not hang on the order of the terms. ``n_terms`` says how many distinct terms
    the text holds. A null text is an empty one. Up to ``BROADCAST_ROWS`` terms go to the tasks, each of which finds all of them in some texts at once, and
    no text is shuffled. With more of them ``key`` must tell the rows apart.
    """
    known = terms.where("term is not null and term <> '' and scope is not null").select("scope", "term").distinct().limit(BROADCAST_ROWS + 1).toArrow()
    if len(known) > BROADCAST_ROWS:
        return _stripped_by_joins(docs, key, text, scope, terms)
    patterns = sorted(set(known["term"].to_pylist()))
    number, scopes = {p: i for i, p in enumerate(patterns)}, sorted(set(known["scope"].to_pylist()) - {C.ALL_SCOPE})
    held = np.zeros((len(scopes) + 1, len(patterns)), bool)
    for s, t in zip(known["scope"].to_pylist(), known["term"].to_pylist()):
        held[scopes.index(s) if s != C.ALL_SCOPE else slice(None), number[t]] = True
    shared = docs.sparkSession.sparkContext.broadcast((Finder(patterns), scopes, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, scopes, held = shared.value
        for b in slices(batches, "text"):
            data, offsets = utf8(b["text"])
            begin, p = finder.places(data, offsets)
            own = np.asarray(pa.compute.index_in(b["scope"], value_set=pa.array(scopes, pa.string()), skip_nulls=True).fill_null(len(scopes)), np.int64)
            row = np.searchsorted(offsets, begin, "right") - 1
            fits = held[own[row], p]
            begin, p, row = begin[fits], p[fits], row[fits]
            n = np.bincount(np.unique(row * max(len(held[0]), 1) + p) // max(len(held[0]), 1), minlength=b.num_rows)
            data, offsets = _rewritten(data, offsets, begin, begin + finder.length[p])
            new = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b["key"], new, pa.array(n, pa.int64())], names=["key", "text", "n_terms"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), scope.cast("string").alias("scope"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text string, n_terms bigint").withColumnRenamed("key", key)


def _stripped_by_joins(docs: DataFrame, key: str, text: Column, scope: Column, terms: DataFrame) -> DataFrame:
    """The same with any number of terms. Only texts that hold any are rewritten, with these terms alone."""
    d = docs.select(F.col(key), F.coalesce(text, F.lit("")).alias("_text"), scope.alias("_scope"))
    held = occurrences(d, key, "_text", terms, "term").select(key, F.col("pattern").alias("term")).distinct()
    held = held.join(d.select(key, "_scope"), key).join(terms, "term").where((F.col("scope") == F.col("_scope")) | (F.col("scope") == C.ALL_SCOPE)).select(key, "term").distinct()
    quoted = F.regexp_replace("term", r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    pattern = held.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.length("term").alias("n"), quoted.alias("q"))), asc=False).alias("t"))
    pattern = pattern.select(key, F.size("t").alias("_n"), F.array_join(F.transform("t", lambda x: x["q"]), "|").alias("_pattern"))
    out = d.join(pattern, key, "left")
    new = F.when(F.col("_pattern").isNull(), F.col("_text")).otherwise(F.regexp_replace("_text", F.col("_pattern"), F.lit(" ")))
    return out.select(key, new.alias("text"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_terms"))
