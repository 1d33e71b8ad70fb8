"""License marks in texts by an ordered table of rules, in DataFrame functions.

Each rule is a regular expression over words, written by hand, with words that any match of it holds, a label and a priority.
A text is cut into words once. Only texts with the first key of some rule are looked at further, and in these only
rules all of whose keys stand in the text are tried. What the rules find are intervals of words. One that lies
within another of the same or a higher priority is suppressed; of equal ones that of the higher priority stays, then that of the
earlier rule. Everything happens within a row, so nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What parts words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that always count, whatever else is found, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The table of rules; and how far a mark of priority 1, 2, 3 or 4 tells a license.
RULES, WEIGHTS = Path(__file__).with_name("license_rules.tsv"), (0.4, 0.7, 0.9, 1.0)
#: Marks around a match. No text has them, as they part words.
OPEN, CLOSE = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    """Each word of ``pattern`` stands behind a space; all ``keys`` are in whatever it matches, the first being the rarest."""

    label: str
    priority: int
    keys: tuple[str, ...]
    pattern: str

    @property
    def spaced(self) -> str:
        """The pattern for texts in which each word has a space of its own on either side."""
        return f" ({self.pattern.replace(' ', '  ')}) "


@cache
def rules(path: str = str(RULES)) -> tuple[Rule, ...]:
    """The rules of a table with the columns label, priority, keys and pattern, on the driver; some hundreds."""
    with open(path, encoding="utf-8", newline="") as f:
        return tuple(Rule(r["label"], int(r["priority"]), tuple(r["keys"].split()), r["pattern"]) for r in csv.DictReader(f, delimiter="\t"))


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def _once(x: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def places(spaced: Column, pattern: Column) -> Column:
    """``(start, end)`` of all matches, counted in words: the first and the last word of each are marked, and the marks' places are read off."""
    marked = F.regexp_replace(spaced, pattern, F.lit(f" {OPEN}$1{CLOSE} "))

    def read(w: Column) -> Column:
        starts = F.filter(F.transform(w, lambda x, i: F.when(x.startswith(OPEN), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(w, lambda x, i: F.when(x.endswith(CLOSE), i + 1)), lambda i: i.isNotNull())
        return F.arrays_zip(starts.alias("start"), ends.alias("end"))

    return _once(F.split(F.trim(marked), "  ", -1), read)


def scan(w: Column, table: tuple[Rule, ...]) -> Column:
    """A struct of what the words ``w`` of a text hold: base places, their labels, and all detections in order."""
    leads = F.array(*[F.lit(k) for k in sorted({r.keys[0] for r in table} | {p.split()[0] for p in BASE})])
    keys = F.array(*[F.lit(k) for k in sorted({k for r in table for k in r.keys})])
    listed = F.array(
        *[F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.array(*map(F.lit, r.keys)).alias("keys"), F.lit(r.spaced).alias("pattern")) for i, r in enumerate(table)]
    )
    spaced = F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))

    def tried(own: Column, text: Column) -> Column:
        fits = F.filter(listed, lambda r: (F.size(F.array_except(r["keys"], own)) == 0) & F.regexp_like(text, r["pattern"]))
        spans = lambda r: F.transform(places(text, r["pattern"]), lambda x: F.struct(x["start"], (-x["end"]).alias("end"), (-r["priority"]).alias("priority"), r["rule"], r["label"]))
        return F.sort_array(F.flatten(F.transform(fits, spans)))

    def base(text: Column) -> Column:
        each = [places(text, F.lit(f" ({p.replace(' ', '  ')}) ")) for p in BASE]
        return F.array(*[F.struct(F.lit(label).alias("label"), F.transform(x, lambda s: s["start"]).alias("starts")) for label, x in zip(BASE.values(), each)])

    found = _once(spaced, lambda text: F.struct(base(text).alias("base"), _once(F.array_intersect(w, keys), lambda own: tried(own, text)).alias("spans")))
    return F.when(F.arrays_overlap(w, leads), found)


def verdict(spans: Column) -> Column:
    """Labels that are left of the ordered ``spans``, and the weight of the strongest.

    Of the spans so far the furthest end is kept for each priority or a higher one; a span that ends no later lies within one of them.
    """
    none = F.struct(*[F.lit(0).alias(f"m{p}") for p in range(1, 5)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    weights = F.array(*map(F.lit, WEIGHTS))

    def step(s: Column, x: Column) -> Column:
        p, end = -x["priority"], -x["end"]
        left = F.element_at(F.array(*[s[f"m{k}"] for k in range(1, 5)]), p) < end
        reach = [F.when(p >= k, F.greatest(s[f"m{k}"], end)).otherwise(s[f"m{k}"]).alias(f"m{k}") for k in range(1, 5)]
        labels = F.when(left, F.array_union(s["labels"], F.array(x["label"]))).otherwise(s["labels"])
        return F.struct(*reach, labels.alias("labels"), F.when(left, F.greatest(s["score"], F.element_at(weights, p))).otherwise(s["score"]).alias("score"))

    return F.aggregate(spans, none, step, lambda s: F.struct(s["labels"], s["score"]))


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", table: tuple[Rule, ...] | None = None) -> DataFrame:
    """For each row its words, places of the base phrases, labels and score, and ``spans``: all detections before suppression.

    Rows: key, n_words, n_base, first_word and last_word (null without a base place), base_labels, labels, score (0 without a mark), spans
    (in order; ``end`` and ``priority`` are negative there, so that longer and stronger ones come first; null where no rule's first key
    stands in the text). A null text is an empty one; a null key is kept. Rows that repeat each get their row; other columns are not read.
    """
    table = table or rules()
    # A lambda over an array of one cuts the words once, wherever the optimizer puts the expression.
    seen = docs.select(F.col(key), _once(words(F.col(text)), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), scan(w, table).alias("found"))).alias("x"))
    starts = F.flatten(F.transform("x.found.base", lambda b: b["starts"]))
    own = F.transform(F.filter("x.found.base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"])
    none = F.array().cast("array<string>")
    told = F.when(F.size("x.found.spans") > 0, verdict(F.col("x.found.spans")))
    seen = seen.select(key, "x.n_words", F.col("x.found.spans").alias("spans"), starts.alias("starts"), F.coalesce(own, none).alias("own"), told.alias("told"))
    comma = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return seen.select(
        key,
        "n_words",
        F.greatest(F.size("starts"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"),
        F.array_max("starts").cast("bigint").alias("last_word"),
        comma(F.col("own")).alias("base_labels"),
        comma(F.concat("own", F.coalesce("told.labels", none))).alias("labels"),
        F.coalesce("told.score", F.lit(0.0)).alias("score"),
        "spans",
    )


def surviving(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``(key, start, end, label, priority)`` of detections that nothing suppresses. ``key`` must tell the rows of ``found`` apart."""
    d = found.select(key, F.explode("spans").alias("s")).select(key, "s.start", (-F.col("s.end")).alias("end"), "s.rule", "s.label", (-F.col("s.priority")).alias("priority"))
    before = Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.array(*[F.coalesce(F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before), F.lit(0)) for p in range(1, 5)])
    return d.withColumn("_reach", reach).where(F.element_at("_reach", F.col("priority")) < F.col("end")).drop("_reach", "rule")
