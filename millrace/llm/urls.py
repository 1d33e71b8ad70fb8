"""URL filter: prefix rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on a small table of labelled URLs (``MAX_LABELLED`` rows at most) on the driver, and
its weights, of fixed size, go to the tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cells of the hashed n-grams, and lengths of these.
CELLS, GRAMS = 1 << 18, (3, 4, 5)
#: Rows of the labelled table, at most.
MAX_LABELLED = 10_000
ROUNDS, RATE, RIDGE = 400, 2.0, 1e-3
#: A url is blocked from this score on.
THRESHOLD = 0.6

#: Host, path, verdict. The longest rule that fits wins.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: The default labelled table: a label, 1 for unwanted, a tab and a url in each line. Written by hand for this library, about
#: real kinds of sites in five languages under invented names; 100 urls of each label, each with a host of its own.
LABELLED = Path(__file__).with_name("labelled_urls.tsv")


def default_labelled() -> list[tuple[str, int]]:
    """The small labelled table, read on the driver."""
    return [(url, int(label)) for label, url in (line.split("\t") for line in LABELLED.read_text().splitlines())]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def grams(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of each url, and the row of each. Host and path have n-grams of their own."""
    texts = pa.compute.binary_join_element_wise("\x02", pa.compute.fill_null(host, ""), "\x03", pa.compute.fill_null(path, ""), "\x04", "")
    data, offsets = W.utf8(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    end = offsets[1:][row]
    marks = np.flatnonzero(data == 3)
    border = np.full(len(texts), len(data), np.int64)
    border[row[marks[::-1]]] = marks[::-1]  # the first of each row
    in_path = np.arange(len(data)) >= border[row]
    byte, cells, rows = W.mix(data.astype(np.uint64) + np.uint64(1)), [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for t in range(n):
            h += byte[t : t + len(h)] * np.uint64(pow(0x9E3779B97F4A7C15, t + 1, 1 << 64))
        ok = np.flatnonzero(np.arange(len(h)) + n <= end[: len(h)])
        cells.append((W.mix(h[ok] + in_path[ok].astype(np.uint64) + np.uint64(n * 2)) % np.uint64(CELLS)).astype(np.int64))
        rows.append(row[ok])
    return np.concatenate(cells), np.concatenate(rows)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        cell, row = grams(host, path)
        n = np.bincount(row, minlength=len(host))
        z = np.bincount(row, self.weights[cell], minlength=len(host)) / np.sqrt(np.maximum(n, 1))
        return 1 / (1 + np.exp(-(z + self.bias)))


def fit(labelled: DataFrame, url: str = "url", label: str = "label") -> Model:
    """Gradient descent on the whole labelled table; null urls or labels are left out."""
    host, path = host_and_path(F.col(url))
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(host.alias("h"), path.alias("p"), F.col(label).cast("int").alias("y"))
    rows = sorted(rows.limit(MAX_LABELLED + 1).collect())
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    w, bias = np.zeros(CELLS), 0.0
    if rows:
        y = np.array([r.y for r in rows], float)
        cell, row = grams(pa.array([r.h for r in rows]), pa.array([r.p for r in rows]))
        share = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(rows)), 1))[row]
        for _ in range(ROUNDS):
            z = np.bincount(row, w[cell] * share, minlength=len(rows)) + bias
            off = 1 / (1 + np.exp(-z)) - y
            w -= RATE * (np.bincount(cell, off[row] * share, minlength=CELLS) / len(rows) * 10 + RIDGE * w)
            bias -= RATE * off.mean()
    return Model(w, bias)


def filter_urls(
    pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] | None = None, labelled: DataFrame | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Rows ``(key, host, path, rule, score, verdict)``, one per row of ``pages``.

    ``rule`` is null where no rule fits; then the model's score decides. A null url and one without ``://``
    have an empty host and path, which are scored as such. Repeated rows each get their row; other columns are not read.
    """
    spark = pages.sparkSession
    table = labelled if labelled is not None else spark.createDataFrame(default_labelled(), "url string, label int")
    model = spark.sparkContext.broadcast(fit(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(batch["host"].cast(pa.string()), batch["path"].cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["path"], pa.array(score, pa.float64())], names=["id", "host", "path", "score"])

    host, path = host_and_path(F.col(url))
    found = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"))
    found = found.mapInArrow(run, f"id {pages.schema[key].dataType.simpleString()}, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return found.select(F.col("id").alias(key), "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, own).alias("verdict"))
