"""Benchmark decontamination by winnowing.

Of every 7 consecutive hashes of 7-word grams the smallest (the last of equals) is kept as a
fingerprint, in documents and items alike. Any 13 consecutive words hold one such run of hashes,
so equal 13-word windows keep equal fingerprints: no shared span of 13 words can be missed.
Fingerprints are joined, and each hit is extended over the words on its diagonal; only runs that
hold a whole window count. Items of fewer words are one window, found by a hash of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

WINDOW, GRAM = 13, 7
#: A sorted list of up to so many benchmark fingerprints (16 MB) is sent to the scan of documents, which
#: then drops fingerprints that no item has. A larger benchmark is joined without it.
FILTER_ROWS = 1 << 21


def _gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive word hashes, different for every ``k``."""
    out = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for t in range(k):
        out += h[t : t + len(out)] * np.uint64(pow(0xD1342543DE82EF95, t + 1, 1 << 64))
    return W.mix(out + np.uint64(k))


def _inside(found: W.Words, length: int, k: int) -> np.ndarray:
    """Whether ``k`` items that begin here all lie in one text; for ``length`` begins."""
    ok = np.ones(length, bool)
    for e in found.first[1:-1]:
        ok[max(e - k + 1, 0) : e] = False
    return ok


def winnowed(found: W.Words) -> np.ndarray:
    """Where the kept grams begin, over the words of all texts."""
    grams = _gram_hashes(found.hash, GRAM)
    width = WINDOW - GRAM + 1
    n = max(len(grams) - width + 1, 0)
    best, at = grams[:n].copy(), np.arange(n)
    for t in range(1, width):
        lower = grams[t : t + n] <= best
        best[lower] = grams[t : t + n][lower]
        at[lower] = np.flatnonzero(lower) + t
    return np.unique(at[_inside(found, n, WINDOW)])


def _scan(id_: str, text: str, short: list[int], whole: bool, known):
    """Fingerprints of each text. whole: short texts are items, and so have one of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = known.value if known else None
        for batch in W.slices(batches, text):
            found = W.words(batch[text], W.ALNUM)
            at = winnowed(found)
            prints, places = [_gram_hashes(found.hash, GRAM)[at]], [at]
            for k in short:
                own = _gram_hashes(found.hash, k)
                ok = np.flatnonzero(_inside(found, len(own), k))
                if whole:
                    ok = np.intersect1d(ok, found.first[:-1][found.count == k])
                # not a gram of the kind above
                prints.append(W.mix(own[ok] + np.uint64(1)))
                places.append(ok)
            prints, places = np.concatenate(prints), np.concatenate(places)
            if keep is not None:
                hit = keep[np.minimum(np.searchsorted(keep, prints), len(keep) - 1)] == prints if len(keep) else np.zeros(len(prints), bool)
                prints, places = prints[hit], places[hit]
            order = np.argsort(places, kind="stable")
            prints, places = prints[order], places[order]
            cut = np.searchsorted(places, found.first).astype(np.int32)
            texts = len(batch)
            own = [found.hash[found.first[i] : found.first[i + 1]] for i in range(texts)]
            local = places - np.repeat(found.first[:-1], np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    batch[id_],
                    pa.array(found.count, pa.int64()),
                    pa.array([int(W.mix(x + np.arange(len(x), dtype=np.uint64)).sum(dtype=np.uint64).astype(np.int64)) for x in own], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(prints.view(np.int64), pa.int64())),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(local, pa.int32())),
                    pa.array([own[i].tobytes() if cut[i] < cut[i + 1] else None for i in range(texts)], pa.binary()),
                ],
                names=["id", "n_words", "digest", "prints", "places", "words"],
            )

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal words on each diagonal that hold a whole window of the item."""
    for batch in batches:
        row, lo, hi = [], [], []
        for i, (seg, item, begin) in enumerate(zip(batch["segment"], batch["item_words"], batch["begin"])):
            item = np.frombuffer(item.as_py(), np.uint64)
            seg, skip = np.frombuffer(seg.as_py(), np.uint64), max(0, -begin.as_py())
            same = np.zeros(len(seg) + 2, np.int8)
            same[1:-1] = seg == item[skip : skip + len(seg)]
            edge = np.diff(same)
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            long = last - first >= min(WINDOW, len(item))
            row += [i] * int(long.sum())
            lo += (first[long] + max(0, begin.as_py())).tolist()
            hi += (last[long] + max(0, begin.as_py())).tolist()
        out = batch.select(["id", "digest", "item_id"]).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["id", "digest", "item_id", "lo", "hi"])


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows ``(key, n_words, n_hit, n_items, items_sha256, contaminated, items, spans)``, one per row of ``docs``.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. ``spans`` are the
    hit word ranges, end exclusive, merged. A null or empty text has no words and is not contaminated.
    Null items, items without words and items with a null id find nothing; rows that repeat an item count once.
    Repeated rows of ``docs`` each get their own row. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "winnow")
    kind = docs.schema[key].dataType.simpleString()
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    items = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("string").alias("id"), F.col(item_text).alias("text")).distinct()
    schema = "id {}, n_words bigint, digest bigint, prints array<bigint>, places array<int>, words binary"
    tested = scratch.table(items.mapInArrow(_scan("id", "text", list(range(1, WINDOW)), True, None), schema.format("string")), "items")
    short = sorted(r.n_words for r in tested.where(f"n_words between 1 and {WINDOW - 1}").select("n_words").distinct().collect())
    prints = tested.select(F.col("id").alias("item_id"), F.col("digest").alias("item_digest"), F.explode(F.arrays_zip("prints", "places")).alias("p"))
    prints = prints.select("item_id", "item_digest", F.col("p.prints").alias("print"), F.col("p.places").alias("item_at"))
    known = None
    unique = prints.select("print").distinct()
    if unique.count() <= FILTER_ROWS:
        known = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in unique.collect()], np.int64).view(np.uint64)))

    scanned = scratch.table(docs.mapInArrow(_scan("id", "text", short, False, known), schema.format(kind)), "documents")
    hits = scanned.where(F.size("prints") > 0).select("id", "digest", "words", F.explode(F.arrays_zip("prints", "places")).alias("p"))
    hits = hits.select("id", "digest", "words", F.col("p.prints").alias("print"), F.col("p.places").alias("at"))
    pairs = hits.join(prints, "print").withColumn("begin", F.col("at") - F.col("item_at"))
    own = tested.select(F.col("id").alias("item_id"), F.col("digest").alias("item_digest"), F.col("words").alias("item_words"))
    pairs = pairs.join(own, ["item_id", "item_digest"])
    # Of the document only the words beside the item's are passed on.
    length = F.length("item_words") + F.lit(8) * F.least(F.lit(0), F.col("begin"))
    segment = F.substring(F.col("words"), F.lit(8) * F.greatest(F.lit(0), F.col("begin")) + 1, length.cast("int"))
    pairs = pairs.select("id", "digest", "item_id", "begin", segment.alias("segment"), "item_words").distinct()
    runs = pairs.mapInArrow(_extend, f"id {kind}, digest bigint, item_id string, lo bigint, hi bigint")
    runs = runs.groupBy("id", "digest").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    merged = F.aggregate(
        "runs",
        F.array().cast("array<struct<lo:bigint,hi:bigint>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["hi"] >= r["lo"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["lo"].alias("lo"), F.greatest(F.element_at(done, -1)["hi"], r["hi"]).alias("hi"))),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )
    runs = runs.select(F.col("id").alias("run_id"), F.col("digest").alias("run_digest"), "items", merged.alias("spans"))
    out = scanned.select("id", "digest", "n_words").join(runs, F.col("id").eqNullSafe(F.col("run_id")) & (F.col("digest") == F.col("run_digest")), "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, r: t + r["hi"] - r["lo"]), F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select(F.col("id").alias(key), "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), items.alias("items"), "spans")
    return out.select(key, "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "spans")
