"""Exact similarity join of word-shingle sets, with an R-tree over count vectors as its filter.

Every document's set of shingles becomes (a) a point: the counts of its shingles in hashed groups,
and (b) a prefix: its rarest shingles, as many as a similar set cannot avoid. Rows that share a
prefix shingle meet; this only decides which part of the index a search visits. In there the
summed coordinate minima of points and boxes bound the overlap, and pairs that survive are
verified on their full sets.

Links are not expanded inside groups that are connected already: first every set is compared with
the smallest document of each prefix shingle; what is still apart from it is then searched against
all rows of the shingle. So a group of thousands of near copies costs a few comparisons a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .counts import cell_counts
from .links import components
from .rtree import RTree, needed
from .scratch import Scratch

#: Cells of the table of shingle counts that orders shingles by rarity.
CELLS = 1 << 23
#: Coordinates of a point, and the largest count that one holds, in a byte. What is beyond it is summed up beside the point.
GROUPS, MOST = 128, 127
#: Rounds of comparing each document with the smallest one that it shares a prefix shingle with.
ROUNDS = 2
#: Rows of one shingle that one search has in its tree, and as many that it searches for; a shingle with more is dealt over several.
INDEX_ROWS = 4096
#: Rows of one group of a search, on the average: some MB of Arrow, of which a worker holds a few copies.
TASK_ROWS = 16_384
#: Bits of the map of documents whose sets are verified: 2 MB at any size of the corpus.
MAP_BITS = 1 << 24


def _sets(batch: pa.RecordBatch, text: str, k: int) -> Iterator[np.ndarray]:
    runs, first = W.shingles(W.words(batch[text], W.NOT_SPACE), k)
    for i in range(len(first) - 1):
        yield np.unique(runs[first[i] : first[i + 1]])


def shingle_counts(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Counts of all shingles of all documents in ``CELLS`` hashed cells, up to 65,535.

    The result has a fixed size of 16 MB. Counts only order the shingles: results do not depend on them.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in W.slices(batches, text):
            runs, _ = W.shingles(W.words(batch[text], W.NOT_SPACE), k)
            yield runs & np.uint64(CELLS - 1)

    return cell_counts(docs.select(text), cells, CELLS, "uint8", "uint16")


def signatures(docs: DataFrame, key: str, text: str, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """One row per document: size of its set, two hashes of the set, its point, how many members its point does not count, and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = f"id {docs.schema[key].dataType.simpleString()}, n int, h1 bigint, h2 bigint, point array<tinyint>, more int, prefix array<bigint>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in W.slices(batches, text):
            n, h1, h2, points, more, prefix = [], [], [], [], [], []
            for own in _sets(batch, text, k):
                n.append(len(own))
                mixed = W.mix(own)
                h1.append(mixed.sum(dtype=np.uint64).astype(np.int64))
                h2.append(np.bitwise_xor.reduce(W.mix(mixed + np.uint64(1)), initial=np.uint64(0)).astype(np.int64))
                points.append(np.minimum(np.bincount((own >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS), MOST).astype(np.int8))
                more.append(len(own) - points[-1].sum())
                order = np.lexsort((own, rarity[(own & np.uint64(CELLS - 1)).astype(np.int64)]))
                prefix.append(own[order[: len(own) - -(-percent * len(own) // 100) + (len(own) > 0)]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch[key], pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(points, pa.int8()), pa.array(more, pa.int32()), _lists(prefix, pa.int64())],
                names=["id", "n", "h1", "h2", "point", "more", "prefix"],
            )

    return docs.select(key, text).mapInArrow(sign, schema)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rows), kind))


def _search(percent: int):
    """Searches the rows of each shingle in the R-tree of that shingle's index rows."""

    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        a, b = [], []
        if len(probes) and len(index):
            p, q = (_columns(t) for t in (probes, index))
            ends = np.flatnonzero(np.diff(q["s"])) + 1
            for lo, hi in zip([0, *ends], [*ends, len(q["s"])]):
                i, j = np.searchsorted(p["s"], [q["s"][lo], q["s"][lo] + 1]) if q["s"][lo] < np.iinfo(np.int64).max else (np.searchsorted(p["s"], q["s"][lo]), len(p["s"]))
                if i == j:
                    continue
                tree = RTree(q["point"][lo:hi], q["more"][lo:hi], q["n"][lo:hi])
                for x in range(i, j):
                    found = lo + tree.search(p["point"][x], p["more"][x], p["n"][x], percent)
                    found = found[q["c"][found] != p["c"][x]]
                    # If this is the first shingle that both have, what follows it must suffice.
                    left = np.minimum(q["n"][found] - q["pos"][found], p["n"][x] - p["pos"][x])
                    found = found[left >= needed(q["n"][found], p["n"][x], percent)]
                    a.append(np.full(len(found), p["id"][x]))
                    b.append(q["id"][found])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    return run


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    table = table.sort_by("s")
    out = {k: table[k].to_numpy() for k in ("s", "id", "n", "c", "pos", "more")}
    return out | {"point": np.asarray(table["point"].combine_chunks().flatten()).reshape(-1, GROUPS)}


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs ``(a, b)`` of document keys whose full sets are similar.

    A bit map of fixed size says which documents any pair may need; only their sets are built,
    from a scan that shuffles no texts, and joined to both ends of the pairs.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    bits = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(bit.alias("bit"))
    bits = bits.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    held = np.zeros((MAP_BITS // 32768 + 1, 4096), np.uint8)
    for row in bits.collect():
        held[row.part] = np.frombuffer(row.bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(held)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            # bucket and position number from 1 and 0: see bitmap_bucket_number, bitmap_bit_position
            at = np.asarray(batch["bit"])
            part, place = np.where(at > 0, (at - 1) // 32768 + 1, at // 32768), np.where(at > 0, (at - 1) % 32768, -at % 32768)
            wanted = (bits[part, place // 8] >> (place % 8).astype(np.uint8)) & 1
            for own in W.slices(iter([batch.filter(pa.array(wanted.astype(bool)))]), text):
                yield pa.RecordBatch.from_arrays(
                    [own[key], pa.array([s.tobytes() for s in _sets(own, text, k)], pa.binary())], names=["id", "members"]
                )

    source = docs.select(key, text).withColumn("bit", F.pmod(F.xxhash64(key), F.lit(MAP_BITS)))
    sets = scratch.table(source.mapInArrow(build, "id bigint, members binary"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    ends = ends.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    return scratch.table(ends.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint"), "verified")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Rows ``(key, n_shingles, component_id)``, one per row of ``docs``.

    ``component_id`` is the smallest key reachable by links of ``percent`` similarity, itself included.
    A null or empty text, or one without words, has an empty set, no link and itself as component. A text of fewer
    than ``k`` words has one shingle. Rows with a null key take no part and have a null component;
    rows that repeat a key are compared by their texts, and all of a key share one component.
    Other columns of ``docs`` are not read, so their names may clash. ``key`` must be a whole number.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    repeated = docs.groupBy("id").count().where("id is not null and count > 1").limit(1).count()
    if repeated:
        return _similar_repeated(docs, key, k, percent, scratch)
    return _similar(docs, k, percent, scratch).select(F.col("id").alias(key), "n_shingles", "component_id")


def _similar_repeated(docs: DataFrame, key: str, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Rows get numbers of their own; rows of one key are linked besides."""
    number = F.xxhash64("id", F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("row")
    rows = scratch.table(docs.where("id is not null").distinct().select("id", "text", number), "numbered")
    found = _similar(rows.select(F.col("row").alias("id"), "text"), k, percent, scratch)
    found = scratch.table(rows.select("row", F.col("id").alias("k")).join(found.withColumnRenamed("id", "row"), "row"), "found")
    lowest = found.groupBy("component_id").agg(F.min("k").alias("low"))
    label = components(found.join(lowest, "component_id").select("k", "low"), "k", "low", scratch)
    out = docs.select("id", number)
    out = out.join(found.select("row", "n_shingles").distinct(), "row", "left").join(label, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _similar(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    counts = shingle_counts(docs, "text", k)
    signed = scratch.table(signatures(docs, "id", "text", k, percent, counts), "signed")
    classes = scratch.table(signed.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "classes")
    reps = scratch.table(signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "point", "more", "prefix"), "reps")
    sized = scratch.table(signed.select("id", "n", "h1", "h2"), "sized")
    scratch.drop(signed)

    # Rows of shingles that two sets or more have in their prefixes, with the smallest of these sets.
    rows = reps.select(F.posexplode("prefix").alias("pos", "s"), "id").repartition("s")
    shared = rows.groupBy("s").agg(F.count("*").alias("rows"), F.min("id").alias("leader")).where("rows > 1")
    rows = scratch.table(rows.join(shared, "s"), "rows")
    points = reps.select("id", "n", "point", "more")

    def bounded(pairs: DataFrame) -> DataFrame:
        x, y = (points.select(F.col("id").alias(v), F.col("n").alias(f"n_{v}"), F.col("point").alias(f"p_{v}"), F.col("more").alias(f"m_{v}")) for v in "ab")
        low = F.aggregate(F.zip_with("p_a", "p_b", lambda u, v: F.least(u, v)), F.least("m_a", "m_b"), lambda t, v: t + v)
        return pairs.join(x, "a").join(y, "b").where(low * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    def labelled(label: DataFrame) -> DataFrame:
        """Shingle rows with their component, and whether it is another one than the leader's."""
        out = rows.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
        lead = label.select(F.col("node").alias("leader"), F.col("component").alias("lead"))
        return out.join(lead, "leader", "left").withColumn("apart", F.col("c") != F.coalesce("lead", "leader"))

    tried = links = spark.createDataFrame([], "a bigint, b bigint")
    label = spark.createDataFrame([], "node bigint, component bigint")
    for _ in range(ROUNDS):
        nearest = labelled(label).where("apart").groupBy("id").agg(F.min("leader").alias("a"))
        pairs = scratch.table(bounded(nearest.select("a", F.col("id").alias("b"))).join(tried, ["a", "b"], "left_anti"), "pairs")
        links = links.union(verify(pairs, docs, "id", "text", k, percent, scratch))
        tried = tried.union(pairs)
        label = scratch.table(components(links, "a", "b", scratch), "label")

    # Shingles whose rows are not all connected: search what is apart from the leader among all of them.
    found = scratch.table(labelled(label).select("s", "id", "pos", "c", "apart", "rows"), "labelled")
    open_ = found.where("apart").groupBy("s").agg(F.count("*").alias("n_apart"))
    # Both the rows of a hot shingle and what is searched for among them are dealt over salts, and meet in a grid.
    salts = lambda n: F.ceil(F.col(n) / INDEX_ROWS).cast("int")
    found = found.join(open_, "s").join(points, "id").withColumns({"tall": salts("rows"), "wide": salts("n_apart")})
    found = scratch.table(found.select("s", "id", "pos", "c", "n", "point", "more", "apart", "tall", "wide"), "open")
    copies = found.agg(F.sum(F.col("wide") + F.when(F.col("apart"), F.col("tall")).otherwise(0))).first()[0] or 0
    tasks = max(1, copies // TASK_ROWS)
    cell = F.xxhash64("s", "i", "j")
    columns = [F.pmod(cell, F.lit(tasks)).alias("task"), cell.alias("s"), "id", "pos", "c", "n", "point", "more"]
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = found.withColumn("i", dealt("tall")).withColumn("j", every("wide")).select(columns)
    probes = found.where("apart").withColumn("j", dealt("wide")).withColumn("i", every("tall")).select(columns)
    pairs = probes.groupBy("task").cogroup(index.groupBy("task")).applyInArrow(_search(percent), "a bigint, b bigint").distinct()
    pairs = scratch.table(pairs.join(tried, ["a", "b"], "left_anti"), "searched")
    links = links.union(verify(pairs, docs, "id", "text", k, percent, scratch))
    label = scratch.table(components(links, "a", "b", scratch), "label")

    whole = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("low"))
    out = sized.join(whole, ["h1", "h2", "n"], "left")
    return out.select("id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))
