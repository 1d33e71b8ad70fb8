"""Packing token sequences by cutting-stock column generation.

Documents longer than a sequence give whole sequences and a rest. The histogram of the rests, at
most ``size - 1`` lengths, is packed by a linear program over patterns. New patterns come from a
knapsack dynamic program at the current prices. Rounded down, the patterns are dealt to the
documents by their rank among those of equal length. What rounding leaves, and what the program put into no
pattern, is laid end to end and cut where sequences end.

The driver sees the histogram and the patterns, whose size does not depend on the corpus. Ranks are
counted per length and per hash part of the documents, so that no length meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch
from .tokens import encoder, width

#: Rows of one hash part in which documents are ranked.
PART_ROWS = 20_000
#: Column generation ends this close to no padding at all, or after so many columns. What the LP has not put
#: into patterns by then is cut at the ends of sequences, so no id is lost and no padding is added.
GAP, COLUMNS = 0.001, 2000
#: Knapsacks solved at one set of prices, each with a bonus for long pieces of up to ``BONUS`` of a sequence's price, and patterns tried of these.
KNAPSACKS, BONUS, TRIED = 8, 0.5, 128
#: What cutting a piece costs, as a share of its length.
CUT_PRICE = 0.05


def _knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``prices``: best total price of pieces that sum to each length exactly, and the last piece used."""
    rows = np.arange(len(prices))
    best, last = np.full((len(prices), size + 1), -np.inf), np.full((len(prices), size + 1), -1)
    best[:, 0] = 0
    upto = np.searchsorted(lengths, np.arange(size + 1), "right")
    for s in range(lengths[0], size + 1):
        value = best[:, s - lengths[: upto[s]]] + prices[:, : upto[s]]
        i = value.argmax(1)
        best[:, s], last[:, s] = value[rows, i], i
    return best, last


def patterns(demand: np.ndarray, size: int, report: dict | None = None) -> list[tuple[int, np.ndarray]]:
    """Patterns and how often each is used, for ``demand[length]`` pieces of each length below ``size``.

    Column generation for the cutting-stock LP. It begins with the trivial columns of one piece each, which
    stand for pieces in no pattern and cost their length and ``CUT_PRICE`` of it, as these are laid end to end and probably cut.
    Every other column comes from the knapsack: at the current prices of the pieces, the best pattern
    through each length. Of the many that are equally good at first, a random bonus prefers those of few long pieces,
    which leaves the short ones to fill gaps; whether a column enters is decided by the prices alone.
    The simplex method has an explicit inverse. Returns ``(copies, counts by length)``; together they
    never use more pieces than there are. ``report`` is given the number of priced columns and the LP's cost as a multiple of its
    lower bound, sequences without any padding.
    """
    lengths = np.flatnonzero(demand)
    if not len(lengths):
        return []
    need, m, random = demand[lengths].astype(float), len(lengths), np.random.default_rng(1)
    loose = lengths / size * (1 + CUT_PRICE)
    columns, cost, inverse, x, prices = np.eye(m), loose.copy(), np.eye(m), need.copy(), loose.copy()
    floor, used, bonus = need @ lengths / size, 0, BONUS

    def enter(new: np.ndarray, price: float) -> bool:
        nonlocal prices, x, used
        gain = prices @ new - price
        if gain <= 1e-9:
            return False
        step = inverse @ new
        ok = np.flatnonzero(step > 1e-9)
        if not len(ok):
            return False
        out = ok[np.argmin(x[ok] / step[ok])]
        row = inverse[out] / step[out]
        take = x[out] / step[out]
        rows = np.flatnonzero(step)
        inverse[rows] -= step[rows, None] * row
        inverse[out] = row
        prices = prices - gain * row
        x = np.maximum(x - take * step, 0)
        x[out] = take
        columns[:, out], cost[out], used = new, price, used + 1
        return True

    while used < COLUMNS and cost @ x > floor * (1 + GAP) and bonus > 1e-4:
        best, last = _knapsack(lengths, prices + (lengths / size) ** 2 * bonus * random.random((KNAPSACKS, m)), size)
        entered = False
        alone = (columns.sum(0) == 1) & (np.abs(cost - loose @ columns) < 1e-12)
        left = np.zeros(m)
        left[columns.argmax(0)[alone]] = x[alone]
        for k, i in enumerate(np.argsort(-(left + 1e-3) * lengths, kind="stable")[:TRIED]):
            row, at = k % KNAPSACKS, size - lengths[i]
            if best[row, at] < 0:
                continue
            new = np.zeros(m)
            new[i] = 1
            while at:
                new[last[row, at]] += 1
                at -= lengths[last[row, at]]
            entered |= enter(new, 1.0)
        for i in np.flatnonzero(prices > loose + 1e-9):
            enter(np.eye(1, m, i)[0], float(loose[i]))
        bonus = bonus if entered else bonus / 4
    if report is not None:
        report |= {"priced": used, "cost": float(cost @ x / floor)}
    columns = np.rint(columns).astype(np.int64)
    pattern = np.abs(cost - loose @ columns) > 1e-12
    copies = np.where(pattern, np.floor(x + 1e-6).astype(np.int64), 0)
    left = demand[lengths] - columns @ copies
    for j in np.flatnonzero(copies):  # never more than there is, whatever the arithmetic
        while copies[j] and (left[columns[:, j] > 0] < 0).any():
            copies[j] -= 1
            left = left + columns[:, j]
    for j in np.argsort(copies - x, kind="stable"):  # rounded up where pieces are left for it
        if pattern[j] and (left >= columns[:, j]).all():
            copies[j] += 1
            left = left - columns[:, j]
    out = []
    for j in np.flatnonzero(copies):
        counts = np.zeros(size, np.int64)
        counts[lengths] = columns[:, j]
        out.append((int(copies[j]), counts))
    return out


class Plan:
    """Where the piece of a given length and rank goes. Built from the histogram alone."""

    def __init__(self, demand: np.ndarray, n_whole: int, size: int) -> None:
        self.size, used, self.report = size, np.zeros(size, np.int64), {}
        entries: list[list[tuple[int, int, int, int]]] = [[] for _ in range(size)]
        sequence = 0
        for copies, counts in patterns(demand, size, self.report):
            offset = 0
            for length in np.flatnonzero(counts):
                a = int(counts[length])
                entries[length].append((int(used[length]), a, sequence, offset))
                used[length] += copies * a
                offset += a * int(length)
            sequence += copies
        self.entries = [np.array(e, np.int64).reshape(-1, 4) for e in entries]
        self.used, self.whole = used, sequence
        self.rest = sequence + n_whole
        rest = (demand - used) * np.arange(size)
        self.base = np.cumsum(rest) - rest
        total = int(rest.sum())
        # The last sequences hold a power of two each, which needs no padding.
        cuts = list(range(0, total - total % size + 1, size))
        left, power = total % size, size
        while left:
            power //= 2
            if left & power:
                cuts.append(cuts[-1] + power)
                left -= power
        self.tail = np.array(cuts[total // size :], np.int64)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """``(length, sequence, offset)`` of the parts of a piece shorter than a sequence."""
        if rank < self.used[length]:
            e = self.entries[length]
            start, a, sequence, offset = e[np.searchsorted(e[:, 0], rank, "right") - 1]
            return [(length, int(sequence + (rank - start) // a), int(offset + (rank - start) % a * length))]
        at, out = int(self.base[length] + (rank - self.used[length]) * length), []
        while length:
            if at < self.tail[0]:
                number, begin, end = at // self.size, at // self.size * self.size, (at // self.size + 1) * self.size
            else:
                i = int(np.searchsorted(self.tail, at, "right")) - 1
                number, begin, end = int(self.tail[0]) // self.size + i, int(self.tail[i]), int(self.tail[i + 1])
            part = min(length, end - at)
            out.append((part, self.rest + number, at - begin))
            at, length = at + part, length - part
        return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces ``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])`` of all documents.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers. Each id of a document, its end
    id included, is in exactly one piece. A null or empty text is its end id alone. Rows that repeat a key are
    documents of their own, also when their texts are equal. Null keys are kept. Other columns are not read.
    ``size`` must be a power of two. Sequence numbers begin at 0 without gaps.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, narrow = encoder(path, True), width(path)
        number = TaskContext.get().partitionId() << 40
        for batch in W.slices(batches, "text", 2 << 20):
            ids, first = tool.encode(batch["text"])
            own = [np.append(ids[a:b], end_id).astype(narrow) for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(number, number + len(own)), pa.int64()), batch["id"], pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())],
                names=["row", "id", "n", "ids"],
            )
            number += len(own)

    # Rows are numbered as they are written; from then on the numbers are data and don't change.
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    encoded = scratch.table(source.mapInArrow(encode, f"row bigint, id {kind}, n bigint, ids binary"), "encoded")
    parts = max(16, encoded.count() // PART_ROWS)
    light = encoded.select("row", (F.col("n") % size).alias("rest"), F.expr(f"n div {size}").alias("whole"))
    light = scratch.table(light.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))), "lengths")
    demand = np.zeros(size, np.int64)
    n_whole = 0
    for r in light.groupBy("rest").agg(F.count("*").alias("k"), F.sum("whole").alias("w")).collect():
        demand[r.rest], n_whole = r.k, n_whole + r.w
    demand[0] = 0
    plan = spark.sparkContext.broadcast(Plan(demand, n_whole, size))

    inside = Window.partitionBy("part", "rest").orderBy("row")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = light.groupBy("rest", "part").agg(F.count("*").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    ranked = light.withColumn("rank", F.row_number().over(inside) - 1).join(bases, ["rest", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base")
    one = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wholes = light.groupBy("part").agg(F.sum("whole").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(one), F.lit(0))).drop("k")
    earlier = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("first", F.coalesce(F.sum("whole").over(earlier), F.lit(0))).join(wholes, "part")
    ranked = ranked.select("row", "rank", (F.col("first") + F.col("base")).alias("first"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, narrow = plan.value, width(path)
        names = ["row", "start", "length", "crc", "n", "sequence", "offset", "piece"]
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}

            def put(i: int, ids: np.ndarray, start: int, length: int, sequence: int, offset: int) -> None:
                piece = ids[start : start + length].tobytes()
                for c, v in zip(names, (i, start, length, zlib.crc32(piece), len(ids), sequence, offset, piece if with_ids else None)):
                    out[c].append(v)

            for i, (ids, rank, first) in enumerate(zip(batch["ids"], batch["rank"].to_pylist(), batch["first"].to_pylist())):
                ids = np.frombuffer(ids.as_py(), narrow).astype("<u4")
                start = len(ids) // size * size
                for k in range(len(ids) // size):
                    put(i, ids, k * size, size, at.whole + first + k, 0)
                for length, sequence, offset in at.place(len(ids) - start, rank) if start < len(ids) else ():
                    put(i, ids, start, length, sequence, offset)
                    start += length
            kinds = [pa.int64()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(out["row"], pa.int64())), *[pa.array(out[c], t) for c, t in zip(names[1:7], kinds)], pa.array(out["piece"], pa.binary())],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    # Ids and ranks meet by a shuffle at every size; ranks are as many as documents, and so no table to broadcast.
    both = encoded.select("row", "id", "ids").join(ranked.hint("merge"), "row").select("id", "ids", "rank", "first")
    pieces = both.mapInArrow(cut, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    pieces = pieces.withColumnRenamed("id", key)
    return pieces if with_ids else pieces.drop("ids")
