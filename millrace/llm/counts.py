"""Counts of hashed items of a whole table in a fixed number of cells, added up in a tree of Arrow groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Items counted at a time.
COUNTED = 1 << 21
#: Pieces of a table of counts, and tables that one group adds up. Three levels of groups do for 2**24 tasks.
PARTS, FAN, LEVELS = 64, 256, 3


def cell_counts(rows: DataFrame, items: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], cells: int, narrow: str, wide: str) -> np.ndarray:
    """How many items of ``rows`` fall into each of ``cells`` cells, for ordering things by their frequency.

    ``items`` gives the cells of the items in a task's batches. A task's counts stop at the largest ``narrow`` number,
    the sums at the largest ``wide`` one. A group never holds more than ``FAN`` pieces, so its size does
    not grow with the number of tasks.
    """
    width, most, top = cells // PARTS, np.iinfo(narrow).max, np.iinfo(wide).max

    def rows_of(total: np.ndarray, salt: int, kind: str) -> pa.RecordBatch:
        pieces = [c.astype(kind).tobytes() for c in total.reshape(PARTS, width)]
        return pa.RecordBatch.from_pydict({"part": np.arange(PARTS, dtype=np.int32), "salt": np.full(PARTS, salt, np.int32), "cells": pieces, "wide": np.zeros(PARTS, bool)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(cells, narrow), [], 0

        def put() -> None:
            cell, k = np.unique(np.concatenate(held), return_counts=True)
            total[cell] = np.minimum(total[cell] + k, most)
            held.clear()

        for own in items(batches):
            held.append(own.astype(np.uint32))
            n += len(own)
            if n >= COUNTED:
                put()
                n = 0
        if held:
            put()
        if total.any():
            yield rows_of(total, TaskContext.get().partitionId() // FAN, narrow)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for piece, is_wide in zip(table["cells"], table["wide"]):
            total += np.frombuffer(piece.as_py(), wide if is_wide.as_py() else narrow)
        total = np.minimum(total, top).astype(wide)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([key[1].as_py() // FAN], pa.int32()), "cells": [total.tobytes()], "wide": [True]})

    schema = "part int, salt int, cells binary, wide boolean"
    tables = rows.mapInArrow(count, schema)
    for _ in range(LEVELS):
        tables = tables.groupBy("part", "salt").applyInArrow(add, schema)
    # The driver holds one table of the ``wide`` kind and what it collects of it.
    out = np.zeros((PARTS, width), wide)
    for row in tables.select("part", "cells").collect():
        own = np.frombuffer(row.cells, wide)
        out[row.part] += np.minimum(own, top - out[row.part])
    return out.ravel()
