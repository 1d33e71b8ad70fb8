"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds one frame per document (its ids, little-endian), then one index frame, then the seek
table, a skippable frame in the public seekable format: for each frame its compressed size, its
size and the low 32 bits of the XXH64 of its content. A reader gets the table from the file's end,
the index, and then only the frames of the documents that it wants.

Index frame: number of documents and of null keys among them as unsigned 64-bit integers, then all keys
as signed 64-bit integers, then all token counts as unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch
from .tokens import encoder, width

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
LEVEL = 3


class Writer:
    """Writes frames to an open file and ends with the seek table."""

    def __init__(self, out) -> None:
        self.out, self.entries, self.packer = out, [], zstandard.ZstdCompressor(level=LEVEL)

    def frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.entries.append(struct.pack("<III", len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Reads single documents of a file; checks every frame that it reads."""

    def __init__(self, source, narrow: str) -> None:
        self.source, self.narrow, self.packer = source, narrow, zstandard.ZstdDecompressor()
        end = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        table = self._at(end - 9 - 12 * frames, 12 * frames)
        self.entries = np.frombuffer(table, "<u4").reshape(-1, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        index = self.frame(frames - 1)
        n, self.nulls = struct.unpack("<QQ", index[:16])
        self.keys = np.frombuffer(index, "<i8", n, 16)
        self.counts = np.frombuffer(index, "<u4", n, 16 + 8 * n)

    def _at(self, begin: int, size: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(size)

    def frame(self, i: int) -> bytes:
        content = self.packer.decompress(self._at(int(self.begin[i]), int(self.entries[i, 0])), max_output_size=int(self.entries[i, 1]))
        if len(content) != self.entries[i, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.entries[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return content

    def document(self, i: int) -> np.ndarray:
        return np.frombuffer(self.frame(i), self.narrow).astype("<u4")


def write(docs: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Write files in ascending ``key`` order to ``folder`` and return their manifest: ``(part, file, docs, tokens)``.

    Each task writes one file under the name of its attempt. The manifest lists what the finished attempts
    wrote, so what a lost executor leaves behind is never read. ``key`` must be a whole number; null keys come
    first, rows that repeat a key are ordered by text. A null or empty text is its end id alone.
    """
    scratch = Scratch(docs.sparkSession, "idfile")
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, narrow, task = encoder(path, False), width(path), TaskContext.get()
        keys, counts, nulls = [], [], 0
        store, base = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            file = Writer(out)
            for batch in W.slices(batches, "text", 2 << 20):
                ids, first = tool.encode(batch["text"])
                for a, b in zip(first, first[1:]):
                    file.frame(np.append(ids[a:b], end_id).astype(narrow).tobytes())
                nulls += batch["id"].null_count
                keys.append(np.asarray(batch["id"].fill_null(0), dtype="<i8"))
                counts.append((np.diff(first) + 1).astype("<u4"))
            keys, counts = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, "<i8"), (counts, "<u4")))
            file.frame(struct.pack("<QQ", len(keys), nulls) + keys.tobytes() + counts.tobytes())
            file.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "file": [name], "docs": [len(keys)], "tokens": [int(counts.sum())]})

    ordered = source.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    return scratch.table(ordered.mapInArrow(put, "part bigint, file string, docs bigint, tokens bigint"), "manifest")


def read(manifest: DataFrame, folder: str, path: str, key: str = "doc_id", wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Rows ``(key, start, n_tokens, ids_crc32[, ids])`` of the ``wanted`` keys, or of all.

    ``start`` counts the ids of all documents before it. Only the frames of wanted documents are read.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    parts = parts.repartition(max(1, manifest.count()), "part")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = width(path)
        store, root = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist()):
                with store.open_input_file(f"{root}/{name}") as source:
                    file = Reader(source, narrow)
                    start = base + np.cumsum(file.counts.astype(np.int64)) - file.counts
                    rows = np.arange(len(file.keys)) if wanted is None else np.flatnonzero(np.isin(file.keys, wanted) & (np.arange(len(file.keys)) >= file.nulls))
                    for cut in range(0, len(rows), 5000):
                        some = rows[cut : cut + 5000]
                        ids = [file.document(i) for i in some]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(file.keys[some], pa.int64(), mask=some < file.nulls),
                                pa.array(start[some], pa.int64()),
                                pa.array([len(x) for x in ids], pa.int64()),
                                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                                pa.array([x.tobytes() if with_ids else None for x in ids], pa.binary()),
                            ],
                            names=["id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    out = parts.select("file", "base").mapInArrow(get, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary").withColumnRenamed("id", key)
    return out if with_ids else out.drop("ids")
