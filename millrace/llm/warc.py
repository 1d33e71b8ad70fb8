"""WARC derivatives: a metadata record and a plain-text conversion record for every response.

Both records name the response they were made of (``WARC-Refers-To`` with its uri and date) and carry
identifiers that follow from it, so a repeated run makes the same records. The metadata record keeps the
response's own headers and digests. Digests are SHA-1 in base 32, as is usual in WARC files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122
VERSION = b"WARC/1.1\r\n"
#: Date of records whose source gives none.
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, block binary"

_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body))", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|figcaption|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>?")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)


def digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_id(*of: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(of))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload. A block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if k.strip()], payload


def _one_line(x: str) -> str:
    return " ".join(x.split())


def plain_text(page: str) -> str:
    """Text of a page: one line for each block, entities resolved, without scripts, styles and comments.

    Markup that never ends is dropped up to the end; tags need not be balanced. Text without markup stays.
    """
    page = _DROPPED.sub("\n", page)
    page = entities.unescape(_TAG.sub("", _BREAK.sub("\n", page)))
    return "\n".join(x for x in map(_one_line, page.split("\n")) if x)


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    name = _CHARSET.search(kind) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(name[1] if name else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def metadata(source: dict, status: str, headers: list[tuple[str, str]], page: str) -> bytes:
    """Fields of the metadata record: the source's identifiers, headers and digests, then what the page says."""
    title, lang = _TITLE.search(page), _LANG.search(page)
    fields = [
        ("source-record-id", source["record_id"]),
        ("source-block-digest", source["block_digest"]),
        ("source-payload-digest", source["payload_digest"]),
        ("source-status", status),
        *((f"source-header-{k}", v) for k, v in headers),
        ("title", _one_line(entities.unescape(_TAG.sub("", title[1]))) if title else ""),
        ("language", lang[1] if lang else ""),
        *(("outlink", _one_line(entities.unescape(next(filter(None, m.groups()), "")))) for m in _LINK.finditer(_DROPPED.sub("\n", page))),
    ]
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode()


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str | None = None) -> DataFrame:
    """A response record for each row of ``pages``: its columns are those of ``RECORD``, and ``key``.

    A null page is an empty payload, a null url an empty uri. Identifiers follow from key, url and payload;
    so rows that repeat all three are one record, and have the same identifiers.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "page"):
            rows = []
            for k, u, p, d in zip(*(batch[c].to_pylist() for c in ("key", "url", "page", "date"))):
                payload = (p or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                uri, own = _one_line(u or ""), digest(payload)
                rows.append(("response", record_id("response", str(k), uri, own), None, uri, d or NO_DATE, "application/http; msgtype=response", digest(head + payload), own, head + payload))
            yield _batch(batch["key"], rows)

    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"), (F.col(date) if date else F.lit(NO_DATE)).cast("string").alias("date"))
    return own.mapInArrow(make, f"key {pages.schema[key].dataType.simpleString()}, {RECORD}").withColumnRenamed("key", key)


def _batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.binary() if n == "block" else pa.string()) for n, c in zip(names, columns))], names=["key", *names])


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records, ``metadata`` and ``conversion``, for every response among ``records``; other types give none.

    A null block is an empty one. Where the source has no digests they are computed, so the links always carry them.
    Columns beyond ``key`` and those of ``RECORD`` are not read. Repeated responses give repeated records.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "block"):
            rows, at = [], []
            for i, r in enumerate(batch.to_pylist()):
                block = r["block"] or b""
                status, headers, payload = split_http(block)
                source = r | {"record_id": r["record_id"] or record_id("response", r["target_uri"] or "", digest(block)), "block_digest": r["block_digest"] or digest(block), "payload_digest": r["payload_digest"] or digest(payload)}
                page = decoded(payload, headers)
                for kind, content_type, content in (
                    ("metadata", "application/warc-fields", metadata(source, status, headers, page)),
                    ("conversion", "text/plain; charset=utf-8", plain_text(page).encode()),
                ):
                    rows.append((kind, record_id(kind, source["record_id"]), source["record_id"], r["target_uri"] or "", r["date"] or NO_DATE, content_type, digest(content), source["payload_digest"], content))
                    at.append(i)
            yield _batch(batch["key"].take(pa.array(at, pa.int64())), rows)

    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    own = records.where("type = 'response'").select(F.col(key).alias("key"), *names)
    return own.mapInArrow(make, f"key {records.schema[key].dataType.simpleString()}, {RECORD}").withColumnRenamed("key", key)


def serialised(r: dict) -> bytes:
    """A record as it stands in a file. Of derivatives the payload digest is that of the source, and has a name of its own."""
    block = r["block"] or b""
    derived = r["refers_to"] is not None
    fields = [
        ("WARC-Type", r["type"]),
        ("WARC-Record-ID", r["record_id"]),
        ("WARC-Date", r["date"]),
        ("WARC-Target-URI", r["target_uri"]),
        ("WARC-Refers-To", r["refers_to"]),
        ("WARC-Refers-To-Target-URI", r["target_uri"] if derived else None),
        ("WARC-Refers-To-Date", r["date"] if derived else None),
        ("WARC-Block-Digest", r["block_digest"]),
        ("X-Source-Payload-Digest" if derived else "WARC-Payload-Digest", r["payload_digest"]),
        ("Content-Type", r["content_type"]),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an open, unpacked file."""
    back = {"warc-type": "type", "warc-record-id": "record_id", "warc-date": "date", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to", "warc-block-digest": "block_digest", "content-type": "content_type"}
    back |= dict.fromkeys(("x-source-payload-digest", "warc-payload-digest"), "payload_digest")
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the begin of a WARC record")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        r = dict.fromkeys(back.values()) | {back[k]: v for k, v in fields.items() if k in back}
        r["block"] = stream.read(int(fields["content-length"]))
        if r["block_digest"] and r["block_digest"].startswith("sha1:") and digest(r["block"]) != r["block_digest"]:
            raise ValueError(f"record {r['record_id']} is damaged")
        yield r | {"target_uri": r["target_uri"] or ""}


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` to WARC files, a gzip member for each, and return their manifest ``(file, records)``.

    Each task attempt writes a file of its own name, and the manifest lists those of finished attempts.
    """
    scratch = Scratch(records.sparkSession, "warc")
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        store, base = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in W.slices(batches, "block"):
                for r in batch.to_pylist():
                    out.write(gzip.compress(serialised(r), 6, mtime=0))
                    n += 1
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return scratch.table(records.select(names).mapInArrow(put, "file string, records bigint"), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that ``manifest`` lists; the digest of every block is checked."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["file"].to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as source:
                    for r in parsed(source):
                        yield pa.RecordBatch.from_pylist([r], schema=_schema())

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(get, RECORD)


def _schema() -> pa.Schema:
    return pa.schema([(x.split(" ")[0], pa.binary() if x.endswith(" binary") else pa.string()) for x in RECORD.split(", ")])
