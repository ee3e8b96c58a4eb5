"""WARC archives, written and read one record after another (op 9).

Writing: pages are grouped by payload; of those with the same one the page of largest id is a
``response``, the others are ``revisit`` records that refer to it and keep the HTTP header alone.
Each record is one gzip member. A task writes its records, by id, into archives of about ``roll``
bytes. Archives are rows (name, content) of a Parquet table in the shared folder, so Spark commits
them whichever executor is lost; ``save_files`` puts them down as ``.warc.gz`` files instead.

Reading (``records``): one archive at a time in pieces of ``PIECE`` bytes, decompressed step by step
by zlib; headers end at a blank line, blocks are framed by Content-Length, a member holds exactly one
record, and block and payload digests are verified. A damaged or cut archive raises ``ValueError``
with the record's number.

Defined results: null html is an empty payload; a null url has no WARC-Target-URI; null ids are
written as ``null``. Rows alike in payload and in the largest id are all responses. ``least`` is the
payload size from which records revisit.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import scratch, spread_back

ROLL = 4 << 20
PIECE = 1 << 16
_DATE = "2024-01-01T00:00:00Z"
_ID = "urn:leafweir:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, refers_url: str | None = None) -> bytes:
    """One record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    head += [f"WARC-Date: {_DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{'null' if refers_to is None else refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class Record(NamedTuple):
    kind: str
    page_id: int | None
    url: str | None
    payload: bytes
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def members(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """What each gzip member holds, decompressed as pieces come."""
    z, out = zlib.decompressobj(31), []
    number, begun = 0, False
    for piece in pieces:
        while piece:
            begun = True
            try:
                out.append(z.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"record {number}: {e}") from e
            piece = b""
            if z.eof:
                yield b"".join(out)
                piece, z, out = z.unused_data, zlib.decompressobj(31), []
                number, begun = number + 1, False
    if begun:
        raise ValueError(f"record {number}: the archive ends within it")


def _number(name: str) -> int | None:
    tail = name.strip("<>").removeprefix(_ID)
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """Sequential reader: every record, framed and verified."""
    for number, raw in enumerate(members(pieces)):
        head, sep, rest = raw.partition(b"\r\n\r\n")
        version, fields = _headers(head)
        if not sep or not version.startswith("WARC/"):
            raise ValueError(f"record {number}: no WARC header")
        n = int(fields.get("content-length", "-1"))
        block = rest[:n]
        if n < 0 or len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError(f"record {number}: its content is not as long as it says")
        if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", digest(block)):
            raise ValueError(f"record {number}: block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        _, inner = _headers(http)
        kind, told = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and told not in ("", digest(payload)):
            raise ValueError(f"record {number}: payload digest differs")
        url = fields.get("warc-target-uri")
        yield Record(kind, _number(fields["warc-record-id"]), None if url is None else unquote(url), payload, int(inner["content-length"]), told, _number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None)


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, revisit, refers_to of every page."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", raw.alias("payload")).withColumn("sha", F.sha1("payload"))
    per = rows.filter(F.octet_length("payload") >= least).groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("one")).withColumn("refers_to", F.col("one"))
    met = spread_back(rows, per, ["sha"], "copies", "one", "page_id")
    revisit = F.coalesce(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    return met.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def archives(pages: DataFrame, least: int = 0, roll: int = ROLL) -> DataFrame:
    """name, content, records: the archives of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": pa.array([f"pages-{part:06d}-{number:06d}.warc.gz"]), "content": pa.array([b"".join(held)], type=pa.binary()), "records": pa.array([len(held)], type=pa.int64())})

        for batch in batches:
            columns = [batch.column(x) for x in ("page_id", "url", "payload", "revisit", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, revisit, refers_to = (c[i].as_py() for c in columns)
                held.append(record(page_id, url, payload, refers_to, revisit))
                size += len(held[-1])
                if size >= roll:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    # pages stand where the join by payload has put them: they are not moved again
    return planned(pages, least).sortWithinPartitions("page_id", "url").mapInArrow(run, "name string, content binary, records long")


def write(pages: DataFrame, path: str, least: int = 0, roll: int = ROLL) -> None:
    archives(pages, least, roll).write.option("parquet.block.size", 16 << 20).parquet(path)


def save_files(archive_rows: DataFrame, folder: str) -> DataFrame:
    """Each archive as a file in a folder that every executor can write (a URI that pyarrow knows); name, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base)
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content"), strict=True):
                data = content.as_py()
                with store.open_output_stream(f"{base}/{name}.part", compression=None) as f:
                    f.write(data)
                store.move(f"{base}/{name}.part", f"{base}/{name}")  # a retried task writes the same file again
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"name": pa.array(names), "size": pa.array(sizes, type=pa.int64())})

    return archive_rows.select("name", "content").mapInArrow(run, "name string, size long")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            view = memoryview(content.as_buffer())
            got = []
            pieces = (bytes(view[i : i + PIECE]) for i in range(0, len(view), PIECE))
            for r in records(pieces):
                got.append(r)
                if len(got) == 256:
                    yield _rows(got)
                    got = []
            if got:
                yield _rows(got)


def _rows(got: list[Record]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "page_id": pa.array([r.page_id for r in got], type=pa.int64()), "url": pa.array([r.url for r in got], type=pa.string()), "payload": pa.array([r.payload for r in got], type=pa.binary()),
        "payload_bytes": pa.array([r.payload_bytes for r in got], type=pa.int64()), "payload_digest": pa.array([r.payload_digest for r in got]),
        "record_type": pa.array([r.kind for r in got]), "refers_to": pa.array([r.refers_to for r in got], type=pa.int64()),
    })


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archive_rows: DataFrame) -> DataFrame:
    """Records of archives (column content); a revisit's payload is empty, its length and digest are the full one's."""
    return archive_rows.select("content").mapInArrow(_parse, READ)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``.warc.gz`` files in any store that Spark reads."""
    return read(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession.read.parquet(path)).drop("url", "payload")


ORACLE = r"""
with p as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as sha from pages),
m as (select *, max(page_id) over (partition by sha) as top from p)
select page_id, octet_length(payload) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((cast('0x' || substr(sha, cast(1 + 5 * (i // 4) as integer), 5) as bigint) >> cast(15 - 5 * (i % 4) as integer)) & 31) as integer), 1)), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from m
"""
