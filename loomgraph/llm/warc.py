"""WARC archives: a writer of one gzip member a record and a sequential reader.

The reader feeds compressed bytes to zlib a chunk at a time, frames each record by its content length, checks the
block and payload digests and goes on at the next member. It never holds more than one record.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomgraph.llm.storage import new_path

#: Names and profile of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16


class WarcError(ValueError):
    """A record that is cut off, badly framed or has a digest that its bytes don't give."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def payload(self) -> bytes:
        """The body of an HTTP block; any other block whole."""
        if "msgtype=response" in self.headers.get("content-type", ""):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member; the same input gives the same bytes."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def _members(source) -> Iterator[bytes]:
    """The bytes of each gzip member, inflated as they are read."""
    held = b""
    while held or (held := source.read(CHUNK)):
        inflate, out = zlib.decompressobj(31), []
        while True:
            try:
                out.append(inflate.decompress(held))
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            if inflate.eof:
                held = inflate.unused_data
                break
            if not (held := source.read(CHUNK)):
                raise WarcError("the archive ends inside a gzip member")
        yield b"".join(out)


def read_records(source) -> Iterator[Record]:
    """Records of a binary stream, in order, each checked. ``source`` needs ``read(n)`` alone."""
    for raw in _members(source):
        head, sep, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8").split("\r\n")
        if not sep or not version.startswith("WARC/"):
            raise WarcError("no WARC header")
        headers: dict[str, str] = {}
        for line in lines:
            name, colon, value = line.partition(":")
            if not colon:
                raise WarcError(f"bad header line {line[:60]!r}")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise WarcError("no content length")
        n = int(headers["content-length"])
        if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
            raise WarcError(f"content length {n} does not frame the record")
        record = Record(headers, rest[:n])
        if (want := headers.get("warc-block-digest")) and want != _digest(record.block):
            raise WarcError("block digest differs")
        if record.kind == "response" and (want := headers.get("warc-payload-digest")) and want != _digest(record.payload):
            raise WarcError("payload digest differs")
        yield record


def _page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}"
    clean = "".join(c for c in (url or "") if c >= " ")
    common = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha256:{digest}")]
    common += [("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if revisit:
        return record_bytes([("WARC-Type", "revisit"), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(refers_to)), *common], head)
    return record_bytes([("WARC-Type", "response"), *common], head + payload)


def _filesystem(url: str):
    """File system and path of a folder's URL: local ones by path, others by what pyarrow knows of the scheme."""
    from pyarrow import fs

    parts = urlparse(url)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(url)


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", least: int = 100) -> DataFrame:
    """``pages(id, url, payload)`` with ``digest, first_id, revisit``.

    Of the rows with equal payloads of at least ``least`` bytes, those with the smallest id stay responses and the
    others revisit it. Rows without an id never revisit. The least id of each digest is pre-aggregated on the map
    side; the join back to the rows is one that adaptive execution can split where a digest is hot.
    """
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    first = rows.where((F.length("payload") >= least) & F.col(id_col).isNotNull()).groupBy("digest").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(first, "digest", "left")
    return joined.withColumn("revisit", F.coalesce((F.length("payload") >= least) & (F.col(id_col) > F.col("first_id")), F.lit(False)))


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for every row of ``pages`` to ``folder``/*.warc.gz; returns ``path, records, bytes`` (an action writes).

    A null html is an empty payload, a null url an empty target; other columns are ignored. An archive is closed at
    about ``archive_bytes``. A task writes under a name of its attempt and renames at the end, so a task that runs
    twice leaves one set of files.
    """
    rows = mark_revisits(pages.select(F.col(id_col), F.col(url_col), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")), id_col=id_col, least=least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        task, done, sink, size, count = TaskContext.get(), [], None, 0, 0
        mine = f"{root}/_{task.partitionId()}-{task.taskAttemptId()}"

        def close() -> None:
            nonlocal sink, size, count
            sink.close()
            done.append((f"{root}/part-{task.partitionId():06d}-{len(done):04d}.warc.gz", count, size))
            sink, size, count = None, 0, 0

        for b in batches:
            for page, url, payload, digest, first, revisit in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if sink is None:
                    sink = files.open_output_stream(f"{mine}-{len(done)}", compression=None)
                data = _page_record(page, url, payload, digest, first, revisit)
                sink.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    close()
        if sink is not None:
            close()
        for k, (path, _, _) in enumerate(done):
            files.move(f"{mine}-{k}", path)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return rows.select(id_col, url_col, "payload", "digest", "first_id", "revisit").mapInArrow(run, "path string, records bigint, bytes bigint")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the ``*.warc.gz`` files in ``folder``: ``record_type, target_uri, page_id, refers_to, payload_bytes, payload_digest, payload``.

    Spark hands each archive to a task as bytes, so any store that Spark reads will do; a record that fails its
    framing or digests fails the read. A folder without archives gives no rows. ``payload`` is null for revisits.
    """
    schema = "record_type string, target_uri string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def number(x: str | None) -> int | None:
        return int(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for content in b.column(0):
                for r in read_records(pa.BufferReader(content.as_buffer())):
                    h, full = r.headers, r.kind == "response"
                    payload = r.payload if full else None
                    out.append((r.kind, h.get("warc-target-uri"), number(h.get("x-page-id")), number(h.get("x-refers-to-page")), len(payload) if full else number(h.get("x-payload-length")), h.get("warc-payload-digest", "").removeprefix("sha256:"), payload))
                    held += len(r.block)
                    if len(out) >= 1000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, *, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` and read the archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    An empty table gives no rows. Repeated rows each give a record; those that repeat the smallest id are all responses.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    written = write_archives(pages, folder, **options).agg(F.sum("records")).first()[0]
    if not written:
        empty = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
        return spark.createDataFrame([], empty)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
