"""WARC archives as a Python data source, for reading and writing.

``spark.read.format("warc").load(path)`` gives one row per record. Files are dealt to
partitions by size. Filters on the header columns are pushed down: a record's headers are
parsed first, and the payload of a record that fails them is neither inflated nor copied. In
plain files the reader seeks past it by Content-Length, in compressed ones by the ``sl`` field
of the record's gzip header (this writer sets it); only members without one are inflated
through.

``df.write.format("warc").save(path)`` writes ``record_type, record_id, headers, payload``.
Tasks write under ``_temporary`` and the driver renames finished files, so a lost or repeated
task leaves no half archive. Any file system of :mod:`pyarrow.fs` will do.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, datasource as ds, functions as F

from seqwatch.session import scratch_path

NAME = "warc"
VERSION = b"WARC/1.1"
HTTP = "application/http; msgtype=response"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 256 << 10
FILE_BYTES = 128 << 20
SPLIT_BYTES = 32 << 20
LEAST_SHARED = 100

# Columns that hold one header each; filters on these are pushed down.
HEADER_COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
READ_SCHEMA = ", ".join(f"{c} string" for c in HEADER_COLUMNS) + ", headers map<string,string>, payload binary"
WRITE_SCHEMA = "record_type string, record_id string, headers map<string,string>, payload binary"


def file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(record_type: str, record_id: str, headers: dict[str, str], payload: bytes) -> bytes:
    """One record. A payload of type ``application/http`` gets an HTTP head before it."""
    block = HTTP_HEAD + payload if headers.get("Content-Type") == HTTP else payload
    lines = [("WARC-Type", record_type), ("WARC-Record-ID", record_id), *headers.items(), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {clean(v)}\r\n".encode() for k, v in lines if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose header tells its own length in an ``sl`` field."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    size = 24 + len(body) + 8
    known = size < 1 << 32 and len(data) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, size if known else 0, len(data) if known else 0)
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Window:
    """Bytes of a file from any place on, read ``CHUNK`` by ``CHUNK``."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def get(self, start: int, n: int) -> bytes:
        """``n`` bytes from ``start``; fewer at the end of the file."""
        if not self.at <= start <= start + n <= self.at + len(self.data):
            self.at, self.data = start, self.file.read_at(max(n, CHUNK), start) if start < self.size else b""
        return self.data[start - self.at : start - self.at + n]


class _Plain:
    """A record at its place in an uncompressed file."""

    def __init__(self, window: _Window, start: int) -> None:
        self.window, self.start, self.end = window, start, 0

    def head(self) -> bytes:
        n = 4096
        while (at := (data := self.window.get(self.start, n)).find(b"\r\n\r\n")) < 0:
            if len(data) < n:
                return b""
            n *= 2
        self.block_at = self.start + at + 4
        return data[:at]

    def block(self, length: int) -> bytes:
        return self.window.get(self.block_at, length)

    def next(self, length: int) -> int:
        return self.block_at + length + 4


class _Member:
    """A record that is a gzip member; only as much is inflated as is asked for."""

    def __init__(self, window: _Window, start: int) -> None:
        self.window, self.start, self.length = window, start, 0
        fixed = window.get(start, 12)
        flags, at = fixed[3], start + 10
        if flags & 4:
            size = struct.unpack("<H", fixed[10:12])[0]
            extra, at = window.get(start + 12, size), start + 12 + size
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for bit in (8, 16):  # file name and comment, each up to a zero byte
            if flags & bit:
                while window.get(at, 1) not in (b"\0", b""):
                    at += 1
                at += 1
        self.at = at + 2 * bool(flags & 2)
        self.inflate = zlib.decompressobj(-15)
        self.pending = b""

    def _more(self, n: int) -> bytes:
        if self.inflate.eof:
            return b""
        if not self.pending:
            self.pending = self.window.get(self.at, CHUNK)
            self.at += len(self.pending)
            if not self.pending:
                raise ValueError("a gzip member ends early")
        out = self.inflate.decompress(self.pending, n)
        self.pending = self.inflate.unconsumed_tail
        return out

    def head(self) -> bytes:
        data = b""
        while (at := data.find(b"\r\n\r\n")) < 0:
            if self.inflate.eof:
                return b""
            data += self._more(4096)
        self.rest = data[at + 4 :]
        return data[:at]

    def block(self, length: int) -> bytes:
        parts, have = [self.rest], len(self.rest)
        while have < length and not self.inflate.eof:
            parts.append(self._more(1 << 20))
            have += len(parts[-1])
        return b"".join(parts)[:length]

    def next(self, length: int) -> int:
        if self.length:
            return self.start + self.length
        while not self.inflate.eof:
            self._more(1 << 20)
        return self.at - len(self.inflate.unused_data) + 8


def headers_of(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records(file, tests: list) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of the records whose headers pass all tests."""
    window, at = _Window(file), 0
    while at < window.size:
        first = window.get(at, 2)
        if first in (b"\r\n", b"\n\n"):  # stray line ends between records
            at += 2
            continue
        item = (_Member if first == b"\x1f\x8b" else _Plain)(window, at)
        head = item.head()
        if not head:
            raise ValueError(f"a record ends early at byte {at}")
        headers = headers_of(head)
        length = int(headers["content-length"])
        if all(test.holds(headers) for test in tests):
            yield headers, payload_of(headers, item.block(length))
        at = item.next(length)


@dataclass(frozen=True)
class Test:
    """A pushed filter on one header; like SQL, a missing header passes no comparison."""

    header: str
    kind: str
    value: object = None

    def holds(self, headers: dict[str, str]) -> bool:
        have = headers.get(self.header)
        if self.kind == "IsNull" or have is None:
            return self.kind == "IsNull" and have is None
        if self.kind == "In":
            return have in self.value
        if self.kind == "IsNotNull":
            return True
        return {
            "EqualTo": str.__eq__, "StringStartsWith": str.startswith,
            "StringEndsWith": str.endswith, "StringContains": str.__contains__,
        }[self.kind](have, self.value)


def pushed(item: ds.Filter) -> Test | None:
    kind, attribute = type(item).__name__, getattr(item, "attribute", ())
    if len(attribute) != 1 or attribute[0] not in HEADER_COLUMNS:
        return None
    header = HEADER_COLUMNS[attribute[0]]
    if kind in ("EqualTo", "StringStartsWith", "StringEndsWith", "StringContains") and isinstance(item.value, str):
        return Test(header, kind, item.value)
    if kind == "In" and all(isinstance(v, str) for v in item.value):
        return Test(header, kind, frozenset(item.value))
    return Test(header, kind) if kind in ("IsNull", "IsNotNull") else None


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list[Test] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for item in filters:
            test = pushed(item)
            if test:
                self.tests.append(test)
            else:
                yield item

    def partitions(self) -> list[ds.InputPartition]:
        from pyarrow import fs

        system, path = file_system(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        files = [f for f in found if f.type == fs.FileType.File and not re.search(r"/[_.]", f.path.removeprefix(path)) and re.search(r"\.warc(\.gz)?\Z", f.path)]
        parts: list[list[str]] = []
        size = self.split
        for f in sorted(files, key=lambda f: f.path):
            if size + f.size > self.split:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [ds.InputPartition(tuple(p)) for p in parts] or [ds.InputPartition(())]

    def read(self, partition: ds.InputPartition) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for path in partition.value:
            with system.open_input_file(path) as file:
                for headers, payload in records(file, self.tests):
                    yield (*(headers.get(h) for h in HEADER_COLUMNS.values()), headers, payload)


@dataclass
class Written(ds.WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.limit = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        system.create_dir(f"{path}/_temporary", recursive=True)
        files: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for kind, ident, headers, payload in zip(*(batch.column(c) for c in ("record_type", "record_id", "headers", "payload"))):
                    data = record(kind.as_py(), ident.as_py(), dict(headers.as_py() or ()), payload.as_py() or b"")
                    data = member(data) if self.gzip else data
                    if out is None or size + len(data) > self.limit:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                        out, size = system.open_output_stream(f"{path}/_temporary/{files[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        for name in (f for m in messages if m for f in m.files):
            system.move(f"{path}/_temporary/{name}", f"{path}/{name}")
        with system.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, path = file_system(self.path)
        for name in (f for m in messages if m for f in m.files):
            system.delete_file(f"{path}/_temporary/{name}")


class WarcSource(ds.DataSource):
    """Options: ``path``, ``split_bytes`` (read), ``compression`` (gzip or none) and ``file_bytes`` (write)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session, and let it take filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of_pages(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Rows to write for pages of ``page_id, url, html``.

    Of equal payloads of at least ``least`` bytes, that of the smallest page_id is the
    response and the others revisit it; smaller ones are all responses. Null html is an empty
    payload. Rows that repeat a page_id and its payload are alike; a page without an id revisits
    one that has an id, or else is a response. Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    made = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    made = made.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload")})
    shared = made.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = shared.filter("n > 1 AND first IS NOT NULL").drop("n")
    joined = made.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))

    def ident(page) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), "digest", F.lit(">"))

    headers = {
        "WARC-Date": F.lit("1970-01-01T00:00:00Z"),
        "WARC-Target-URI": F.col("url"),
        "Content-Type": F.lit(HTTP),
        "WARC-Payload-Digest": F.concat(F.lit("sha256:"), "digest"),
        "WARC-X-Payload-Length": F.col("bytes").cast("string"),
        "WARC-Profile": F.when(again, REVISIT),
        "WARC-Refers-To": F.when(again, ident(F.col("first"))),
    }
    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        ident(F.col("page_id")).alias("record_id"),
        F.create_map(*(x for k, v in headers.items() for x in (F.lit(k), v))).alias("headers"),
        F.when(~again, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
    )


def archive(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write pages to an archive folder (a new one in the shared folder by default) and return it."""
    register(pages.sparkSession)
    path = path or scratch_path(pages.sparkSession, "warc")
    records_of_pages(pages).write.format(NAME).options(**options).mode("append").save(path)
    return path


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of an archive; length and digest of responses are taken from the payload read."""
    register(spark)
    found = spark.read.format(NAME).load(path).filter(F.col("record_type").isin("response", "revisit"))

    def page(c: str) -> Column:
        return F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*):', 1), '') AS long)")

    full = F.col("record_type") == "response"
    digest = F.substring_index("payload_digest", ":", -1)
    return found.select(
        page("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload")).otherwise(F.col("headers")["warc-x-payload-length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(digest).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
        "target_uri",
    )
