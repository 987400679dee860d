"""WARC archives as a Spark data source, for reading and writing.

    spark.dataSource.register(WarcSource)
    df.write.format("warc").save(folder)
    spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'response'")

Writing: every task writes files of whole records, each record a gzip member of its own whose
header also tells its length (the "sl" field), so that a reader can step over it.  Files get their final
names only when the job commits; those of lost or repeated tasks are never read.

Reading: files are planned into partitions by size.  Predicates on record type and headers are
pushed into the reader, which inflates only the head of a record, decides, and steps over what is not
wanted; payloads are inflated only when asked for.  Plain (not compressed) archives are read too.

Null urls become an empty target, null payloads an empty body; control characters and blanks in urls are
percent-encoded in the header and come back decoded.  An empty table writes no records.  Repeated rows are
written one by one.  Other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType


from ._common import drop, read, scratch, ship, written

SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, record_id string, date string, payload binary"
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WINDOW = 1 << 20
FEW = 1 << 17  # digests of repeated payloads, about 40 bytes each, that are broadcast


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; any store that Arrow knows by URI, or a local path."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


def record(kind: str, page: int | None, url: str | None, refers_to: int | None, digest: str, size: int, payload: bytes, date: str) -> bytes:
    """One record, as it is before compression."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page}>", f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is None:
        head.append("X-No-Target: 1")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + CRLF * 2 + http + payload + CRLF * 2


_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def member(data: bytes, level: int) -> bytes:
    """A gzip member with its own length and the plain length in the extra field "sl"."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Window:
    """A file read forward through a bounded window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def bytes(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.data):
            self.file.seek(pos)
            self.at, self.data = pos, self.file.read(max(n, WINDOW))
        return self.data[pos - self.at : pos - self.at + n]


class _Member:
    """The plain bytes of one gzip member, inflated as far as they are asked for."""

    def __init__(self, window: _Window, pos: int):
        self.window, self.pos = window, pos
        fixed = window.bytes(pos, 12)
        flags, at, self.skip = fixed[3], pos + 10, None
        if flags & 4:
            (n,) = struct.unpack("<H", fixed[10:12])
            extra = window.bytes(at + 2, n)
            at += 2 + n
            while len(extra) >= 4:
                name, size = struct.unpack("<2sH", extra[:4])
                if name == b"sl" and size == 8:
                    self.skip = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size :]
        for flag in (8, 16):  # a name, a comment
            if flags & flag:
                while window.bytes(at, 1) != b"\0":
                    at += 1
                at += 1
        at += 2 if flags & 2 else 0
        self.raw, self.plain, self.at = zlib.decompressobj(-15), bytearray(), at

    def more(self, most: int) -> bool:
        if self.raw.eof:
            return False
        data = self.raw.unconsumed_tail or self.window.bytes(self.at, min(WINDOW, self.window.size - self.at))
        if not self.raw.unconsumed_tail:
            self.at += len(data)
        if not data:
            return False
        self.plain += self.raw.decompress(data, most)
        if self.raw.eof:
            self.at -= len(self.raw.unused_data)
        return True

    def end(self) -> int:
        """Where the next member starts."""
        if self.skip:
            return self.pos + self.skip
        while not self.raw.eof and self.more(WINDOW):
            self.plain = bytearray()
        return self.at + 8


def _heads(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def records(window: _Window, wanted, payload: bool) -> Iterator[tuple]:
    """Rows (SCHEMA) of the records whose head is wanted; wanted: head row -> bool."""
    pos = 0
    while pos < window.size:
        if window.bytes(pos, 2) == b"\x1f\x8b":
            m = _Member(window, pos)
            while (cut := m.plain.find(CRLF * 2)) < 0 and m.more(2048):
                pass
            if cut < 0:
                raise ValueError(f"a record without a head at byte {pos}")
            head = _heads(bytes(m.plain[:cut]))
            length = int(head.get("content-length", 0))
            row = _row(head)

            def block(n: int, m: _Member = m, cut: int = cut) -> bytes:
                while len(m.plain) < cut + 4 + n and m.more(WINDOW):
                    pass
                return bytes(m.plain[cut + 4 : cut + 4 + n])

            following = m.end
        else:
            if not window.bytes(pos, 4).strip(CRLF):
                pos += 2
                continue
            n = 4096
            while (cut := window.bytes(pos, n).find(CRLF * 2)) < 0:
                if pos + n >= window.size:
                    raise ValueError(f"a record without a head at byte {pos}")
                n *= 2
            head = _heads(window.bytes(pos, cut))
            length = int(head.get("content-length", 0))
            row = _row(head)

            def block(n: int, pos: int = pos, cut: int = cut) -> bytes:
                return window.bytes(pos + cut + 4, n)

            def following(pos: int = pos, cut: int = cut, length: int = length) -> int:
                return pos + cut + 4 + length + 4

        if wanted(row):
            yield _finish(row, block, length, payload)
        pos = following()


def _row(head: dict[str, str]) -> dict:
    url = unquote(head.get("warc-target-uri", ""))
    return {
        "record_type": head.get("warc-type"),
        "page_id": _page(head.get("warc-record-id")),
        "url": None if "x-no-target" in head else url,
        "refers_to": _page(head.get("warc-refers-to")),
        "payload_digest": (head.get("warc-payload-digest") or ":").partition(":")[2] or None,
        "record_id": head.get("warc-record-id"),
        "date": head.get("warc-date"),
    }


def _finish(row: dict, block, length: int, payload: bool) -> tuple:
    body = None
    http = b""
    n = min(length, 1024)
    while (cut := (http := block(n)).find(CRLF * 2)) < 0 and n < length:
        n = min(length, n * 2)
    size = _heads(http[:cut]).get("content-length") if cut >= 0 else None
    size = int(size) if size and size.isdigit() else length
    if payload and row["record_type"] != "revisit":
        body = block(length)[cut + 4 if cut >= 0 else 0 :]
        size = len(body)
    return (row["record_type"], row["page_id"], row["url"], row["refers_to"], row["payload_digest"], size, row["record_id"], row["date"], body)


@dataclass
class Files(InputPartition):
    files: list  # (path, size)


_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
}
_HEAD = {"record_type", "page_id", "url", "refers_to", "payload_digest", "record_id", "date"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitBytes", 32 << 20))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in _HEAD and type(f) in {*_TESTS, IsNull, IsNotNull}:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
        files = sorted((i.path, i.size) for i in found if i.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path) and "/_" not in i.path[len(path) :])
        out: list[Files] = []
        room = 0
        for f in files:  # small files share a partition, a large one has its own
            if f[1] > room:
                out.append(Files([]))
                room = self.split
            out[-1].files.append(f)
            room -= f[1]
        return out or [Files([])]

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            x = row[name]
            if not (x is None if kind is IsNull else x is not None if kind is IsNotNull else _TESTS[kind](x, value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = open_fs(self.path)
        for path, size in partition.files:
            with fs.open_input_file(path) as f:
                yield from records(_Window(f, size), self.wanted, self.payload)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Rows: record_type, page_id, url, refers_to, sha1 (binary), payload_bytes, payload (binary)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.level = int(options.get("level", 1))
        self.most = int(options.get("fileBytes", 64 << 20))
        self.date = options.get("date", "2026-01-01T00:00:00Z")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = open_fs(self.path)
        task = TaskContext.get()
        fs.create_dir(f"{path}/_open-{self.job}", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.select(["record_type", "page_id", "url", "refers_to", "sha1", "payload_bytes", "payload"]).columns)):
                kind, page, url, refers_to, sha1, n, payload = row
                if out is None:
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(files):04d}.warc.gz"
                    out, size = fs.open_output_stream(f"{path}/_open-{self.job}/{name}", compression=None), 0
                    files.append(name)
                data = member(record(kind, page, url, refers_to, base64.b32encode(sha1).decode(), n, payload or b"", self.date), self.level)
                out.write(data)
                size += len(data)
                if size >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = open_fs(self.path)
        fs.create_dir(path, recursive=True)
        names = [name for m in messages for name in (m.files if m else ())]
        with ThreadPoolExecutor(32) as pool:  # a rename waits for the store, not for the driver
            list(pool.map(lambda name: fs.move(f"{path}/_open-{self.job}/{name}", f"{path}/{name}"), names))
        self._clear(fs, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, fs: pafs.FileSystem, path: str) -> None:
        if fs.get_file_info(f"{path}/_open-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/_open-{self.job}")


class WarcSource(DataSource):
    """Options: path; reading: payload (true), splitBytes; writing: level, fileBytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def as_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Pages as records to write: of equal payloads of at least `least` bytes the one with the largest id is the response.

    Rows of that id that repeat are responses too; a payload that no row with an id has is a response.  The digests of repeated
    payloads are written as a slim table first: up to FEW of them go to every task and no payload moves; beyond
    that the payloads are dealt by digest, where Spark splits a hot one."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # only payloads that occur again matter: counted in advance on each side of the shuffle, so a hot payload is no hot task
    again = rows.where(F.col("payload_bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("last").isNotNull()).select("sha1", "last")
    again = written(again)
    few = again.count() <= FEW
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    out = rows.join(F.broadcast(again) if few else again, "sha1", "left").select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "page_id",
        "url",
        F.when(revisit, F.col("last")).alias("refers_to"),
        "sha1",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out._scratch = again._scratch
    return out


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to archives and read back; sizes and digests of the payloads that come back."""
    register(spark)
    folder = scratch(spark)
    pages = as_records(read(spark, sf_dir, "pages"))
    pages.write.format("warc").mode("append").save(folder)
    drop(pages)
    # the record type is pushed down: each read skips the other's members, and revisits need their headers only
    whole = spark.read.format("warc").load(folder).where("record_type = 'response'")
    again = spark.read.format("warc").option("payload", "false").load(folder).where("record_type = 'revisit'")
    return whole.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        _base32(F.sha1("payload")).alias("payload_digest"),
        "record_type",
        "refers_to",
    ).unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def _base32(hexed):
    """Upper-case base32 of 40 hex digits: each 10 of them are 40 bits, or 8 letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(4):
        bits = F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 2), 40, "0")
        for j in range(8):
            out.append(F.substring(letters, F.conv(F.substring(bits, 5 * j + 1, 5), 2, 10).cast("int") + 1, F.lit(1)))
    return F.concat(*out)


_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(s, {10 * i + 1}, 10) AS BIGINT) >> {35 - 5 * j}) & 31 AS INTEGER) + 1, 1)" for i in range(4) for j in range(8))
ORACLES = {
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p""",
}
QUERIES = {"op10_warc": op10_warc}
