"""WARC archives as a Spark data source, and pages archived with revisit records for equal payloads.

The source is registered as format ``warc``. The driver plans partitions out of whole files, whose
sizes it knows from the manifests that writing left or from a listing. Predicates on header fields
are pushed down: a task parses the header of a record first, and where a predicate fails it skips the
block, by seeking where the file says how long the record is. Columns are chosen by schema, and
blocks are decoded only for records that pass and only when the schema asks for what is in them.

Files are reached through Arrow's file systems, so any address they know can be read and written.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, MapType, StringType, StructField, StructType

from wardstat.llm.common import column, written
from wardstat.session import scratch_path, ship_code

#: Bytes of archive that one partition of a scan reads, unless a single file is longer.
PARTITION_BYTES = 128 << 20
#: Bytes after which the writer begins the next file.
FILE_BYTES = 256 << 20
#: Bytes of payload, or rows, after which a batch is handed to Spark.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
#: Payloads shorter than this are stored again rather than referred to.
LEAST_REVISIT = 100
#: Keys with more than this part of all rows are looked up by broadcast: there are at most this many.
HEAVY_KEYS = 1000

# Field names, profile and versions of the WARC format.
HEADER_FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "record_date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "content_length": "content-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")

#: Columns of a record.
SCHEMA = StructType(
    [StructField(name, StringType()) for name in HEADER_FIELDS if name != "content_length"]
    + [
        StructField("content_length", LongType()),
        StructField("payload_length", LongType()),
        StructField("headers", MapType(StringType(), StringType())),
        StructField("payload", BinaryType()),
        StructField("file", StringType()),
        StructField("offset", LongType()),
    ]
)
#: Columns that need the block of a record.
BLOCK_COLUMNS = {"payload", "payload_length"}

_URN = "urn:page:"
# No encoded id holds a question mark.
_NO_PAGE = _URN + "?"
_READ = 64 << 10


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of an address and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


# ---- reading bytes ------------------------------------------------------------------------


class _Cursor:
    """Buffered forward reading of a file; long skips become seeks."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.buffer, self.at, self.base = b"", 0, 0

    @property
    def place(self) -> int:
        return self.base + self.at

    def view(self, least: int = 1) -> memoryview:
        """What is buffered from here on, at least ``least`` bytes unless the file ends."""
        if len(self.buffer) - self.at < least:
            rest = self.buffer[self.at :]
            more = self.file.read(max(_READ, least - len(rest)))
            self.base, self.at, self.buffer = self.place, 0, rest + more
        return memoryview(self.buffer)[self.at :]

    def advance(self, count: int) -> None:
        if self.at + count <= len(self.buffer):
            self.at += count
        else:
            self.seek(self.place + count)

    def seek(self, place: int) -> None:
        if self.base <= place <= self.base + len(self.buffer):
            self.at = place - self.base
            return
        if place > self.size:
            raise ValueError("archive ends inside a record")
        self.file.seek(place)
        self.buffer, self.at, self.base = b"", 0, place


class _Plain:
    """The bytes of an archive that is not compressed."""

    def __init__(self, cursor: _Cursor):
        self.cursor = cursor

    def record_place(self) -> int:
        return self.cursor.place

    def more(self) -> bool:
        return len(self.cursor.view()) > 0

    def head(self) -> bytes:
        least = 1
        while True:
            found = bytes(self.cursor.view(least))
            end = found.find(b"\r\n\r\n")
            if end >= 0:
                self.cursor.advance(end + 4)
                return found[:end]
            if len(found) < least:
                raise ValueError("archive ends inside a header")
            least = max(2 * len(found), _READ)

    def take(self, count: int) -> bytes:
        found = bytes(self.cursor.view(count)[:count])
        if len(found) < count:
            raise ValueError("archive ends inside a record")
        self.cursor.advance(count)
        return found

    def skip(self, count: int) -> None:
        self.cursor.advance(count)


class _Gzip:
    """The inflated bytes of an archive of gzip members, one for each record or for several."""

    def __init__(self, cursor: _Cursor):
        self.cursor = cursor
        self.out = bytearray()
        self.inflater = None
        self.member = 0

    def record_place(self) -> int:
        return self.member

    def _open(self) -> bool:
        """Begin the next member; the ``sl`` field, where there is one, tells how long it is."""
        head = self.cursor.view(10)
        if not len(head):
            return False
        if bytes(head[:3]) != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at {self.cursor.place}")
        self.member, flags = self.cursor.place, head[3]
        self.cursor.advance(10)
        self.jump = None
        if flags & 4:
            (length,) = struct.unpack("<H", self.cursor.view(2)[:2])
            extra = bytes(self.cursor.view(2 + length)[2 : 2 + length])
            self.cursor.advance(2 + length)
            while len(extra) >= 4:
                (size,) = struct.unpack("<H", extra[2:4])
                if extra[:2] == b"sl" and size == 8:
                    self.jump = struct.unpack("<II", extra[4:12])
                extra = extra[4 + size :]
        for flag in (8, 16):  # name and comment end with a zero byte
            if flags & flag:
                while True:
                    part = bytes(self.cursor.view())
                    if not part:
                        raise ValueError("archive ends inside a member")
                    end = part.find(b"\0")
                    self.cursor.advance(len(part) if end < 0 else end + 1)
                    if end >= 0:
                        break
        if flags & 2:
            self.cursor.advance(2)
        self.deflated, self.produced = self.cursor.place, 0
        self.inflater = zlib.decompressobj(-15)
        return True

    def _fill(self) -> bool:
        if self.inflater is None and not self._open():
            return False
        data = self.cursor.view()
        if not len(data):
            raise ValueError("archive ends inside a member")
        got = self.inflater.decompress(data)
        self.produced += len(got)
        self.out += got
        self.cursor.advance(len(data) - len(self.inflater.unused_data))
        if self.inflater.eof:
            self.cursor.advance(8)
            self.inflater = None
        return True

    def more(self) -> bool:
        while not self.out:
            if not self._fill():
                return False
        return True

    def head(self) -> bytes:
        begin = 0
        while (end := self.out.find(b"\r\n\r\n", begin)) < 0:
            begin = max(0, len(self.out) - 3)
            if not self._fill():
                raise ValueError("archive ends inside a header")
        found = bytes(self.out[:end])
        del self.out[: end + 4]
        return found

    def take(self, count: int) -> bytes:
        while len(self.out) < count:
            if not self._fill():
                raise ValueError("archive ends inside a record")
        found = bytes(self.out[:count])
        del self.out[:count]
        return found

    def skip(self, count: int) -> None:
        while len(self.out) < count:
            count -= len(self.out)
            self.out.clear()
            if self.inflater is not None and self.jump and self.jump[1] - self.produced <= count:
                # The rest of the member is skipped as a whole, without inflating it.
                count -= self.jump[1] - self.produced
                self.cursor.seek(self.deflated + self.jump[0] + 8)
                self.inflater = None
            elif not self._fill():
                raise ValueError("archive ends inside a record")
        del self.out[:count]


def _fields(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name; a line that begins with a space continues the one before."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _is_http(fields: dict[str, str]) -> bool:
    return fields.get("content-type", "").lower().startswith("application/http")


def _header_row(fields: dict[str, str]) -> dict:
    row = {name: fields.get(field) for name, field in HEADER_FIELDS.items()}
    for name in ("record_id", "refers_to"):
        value = row[name]
        if value is not None:
            row[name] = value.removeprefix("<").removesuffix(">")
    row["content_length"] = int(row["content_length"] or 0)
    return row


def records(
    stream: _Plain | _Gzip, wanted: Callable[[dict], bool] = lambda row: True, block: bool = True
) -> Iterator[dict]:
    """Records that ``wanted`` lets through, judged by their header alone, with their blocks if asked for."""
    while stream.more():
        place = stream.record_place()
        head = stream.head()
        if not head.startswith(VERSIONS):
            raise ValueError(f"no record at {place}")
        fields = _fields(head)
        row = _header_row(fields)
        length = row["content_length"]
        if not wanted(row):
            stream.skip(length + 4)
            continue
        row |= {"headers": fields, "offset": place}
        if block:
            body = stream.take(length)
            stream.skip(4)
            row["payload_length"], row["payload"] = length, body
            if _is_http(fields):
                http, _, row["payload"] = body.partition(b"\r\n\r\n")
                row["payload_length"] = int(_fields(http).get("content-length") or len(row["payload"]))
        else:
            stream.skip(length + 4)
        yield row


# ---- predicates ---------------------------------------------------------------------------

_TESTS: dict[type, Callable] = {
    EqualTo: lambda have, value: have == value,
    EqualNullSafe: lambda have, value: have == value,
    GreaterThan: lambda have, value: have > value,
    GreaterThanOrEqual: lambda have, value: have >= value,
    LessThan: lambda have, value: have < value,
    LessThanOrEqual: lambda have, value: have <= value,
    In: lambda have, value: have in value,
    StringStartsWith: lambda have, value: have.startswith(value),
    StringEndsWith: lambda have, value: have.endswith(value),
    StringContains: lambda have, value: value in have,
}
_ORDERED = (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


def pushable(test: Filter) -> bool:
    """Whether a predicate can be decided by the header alone, exactly as Spark would decide it."""
    inner = test.child if isinstance(test, Not) else test
    if isinstance(inner, Not) or len(getattr(inner, "attribute", ())) != 1 or inner.attribute[0] not in HEADER_FIELDS:
        return False
    if isinstance(inner, (IsNull, IsNotNull)):
        return True
    if type(inner) not in _TESTS or (isinstance(test, Not) and isinstance(inner, EqualNullSafe)):
        return False
    if isinstance(inner, In):
        return all(value is not None for value in inner.value)
    # Python compares strings by code points, which is the order of their UTF-8 bytes.
    return inner.value is not None and (not isinstance(inner, _ORDERED) or isinstance(inner.value, (int, str)))


def passes(test: Filter, row: dict) -> bool:
    """A comparison with a missing field is not true, nor is its negation."""
    if isinstance(test, Not):
        inner = test.child
        if isinstance(inner, (IsNull, IsNotNull)):
            return not passes(inner, row)
        return row[inner.attribute[0]] is not None and not passes(inner, row)
    have = row[test.attribute[0]]
    if isinstance(test, IsNull):
        return have is None
    if isinstance(test, IsNotNull):
        return have is not None
    return have is not None and _TESTS[type(test)](have, test.value)


# ---- the data source ----------------------------------------------------------------------


@dataclass
class FilesPartition(InputPartition):
    """Whole files that one task reads."""

    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        unknown = set(schema.names) - set(SCHEMA.names)
        if unknown:
            raise ValueError(f"a WARC record has no column {sorted(unknown)}")
        self.path, self.schema, self.partition_bytes = path, schema, partition_bytes
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for test in filters:
            if pushable(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[FilesPartition]:
        """Files in order of their names, put together up to the partition size."""
        planned: list[list[str]] = []
        filled = 0
        for name, size in archive_files(self.path):
            if not planned or filled + size > self.partition_bytes:
                planned.append([])
                filled = 0
            planned[-1].append(name)
            filled += size
        return [FilesPartition(tuple(names)) for names in planned] or [FilesPartition(())]

    def read(self, partition: FilesPartition) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        names = self.schema.names
        block = bool(BLOCK_COLUMNS & set(names))
        rows: list[dict] = []
        held = 0
        for name in partition.files:
            where, path = file_system(name)
            with where.open_input_file(path) as file:
                cursor = _Cursor(file)
                stream = _Gzip(cursor) if bytes(cursor.view(2)[:2]) == b"\x1f\x8b" else _Plain(cursor)
                for row in records(stream, lambda head: all(passes(t, head) for t in self.tests), block):
                    row["file"] = name
                    rows.append({n: row[n] for n in names})
                    held += len(row.get("payload") or b"") if "payload" in names else 0
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def archive_files(path: str) -> list[tuple[str, int]]:
    """Addresses and sizes of the files of an archive: those in its manifests, or else all in its folder.

    Files that a failed or repeated task left are in no manifest and so not part of the archive.
    """
    where, root = file_system(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = where.get_file_info(fs.FileSelector(root))
    manifests = [f for f in found if f.base_name.startswith("_manifest-")]
    if manifests:
        listed = []
        for manifest in manifests:
            with where.open_input_stream(manifest.path) as file:
                listed += [(f"{path.rstrip('/')}/{name}", size) for name, size in json.loads(file.read())]
        return sorted(listed)
    names = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Writes numbered files under names of their own; only the manifest of a commit makes them count."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict[str, str]):
        self.path, self.names, self.overwrite = path, schema.names, overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.level = int(options.get("compression_level", 6))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.software = options.get("software", "wardstat")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, root = file_system(self.path)
        where.create_dir(root, recursive=True)
        context = TaskContext.get()
        label = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}"
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            columns = {n: column(batch, n) for n in self.names if n in batch.schema.names}
            for k in range(batch.num_rows):
                if out is None:
                    name = f"{label}-{len(files):05d}.warc.gz"
                    out, size = where.open_output_stream(f"{root}/{name}", compression=None), 0
                    files.append((name, 0))
                record = gzip_member(warc_record({n: c[k].as_py() for n, c in columns.items()}, self.date), self.level)
                out.write(record)
                size += len(record)
                files[-1] = (name, size)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        where, root = file_system(self.path)
        where.create_dir(root, recursive=True)
        before = [f.path for f in where.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File]
        files = [file for message in messages if message is not None for file in message.files]
        with where.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())
        if self.overwrite:
            fresh = {f"{root}/{name}" for name, _ in files}
            for old in before:
                if old not in fresh:
                    where.delete_file(old)

    def abort(self, messages: list[_Written | None]) -> None:
        where, root = file_system(self.path)
        for message in messages:
            for name, _ in message.files if message is not None else []:
                where.delete_file(f"{root}/{name}")


def header_text(value) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def warc_record(row: dict, date: str) -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the HTTP header only."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    full = row.get("payload_length")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if full is None else full}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {header_text(kind)}"]
    record_id = row.get("record_id")
    lines.append(f"WARC-Record-ID: <{header_text(record_id if record_id is not None else uuid.uuid4().urn)}>")
    lines.append(f"WARC-Date: {header_text(row.get('record_date') or date)}")
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {header_text(row['target_uri'])}")
    if row.get("payload_digest") is not None:
        lines.append(f"WARC-Payload-Digest: {header_text(row['payload_digest'])}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        if row.get("refers_to") is not None:
            lines.append(f"WARC-Refers-To: <{header_text(row['refers_to'])}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose ``sl`` field holds its deflated and inflated lengths where they fit."""
    deflater = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflater.compress(data) + deflater.flush()
    fits = len(body) < 1 << 32 and len(data) < 1 << 32
    extra = struct.pack("<H2sHII", 12, b"sl", 8, len(body), len(data)) if fits else b""
    head = b"\x1f\x8b\x08" + (b"\x04" if fits else b"\0") + b"\0\0\0\0\0\xff" + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcSource(DataSource):
    """Format ``warc``: ``path`` names a file or a folder; see :data:`SCHEMA` for the columns.

    Reading takes ``partition_bytes``; a schema with fewer columns reads less. Writing takes any of
    the columns ``record_id``, ``record_type``, ``target_uri``, ``record_date``, ``refers_to``,
    ``payload_digest``, ``payload_length`` and ``payload``, and the options ``file_bytes``,
    ``compression_level`` and ``date``.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema, overwrite, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make format ``warc`` known to the session and let Spark hand predicates to it."""
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: str | StructType = SCHEMA, **options) -> DataFrame:
    """Records of the archives at ``path``; ``columns`` (DDL) chooses what is decoded."""
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write one record for each row, gzip members in files of bounded size."""
    register(rows.sparkSession)
    rows.write.format("warc").mode(mode).options(**options).save(path)


# ---- pages with revisits ------------------------------------------------------------------


def page_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT
) -> DataFrame:
    """A row for each page in the columns that :func:`write_warc` takes.

    Of pages with equal payloads of at least ``least`` bytes that with the smallest id is a response,
    the others revisit it. Equal means equal SHA-256 and length. A null payload counts as empty, a
    null id as larger than all others; pages without an id refer to no page but can revisit one, and
    are responses where no page of their group has an id. Rows that repeat the smallest id are
    responses too, for no page revisits itself. Payloads are whole whatever their length, an empty
    table gives no rows, and other columns are not read, so their names cannot clash.

    A payload that many pages share is looked up by broadcast, the rest by a join on the digest, so no
    task gathers the copies of one payload.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"length": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    shared = rows.where(F.col("length") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = written(shared.where("n > 1 and first is not null"), "warc-firsts")
    # More than a thousandth of all rows each, so there are at most a thousand of them.
    total = rows.count()
    heavy = firsts.where(F.col("n") * HEAVY_KEYS > total).select("digest", F.col("first").alias("heavy_first"))
    light = firsts.where(F.col("n") * HEAVY_KEYS <= total).select(F.col("digest").alias("key"), F.col("first").alias("light_first"))
    known = rows.join(F.broadcast(heavy), "digest", "left")
    # Rows that need no other lookup are dealt by a key that no digest equals.
    spread = F.concat(F.lit("-"), F.xxhash64("id", "url", F.spark_partition_id()).cast("string"))
    settled = F.col("heavy_first").isNotNull() | (F.col("length") < least)
    keyed = known.withColumn("key", F.when(settled, spread).otherwise(F.col("digest")))
    joined = keyed.join(light, "key", "left")
    first = F.coalesce("heavy_first", "light_first")
    revisit = F.coalesce(first.isNotNull() & ~first.eqNullSafe(F.col("id")), F.lit(False)) & (F.col("length") >= least)

    def urn(ident: Column) -> Column:
        return F.concat(F.lit(_URN), F.url_encode(ident.cast("string")))

    return joined.select(
        F.coalesce(urn(F.col("id")), F.lit(_NO_PAGE)).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn(first)).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, **options) -> None:
    """Write the pages as WARC files below ``path``; see :func:`page_records` for the revisits."""
    write_warc(page_records(pages, id_col, url_col, payload_col, least), path, **options)


def read_pages(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """What the archives at ``path`` say of each page.

    Payloads of responses are decoded, and length and digest are taken from them; revisits are read
    by their headers, and the payloads between them are skipped. Returns ``page_id``,
    ``payload_bytes``, ``payload_digest`` (bare), ``record_type``, ``refers_to`` and ``stored_digest``,
    the digest that the record states.
    """
    def page(name: str) -> Column:
        text = F.url_decode(F.substring(name, len(_URN) + 1, 1 << 30))
        return F.when(F.col(name) != _NO_PAGE, text).cast(id_type).alias("page_id" if name == "record_id" else name)

    stated = F.substring_index("payload_digest", ":", -1)
    names = "record_id string, record_type string, refers_to string, payload_digest string"
    whole = read_warc(spark, path, f"{names}, payload binary").where("record_type = 'response'").select(
        page("record_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        page("refers_to"),
        stated.alias("stored_digest"),
    )
    revisits = read_warc(spark, path, f"{names}, payload_length long").where("record_type = 'revisit'").select(
        page("record_id"),
        F.col("payload_length").alias("payload_bytes"),
        stated.alias("payload_digest"),
        "record_type",
        page("refers_to"),
        stated.alias("stored_digest"),
    )
    return whole.unionAll(revisits)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages below the shared folder and read them back: see :func:`read_pages`."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    archive_pages(pages, path, id_col, url_col, payload_col)
    return read_pages(spark, path, pages.schema[id_col].dataType.simpleString())
