"""WARC archives as a PySpark Python data source, and the writing of pages into them.

`WarcSource` ("warc") plans one partition for each archive file; a writing task rolls to a new file
at FILE_BYTES, so that partitions stay small. The reader parses a record's header lines first. A
pushed filter on record type or on a header column is tested on them, and a record that fails it is
passed over by seeking beyond its block: its payload is neither read nor decoded. Payloads are also
passed over if the read was asked for headers only (option payload=false). Files ending in .gz
(one member for each record, as the format has it) are read as a stream. Folders below the path are read
too. A record that ends before its length fails the read.

Files are reached through `pyarrow.fs`, so a path may be local or in any store that it knows. Writing
goes to names of the task's own in a folder of the job's own under _pending; the driver moves them when the job commits, so tasks
that were run twice or lost leave nothing behind.

Defined results of `archive_pages`: a null html is an empty payload; a null url leaves the target
header out; among pages of equal payload those with the smallest id are responses and the others
revisits of that id (repeated rows of that id are all responses); a page without an id is always a
response; payloads under ``least_bytes`` are all responses; columns besides the three are ignored;
no pages make no archive and read back as no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.llm.common import fresh_folder

#: Bytes after which a writing task starts another file, and the pieces in which files are read.
FILE_BYTES = 64 << 20
READ_BYTES = 1 << 20

#: The columns of the source, and the header that each is read from and written to.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "record_date": "WARC-Date",
    "page_id": "X-Page-ID",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}
NUMBERS = ("page_id", "payload_bytes")
SCHEMA = ", ".join(f"{c} {'long' if c in NUMBERS else 'string'}" for c in HEADERS) + ", payload binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_store(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def record(values: dict, date: str) -> bytes:
    """One WARC record; values by column, payload among them."""
    kind = values["record_type"]
    block = HTTP + (b"" if kind == "revisit" else values["payload"])
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = date if column == "record_date" else values.get(column)
        if value is not None:
            clean = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in str(value))
            lines.append(f"{header}: {clean}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Members(io.RawIOBase):
    """The bytes of a gzip file of many members, as a stream."""

    def __init__(self, raw) -> None:
        self.raw, self.inflate, self.ready = raw, zlib.decompressobj(31), io.BytesIO()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not (n := self.ready.readinto(buffer)):
            if not (data := self.raw.read(READ_BYTES // 16)):
                return 0
            parts = []
            while data:
                parts.append(self.inflate.decompress(data))
                data = self.inflate.unused_data
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
            self.ready = io.BytesIO(b"".join(parts))
        return n


def read_records(raw, compressed: bool, wanted, payloads: bool) -> Iterator[tuple]:
    """Rows of the source's columns for the records whose headers ``wanted`` accepts."""
    file = io.BufferedReader(_Members(raw), READ_BYTES) if compressed else io.BufferedReader(raw, READ_BYTES)
    length = 0 if compressed else raw.size()
    while True:
        line = file.readline()
        while line in (b"\r\n", b"\n"):
            line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        found: dict[str, str] = {}
        while (line := file.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.lower()] = value.strip()
        size = int(found["content-length"])
        row = {c: found.get(h.lower()) for c, h in HEADERS.items()}
        for c in NUMBERS:
            row[c] = None if row[c] is None else int(row[c])
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        take = wanted(row)
        if take and payloads and row["record_type"] != "revisit":
            block = file.read(size)
            if len(block) < size:
                raise ValueError(f"a record ends after {len(block)} of its {size} bytes")
            body = block.partition(b"\r\n\r\n")[2] if found.get("content-type", "").startswith("application/http") else block
            yield (*row.values(), body)
            continue
        if compressed:
            left = size
            while left:
                if not (part := file.read(min(left, READ_BYTES))):
                    raise ValueError(f"a record ends {left} bytes early")
                left -= len(part)
        elif file.seek(size, 1) > length:
            raise ValueError(f"a record ends {file.tell() - length} bytes early")
        if take:
            yield (*row.values(), None)


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    names: list


class WarcReader(DataSourceReader):
    """One partition a file; equality, membership and null filters on header columns are pushed down."""

    def __init__(self, options) -> None:
        self.path, self.payloads, self.tests = options["path"], options.get("payload", "true") != "false", []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "set", None))
            elif isinstance(f, IsNull):
                self.tests.append((column, "null", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = open_store(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)) if "/_pending/" not in f.path]
        if not found and (info := store.get_file_info(root)).type == fs.FileType.File:
            found = [info]
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name.removesuffix(".gz").endswith(".warc")]

    def accepts(self, row: dict) -> bool:
        for column, kind, values in self.tests:
            value = row[column]
            if (kind == "null") != (value is None) or (kind == "in" and value not in values):
                return False
        return True

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None or not hasattr(partition, "path"):
            return
        store, _ = open_store(self.path)
        with store.open_input_file(partition.path) as raw:
            yield from read_records(raw, partition.path.endswith(".gz"), self.accepts, self.payloads)


class WarcWriter(DataSourceWriter):
    """Writes rows with the source's columns; record_date and missing ids are filled in."""

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.gzip = options.get("compression", "none") == "gzip"
        self.job = f"_pending/{uuid.uuid4().hex}"
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator) -> WriterCommitMessage:
        store, root = open_store(self.path)
        store.create_dir(f"{root}/{self.job}", recursive=True)
        names, out, size = [], None, 0
        for row in iterator:
            values = row.asDict()
            values["payload"] = bytes(values["payload"] or b"")
            data = record(values, self.date)
            if self.gzip:
                deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = deflate.compress(data) + deflate.flush()
            if out is None:
                names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                out, size = store.open_output_stream(f"{root}/{self.job}/{names[-1]}", compression=None), 0
            out.write(data)
            size += len(data)
            if size >= FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return _Written(names)

    def commit(self, messages) -> None:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        for message in messages:
            for name in message.names if message else ():
                store.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, root = open_store(self.path)
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class WarcSource(DataSource):
    """spark.read.format("warc") and df.write.format("warc"); register it on the session first."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_of(hexed: str) -> Column:
    """Upper-case base32 of a column of 40 hexadecimal digits: five of them make four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*(F.substring(letters, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in groups for s in (15, 10, 5, 0)))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records, in the source's columns, of pages (page_id, url, html): payloads once, else revisits."""
    own = pages.select("page_id", F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    own = own.withColumn("hexed", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = own.where(F.col("payload_bytes") >= least_bytes).groupBy("hexed").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
    # stored, so that its size is known: where it is small, Spark joins without moving the payloads
    stored = fresh_folder(pages.sparkSession, "warc-first")
    first.where(F.col("last_id") > F.col("first_id")).select("hexed", "first_id").write.parquet(stored)
    first = pages.sparkSession.read.parquet(stored)
    marked = own.join(first, "hexed", "left")
    revisit = (F.col("page_id") > F.col("first_id")) & (F.col("payload_bytes") >= least_bytes)
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return marked.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(name(F.col("page_id")), F.lit("<urn:page:none>")).alias("record_id"),
        "target_uri",
        F.lit(None).cast("string").alias("record_date"),
        "page_id",
        F.concat(F.lit("sha1:"), base32_of("hexed")).alias("payload_digest"),
        "payload_bytes",
        F.when(revisit, name(F.col("first_id"))).alias("refers_to"),
        F.when(~revisit | revisit.isNull(), F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str, compression: str = "none", date: str | None = None) -> None:
    """Append records to the archives at ``path``."""
    register(records.sparkSession)
    writer = records.write.format("warc").mode("append").option("compression", compression)
    (writer.option("date", date) if date else writer).save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records at ``path``; without payloads, blocks are skipped."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
