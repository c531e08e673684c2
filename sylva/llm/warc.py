"""WARC archives as a PySpark Python data source, and pages written to them with revisit records.

Reading. The driver plans partitions from the list of files: large files alone, small ones together up to
partition_bytes. Filters on record type and on the header columns are pushed down. A reader inflates a record's headers
first, which costs a kilobyte or so; only if they pass and the payload is asked for does it inflate the rest. Records
written here are gzip members of their own whose extra field SL holds the member's compressed length, so an unwanted
payload is skipped by a seek; in other archives it is inflated in blocks to find its end, but not decoded or kept.

Writing. A task writes files of at most about file_bytes under names of its own; the driver then lists the files of
the tasks that counted in a manifest. Files of failed or repeated tasks are not in the manifest and are not read.

Files are reached through pyarrow's file systems, so a path may be local or, say, hdfs:// or s3://.

Cases: null payloads are empty; a null header value is left out and read as null; line breaks in header values are
percent-encoded; an empty table gives a folder with an empty manifest; a folder without a manifest is read by its
*.warc and *.warc.gz files; extra columns are not written.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from sylva.llm._common import small_or_shuffled, stage_path, stage_table

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: WARC header of each string column.
HEADERS = {
    "record_type": b"WARC-Type",
    "record_id": b"WARC-Record-ID",
    "target_uri": b"WARC-Target-URI",
    "date": b"WARC-Date",
    "refers_to": b"WARC-Refers-To",
    "payload_digest": b"WARC-Payload-Digest",
}
LENGTH_HEADER = b"X-Payload-Length"
MANIFEST = "_manifest.json"
NO_DATE = "1970-01-01T00:00:00Z"
LEAST_REVISIT = 100
BLOCK = 1 << 16
MAX_BROADCAST_ROWS = 100_000
_BRACKETED = {"record_id", "refers_to"}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")


def member(data: bytes, level: int) -> bytes:
    """data as one gzip member with its compressed and plain length in the extra field SL."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if size >= 1 << 32 or len(data) >= 1 << 32:
        extra = b"\x00" * 8  # too long for SL: a reader inflates to find the end
    else:
        extra = struct.pack("<II", size, len(data))
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<H", 8) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. A response carries its payload behind an HTTP head; a revisit carries the HTTP head alone."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "resource"
    lines = [b"WARC/1.1"]
    for column, name in HEADERS.items():
        if (value := row.get(column)) is not None:
            raw = value.encode().replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A") if column == "target_uri" and ("\r" in value or "\n" in value) else value.encode()
            lines.append(name + b": " + (b"<" + raw + b">" if column in _BRACKETED else raw))
    if row.get("payload_length") is not None:
        lines.append(LENGTH_HEADER + b": " + str(row["payload_length"]).encode())
    block = payload
    if kind in ("response", "revisit"):
        lines.append(b"Content-Type: application/http;msgtype=response")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    if kind == "revisit":
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(b"Content-Length: " + str(len(block)).encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Source:
    """Bytes of an archive at a moving place: plain, or inflated member by member."""

    def __init__(self, stream, gz: bool):
        self.stream, self.gz, self.raw, self.plain, self.z, self.start, self.skip = stream, gz, b"", b"", None, 0, 0

    def _more(self) -> bool:
        """Adds plain bytes; false at the end of the member, or of a plain file."""
        if not self.gz:
            got = self.stream.read(BLOCK)
            self.plain += got
            return bool(got)
        if self.z.eof:
            return False
        got = self.raw or self.stream.read(BLOCK)
        out = self.z.decompress(got, 2048)
        if not got and not out and not self.z.eof:
            raise EOFError("the archive ends within a record")
        self.plain += out
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def open(self) -> bool:
        """Moves to the next record; false at the end of the file."""
        if not self.gz:
            while not self.plain.lstrip(b"\r\n"):
                if not self._more():
                    return False
            self.plain = self.plain.lstrip(b"\r\n")
            return True
        while len(self.raw) < 24 and (got := self.stream.read(BLOCK)):
            self.raw += got
        if not self.raw:
            return False
        self.plain, self.z = b"", zlib.decompressobj(31)
        self.skip = struct.unpack("<I", self.raw[16:20])[0] if self.raw[3:4] == b"\x04" and self.raw[12:16] == b"SL\x08\x00" else 0
        self.start = self.stream.tell() - len(self.raw)
        return True

    def head(self) -> bytes:
        while (at := self.plain.find(b"\r\n\r\n")) < 0:
            if not self._more():
                raise EOFError("the archive ends within a header")
        out, self.plain = self.plain[:at], self.plain[at + 4 :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.plain], len(self.plain)
        while have < n:
            self.plain = b""
            if not self._more():
                raise EOFError("the archive ends within a payload")
            parts.append(self.plain)
            have += len(self.plain)
        data = b"".join(parts)
        self.plain = data[n:]
        return data[:n]

    def close(self, n: int) -> None:
        """Leaves the record, of whose block n bytes have not been taken."""
        if self.gz and self.skip:
            self.stream.seek(self.start + self.skip)
            self.raw = b""
            return
        if not self.gz:
            while len(self.plain) < n:
                n -= len(self.plain)
                self.plain = b""
                if not self._more():
                    return
            self.plain = self.plain[n:]
            return
        while self._more():
            self.plain = b""


def read_records(stream, gz: bool, passes, want_payload: bool) -> Iterator[dict]:
    """The records whose headers pass. passes: a function of the columns other than payload."""
    back = {v.lower(): k for k, v in HEADERS.items()}
    source = _Source(stream, gz)
    while source.open():
        fields: dict[bytes, bytes] = {}
        for line in source.head().split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields.setdefault(name.strip().lower(), value.strip())
        row: dict = dict.fromkeys((*HEADERS, "payload_length", "payload"))
        for name, column in back.items():
            if name in fields:
                value = fields[name].decode("utf-8", "replace")
                row[column] = value[1:-1] if column in _BRACKETED and value[:1] == "<" else value
        if LENGTH_HEADER.lower() in fields:
            row["payload_length"] = int(fields[LENGTH_HEADER.lower()])
        left = int(fields.get(b"content-length", b"0"))
        if passes(row):
            if want_payload and row["record_type"] != "revisit":
                block, left = source.take(left), 0
                if fields.get(b"content-type", b"").startswith(b"application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                row["payload"] = block
            yield row
        source.close(left)


@dataclass
class _Files(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pushed = options["path"], []
        self.want_payload = str(options.get("payload", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column not in HEADERS and column != "payload_length" or not isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull):
                yield f
            elif isinstance(f, IsNull | IsNotNull):
                self.pushed.append((column, None, isinstance(f, IsNull)))
            else:
                self.pushed.append((column, frozenset(f.value if isinstance(f, In) else [f.value]), isinstance(f, EqualNullSafe)))

    def _passes(self, row: dict) -> bool:
        for column, values, null in self.pushed:
            value = row[column]
            if values is None:
                if (value is None) != null:
                    return False
            elif value not in values or value is None and not null:
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, base = _filesystem(self.path)
        if system.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{base}/{MANIFEST}") as f:
                found = [(n, size) for n, size in json.loads(f.read())]
        else:
            found = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(base)) if i.base_name.endswith((".warc", ".warc.gz"))]
        groups: list[_Files] = []
        room = 0
        for name, size in sorted(found):
            if not groups or size > room:
                groups.append(_Files([]))
                room = self.partition_bytes
            groups[-1].files.append(name)
            room -= size
        return groups or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(self.path)
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())])
        for name in partition.files:
            with system.open_input_file(f"{base}/{name}") as stream:
                rows, held = [], 0
                for row in read_records(stream, name.endswith(".gz"), self._passes, self.want_payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.level = options["path"], int(options.get("level", 1))
        self.file_bytes = int(options.get("file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, base = _filesystem(self.path)
        system.create_dir(base, recursive=True)
        files, out, size, name = [], None, 0, ""
        for batch in iterator:
            for i in range(batch.num_rows):
                data = member(record_bytes(batch.slice(i, 1).to_pylist()[0]), self.level)
                if out is None or size + len(data) > self.file_bytes:
                    if out is not None:
                        out.close()
                        files.append((name, size))
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, base = _filesystem(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        system, base = _filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                system.delete_file(f"{base}/{name}")


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(path); df.write.format("warc").mode("append").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets its filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, least: int = LEAST_REVISIT, date: str = NO_DATE) -> DataFrame:
    """pages (page_id, url, html) as records of SCHEMA.

    Of equal payloads of at least `least` bytes the smallest page_id is the response and the others are revisits of it;
    rows that also share that page_id, or hold the payload where no page_id is known, are responses.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    keys = rows.where(F.col("payload_length") >= least).select("page_id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = stage_table(
        keys.join(first.select("payload_digest", "first"), "payload_digest").where("not page_id <=> first").select("page_id", "payload_digest", "first").distinct(),
        "revisits",
    )
    revisits = small_or_shuffled(revisits, MAX_BROADCAST_ROWS).select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), "first")
    urn = lambda c: F.concat(F.lit("urn:x-page:"), c.cast("string"))
    again = F.col("first").isNotNull()
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        urn(F.col("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("payload_digest")).alias("payload_digest"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of pages, written to the shared folder and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    What a response reports is computed from the payload read back; a revisit has no payload and reports its headers.
    """
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write_pages(pages, path)
    read = spark.read.format("warc").load(path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.element_at(F.split(c, ":"), -1).cast("long")
    full = F.col("payload").isNotNull()
    return read.select(
        number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
