"""WARC archives: written from tables by tasks, read back by ranges of bytes.

Writing.  Every row becomes one record, every record one gzip member.  Rows with equal payloads of at
least ``min_bytes`` bytes are one response, the row with the largest id, and revisits that refer to it;
shorter payloads are all responses.  Which payloads repeat is counted over all rows by digest and
length.  A task writes archives of its own, each of about ``ARCHIVE_BYTES``, and they appear together
once the job has succeeded.

Reading.  Archives are cut into ranges of bytes, one task each, without an index.  A task scans its range
for the magic number of gzip and takes a candidate for a member only if it decodes to a WARC header and
to its end, check sum included, and if members follow each other from there for more than 65,535 bytes
or to the end of the file.  No deflated block holds more bytes verbatim, so a member inside of another
member's payload is never mistaken for a record.  From the first record on, members follow each other;
the task owns those that start in its range and reads the last one beyond the range's end.  Damage
between members is passed over by scanning again.

A null payload counts as empty, a null URL has no target.  A null id orders before all others; rows with
equal payloads that repeat the largest id are all responses.  Empty tables and empty or missing folders
give no records.  A payload is one value, so a record needs memory for its own payload only.  Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strataspark.llm.common import looked_up
from strataspark.session import fits_broadcast
from strataspark.sinks.committed import CommittedWriter
from strataspark.sources.shared import files_below, opened

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORT_NAME = "warc_archive"
MIN_BYTES = 0
ARCHIVE_BYTES = 1 << 30
RANGE_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"  # given tables hold no time of capture
_BLOCK = 1 << 18
_VERBATIM = 65_535  # the most bytes of a deflated block that is stored as it is
_BATCH_BYTES = 8 << 20

# Fixed values of the format.
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: F.Column) -> F.Column:
    """The SHA-1 of a binary column as 32 upper-case base32 letters."""
    digest = F.sha1(payload)
    # Ten hexadecimal digits are eight digits of base 32.
    eights = [
        F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)
    ]
    return F.translate(F.concat(*eights), _HEX32, _BASE32)


def capture_records(
    pages: DataFrame,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = MIN_BYTES,
) -> DataFrame:
    """``row_id, url, payload, payload_digest, is_revisit, refers_to, refers_url`` of every row."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id).cast("long").alias("row_id"), F.col(url).alias("url"), payload.alias("payload")
    ).select(
        "row_id", "url", "payload", base32_sha1(F.col("payload")).alias("payload_digest")
    )
    key = F.concat_ws(":", "payload_digest", F.octet_length("payload"))
    groups = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy(key.alias("_key"))
        .agg(
            F.max(F.struct(F.col("row_id"), F.col("url"))).alias("_first"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    repeated = groups.where("_rows > 1")
    keyed = rows.withColumn("_key", key)
    if fits_broadcast(repeated.select("_key", "_first.row_id", "_first.url", "_rows")):
        found = keyed.join(F.broadcast(repeated.drop("_rows")), "_key", "left")
    else:
        # Payloads then move by digest; those that many rows share stay where they are.
        found = looked_up(keyed, groups, "_key", "_rows", rows.count())
        short = keyed.where(F.octet_length("payload") < min_bytes)
        found = found.unionByName(short, allowMissingColumns=True)
    later = F.coalesce(F.col("_first.row_id") > F.coalesce(F.col("row_id"), F.lit(-(2**63))), F.lit(False))
    return found.select(
        "row_id", "url", "payload", "payload_digest",
        later.alias("is_revisit"),
        F.when(later, F.col("_first.row_id")).alias("refers_to"),
        F.when(later, F.col("_first.url")).alias("refers_url"),
    )


def record_id(row_id: int | None) -> str:
    return f"<urn:x-row:{'' if row_id is None else row_id}>"


def _row_of(uri: str | None) -> int | None:
    number = (uri or "").rpartition(":")[2].rstrip(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _line(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def record_bytes(
    row_id: int | None,
    url: str | None,
    payload: bytes,
    digest: str,
    is_revisit: bool,
    refers_to: int | None,
    refers_url: str | None,
    date: str = DATE,
) -> bytes:
    """One record as it lies in an archive before compression."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if is_revisit else http + payload
    lines = [
        _VERSION.decode(),
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(row_id)}",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    lines.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    if is_revisit:
        lines.append(f"WARC-Profile: {_PROFILE}")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_line(refers_url)}")
    lines.append("Content-Type: application/http; msgtype=response")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _information(name: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    lines = (
        f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{name}>\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\n"
        f"Content-Length: {len(body)}\r\n\r\n"
    )
    return _VERSION + b"\r\n" + lines.encode() + body + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class WarcWriter(CommittedWriter):
    """Archives of one task; a new one begins when the last is large enough."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.level = int(options.get("level", 6))
        self.archive_bytes = int(options.get("archivebytes", ARCHIVE_BYTES))
        self.date = options.get("date", DATE)

    def write_files(self, batches: Iterator[pa.RecordBatch], open_file) -> None:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        stream, size, count = None, 0, 0
        try:
            for batch in batches:
                columns = [
                    batch.column(batch.schema.get_field_index(c))
                    for c in ("row_id", "url", "payload", "payload_digest", "is_revisit", "refers_to", "refers_url")
                ]
                for row in zip(*columns, strict=True):
                    if stream is None or size >= self.archive_bytes:
                        if stream is not None:
                            stream.close()
                        name = f"{self.job[:12]}-{task:06d}-{count:04d}.warc.gz"
                        stream, count = open_file(name), count + 1
                        size = stream.write(_member(_information(name), self.level))
                    record = record_bytes(*[v.as_py() for v in row], self.date)
                    size += stream.write(_member(record, self.level))
        finally:
            if stream is not None:
                stream.close()


@dataclass
class Record:
    """One record: where its member lies, its header fields by lower-case name, its block."""

    start: int
    end: int
    fields: dict[str, str]
    block: bytes


class _Ahead:
    """A file read in blocks, of which a window is kept."""

    def __init__(self, stream: pa.NativeFile, size: int) -> None:
        self.stream, self.size = stream, size
        self.at, self.bytes = 0, b""

    def read(self, at: int, least: int) -> bytes:
        """The bytes from ``at``, at least so many unless the file ends."""
        if at < self.at or at > self.at + len(self.bytes):
            self.at, self.bytes = at, b""
        while len(self.bytes) - (at - self.at) < least and self.at + len(self.bytes) < self.size:
            self.stream.seek(self.at + len(self.bytes))
            more = self.stream.read(max(_BLOCK, least - len(self.bytes) + at - self.at))
            if not more:
                break
            self.bytes = self.bytes[at - self.at :] + more
            self.at = at
        return self.bytes[at - self.at :]


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a decoded member; None if it is no whole WARC record."""
    if not data.startswith(b"WARC/"):
        return None
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not length.isdigit() or int(length) > len(rest):
        return None
    return fields, rest[: int(length)]


def member_at(ahead: _Ahead, at: int) -> Record | None:
    """The record whose member starts at ``at``, decoded to its end; None if there is none."""
    if not ahead.read(at, 3).startswith(_MAGIC):
        return None
    unpack = zlib.decompressobj(31)
    out: list[bytes] = []
    position = at
    try:
        while not unpack.eof:
            block = ahead.read(position, 1)[:_BLOCK]
            if not block:
                return None
            out.append(unpack.decompress(block))
            if out[0] and not b"WARC/".startswith(out[0][:5]):
                return None
            position += len(block) - len(unpack.unused_data)
    except zlib.error:
        return None
    found = parse_record(b"".join(out))
    return Record(at, position, *found) if found else None


def _stands_alone(ahead: _Ahead, first: Record) -> bool:
    """Whether members follow ``first`` for more bytes than a member could hold verbatim."""
    end = first.end
    while end - first.start <= _VERBATIM:
        if end >= ahead.size:
            return True
        following = member_at(ahead, end)
        if following is None:
            return False
        end = following.end
    return True


def records_in(stream: pa.NativeFile, size: int, start: int, end: int) -> Iterator[Record]:
    """The records whose members start at ``start`` or behind it, before ``end``."""
    ahead = _Ahead(stream, size)
    at, sure = start, start == 0
    while at < end:
        found = member_at(ahead, at) if sure else None
        if found is not None:
            yield found
            at = found.end
            continue
        window = ahead.read(at, _BLOCK)
        candidate = window.find(_MAGIC, 1 if sure else 0)
        sure = False
        if candidate < 0:
            # The magic number may lie across two windows.
            at += max(1, len(window) - 2)
            continue
        at += candidate
        if at >= end:
            return
        found = member_at(ahead, at)
        if found is not None and _stands_alone(ahead, found):
            sure = True
        else:
            at += 1


@dataclass
class ByteRange(InputPartition):
    path: str = ""
    size: int = 0
    start: int = 0
    end: int = 0
    more: list = field(default_factory=list)  # further whole small files: (path, size)


_SCHEMA = (
    "path string, record_start long, record_bytes long, record_type string, record_id string, "
    "refers_to string, target_uri string, payload_digest string, payload_bytes long, "
    "payload binary, fields map<string,string>"
)


def _payload(record: Record) -> tuple[bytes | None, int | None]:
    """The payload that a record holds, and the length of the whole payload that it stands for."""
    if not record.fields.get("content-type", "").startswith("application/http"):
        return record.block, len(record.block)
    head, _, body = record.block.partition(b"\r\n\r\n")
    if record.fields["warc-type"] != "revisit":
        return body, len(body)
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return None, int(value)
    return None, None


class WarcReader(DataSourceReader):
    """Ranges of the archives of a folder."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.names
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.suffix = options.get("suffix", ".warc.gz")

    def partitions(self) -> list[InputPartition]:
        ranges: list[ByteRange] = []
        room = 0
        for path, size in files_below(self.folder, self.suffix):
            if size > self.range_bytes:
                ranges += [
                    ByteRange(path=path, size=size, start=at, end=min(at + self.range_bytes, size))
                    for at in range(0, size, self.range_bytes)
                ]
                room = 0
            elif size <= room:
                ranges[-1].more.append((path, size))
                room -= size
            else:
                ranges.append(ByteRange(path=path, size=size, start=0, end=size))
                room = self.range_bytes - size
        return ranges or [ByteRange()]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.folder)
        whole = [(path, size, 0, size) for path, size in partition.more]
        for path, size, start, end in [
            (partition.path, partition.size, partition.start, partition.end), *whole
        ]:
            with system.open_input_file(path) as stream:
                yield from self._batches(path, records_in(stream, size, start, end))

    def _batches(self, path: str, records: Iterator[Record]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        waiting = 0
        for record in records:
            payload, length = _payload(record)
            digest = record.fields.get("warc-payload-digest")
            if payload is not None:
                # What the record holds counts, not what its header says.
                digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            rows.append(
                {
                    "path": path,
                    "record_start": record.start,
                    "record_bytes": record.end - record.start,
                    "record_type": record.fields["warc-type"],
                    "record_id": record.fields.get("warc-record-id"),
                    "refers_to": record.fields.get("warc-refers-to"),
                    "target_uri": record.fields.get("warc-target-uri"),
                    "payload_digest": digest,
                    "payload_bytes": length,
                    "payload": payload,
                    "fields": list(record.fields.items()),
                }
            )
            waiting += len(record.block)
            if waiting >= _BATCH_BYTES or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, waiting = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {
            "record_start": pa.int64(), "record_bytes": pa.int64(), "payload_bytes": pa.int64(),
            "payload": pa.binary(), "fields": pa.map_(pa.string(), pa.string()),
        }
        arrays = [pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names]
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


class WarcArchive(DataSource):
    """``spark.read.format("warc_archive").load(folder)`` and the same of ``df.write``.

    Give ``.schema(...)`` with fewer columns to move only those.  Options: ``rangeBytes`` and ``suffix``
    when reading, ``level``, ``archiveBytes`` and ``date`` when writing :func:`capture_records`.
    """

    @classmethod
    def name(cls) -> str:
        return SHORT_NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def write_archives(
    pages: DataFrame,
    folder: str,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = MIN_BYTES,
    **options: str,
) -> None:
    """Write a record per row of ``pages`` to archives in ``folder``, a URI that all tasks can open."""
    pages.sparkSession.dataSource.register(WarcArchive)
    records = capture_records(pages, id, url, html, min_bytes)
    records.write.format(SHORT_NAME).options(**options).mode("append").save(folder)


def read_archives(
    spark: SparkSession, folder: str, columns: list[str] | None = None, **options: str
) -> DataFrame:
    """The records of all archives of ``folder``, those that say what an archive is included."""
    spark.dataSource.register(WarcArchive)
    schema = ", ".join(c for c in _SCHEMA.split(", ") if columns is None or c.split()[0] in columns)
    return spark.read.format(SHORT_NAME).schema(schema).options(**options).load(folder)


def row_of(record: str) -> F.Column:
    """The row id that a record's id names."""
    return F.regexp_extract(F.col(record), r"^<urn:x-row:(-?\d+)>$", 1).try_cast("long")
