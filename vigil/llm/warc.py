"""WARC archives as a Spark data source, for writing and reading.

`spark.dataSource.register(WarcSource)`, then `df.write.format("warc").save(folder)` and
`spark.read.format("warc").load(folder)`. Each record written is a gzip member of its own whose extra field
holds the member's length. A reader plans byte ranges of the files as partitions (`partitionBytes`) and
finds the first member of its range by a gzip header that inflates to a record's. It inflates a member's
headers first; where a pushed predicate on the record type or another header column fails, or `payload` is
"false", it steps over the rest of the member without inflating it.

Archives of other writers are read as well: members without a length, which are inflated to their end in
blocks and not kept, members of several records, and uncompressed `.warc` files. Their record ids are in
`record_id`; `page_id` and `refers_to` are those of archives written here, else null.

Paths may lie in any store that pyarrow opens: local, hdfs, s3, gs.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .shared import discard, shared_dir, skew_join, stored

SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, payload binary"
PARTITION_BYTES = 64 << 20
#: gzip header: deflate, extra field present, no time, unknown system; then one subfield SL of eight bytes.
MAGIC = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00SL\x08\x00"
HEAD = len(MAGIC) + 8
PREFIX = "urn:x-page:"
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = {"page_id": "WARC-Record-ID", "url": "WARC-Target-URI", "record_type": "WARC-Type", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length", "payload_digest": "WARC-Payload-Digest", "record_id": "WARC-Record-ID"}
BLOCK = 65536


def opened(path: str):
    """The pyarrow file system of a path and the path in it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record as one gzip member; headers that are None are left out."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    raw = head.encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = squeeze.compress(raw) + squeeze.flush()
    end = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    return MAGIC + struct.pack("<II", HEAD + len(body) + 8, len(raw) & 0xFFFFFFFF) + body + end


def clean(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, record_type: str, refers_to: int | None, payload: bytes) -> bytes:
    """A response with its payload, or a revisit, whose payload is that of the record it refers to."""
    revisit = record_type == "revisit"
    return member(
        [
            ("WARC-Type", record_type),
            ("WARC-Record-ID", f"<{PREFIX}{'' if page_id is None else page_id}>"),
            ("WARC-Date", EPOCH),
            ("WARC-Target-URI", clean(url)),
            ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
            ("X-Payload-Length", len(payload)),
            ("WARC-Profile", REVISIT if revisit else None),
            ("WARC-Refers-To", f"<{PREFIX}{refers_to}>" if revisit else None),
        ],
        b"" if revisit else payload,
    )


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str


def parsed(head: bytes) -> dict[str, str]:
    """The headers of a record, names in lower case; a line that begins with white space continues the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _page(value: str | None) -> int | None:
    inner = (value or "").strip("<>")
    number = inner.removeprefix(PREFIX) if inner.startswith(PREFIX) else ""
    return int(number) if number.lstrip("-").isdigit() else None


def _number(value: str | None) -> int | None:
    return int(value) if value and value.isdigit() else None


def columns(headers: dict[str, str]) -> tuple:
    size = _number(headers.get("x-payload-length"))
    return (
        _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), headers.get("warc-type"), _page(headers.get("warc-refers-to")),
        size if size is not None else _number(headers.get("content-length")), headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        headers.get("warc-record-id", "").strip("<>") or None,
    )


class Inflated:
    """The bytes of one gzip member, or of an uncompressed file, from `at` on; no more than what is asked for is kept."""

    def __init__(self, f, at: int, packed: bool):
        self.f, self.at, self.read, self.kept, self.done = f, at, 0, b"", False
        self.inflate = zlib.decompressobj(16 + zlib.MAX_WBITS) if packed else None
        f.seek(at)

    def more(self, most: int = BLOCK) -> bool:
        """Takes up to `most` more bytes; false at the end."""
        if self.done:
            return False
        if self.inflate is None:
            data = self.f.read(most)
            self.done = not data
            self.read += len(data)
            self.kept += data
            return not self.done
        tail = self.inflate.unconsumed_tail
        if not tail:
            tail = self.f.read(4096 if not self.read else BLOCK)
            self.read += len(tail)
            if not tail:
                raise ValueError(f"the archive ends within the member at byte {self.at}")
        self.kept += self.inflate.decompress(tail, most)
        self.done = self.inflate.eof
        return True

    def head(self) -> bytes | None:
        """A record's headers; null if there is no record any more."""
        while b"\r\n\r\n" not in self.kept:
            if not self.more(2048):
                return None
        self.kept = self.kept.lstrip(b"\r\n")
        while b"\r\n\r\n" not in self.kept:
            if not self.more(2048):
                return None
        head, _, self.kept = self.kept.partition(b"\r\n\r\n")
        return head

    def take(self, n: int, keep: bool = True) -> bytes:
        out = bytearray()
        while n > 0 and (self.kept or self.more(min(n, BLOCK))):
            some, self.kept = self.kept[:n], self.kept[n:]
            n -= len(some)
            out += some if keep else b""
        if n > 0:
            raise ValueError(f"the archive ends within a record of the member at byte {self.at}")
        return bytes(out)

    def end(self) -> int:
        """The place after the member."""
        while self.more():
            self.kept = b""
        return self.at + self.read - (len(self.inflate.unused_data) if self.inflate else 0)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.bytes, self.filters = int(options.get("partitionbytes", PARTITION_BYTES)), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and prefix tests on header columns; yields the others back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in COLUMNS and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.filters.append((list(COLUMNS).index(name), type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = opened(self.path)
        info = store.get_file_info(root)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.is_file and f.path.endswith((".warc.gz", ".warc")))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        return [Range(scheme + p if scheme and "://" not in p else p, a, min(a + self.bytes, size)) for p, size in files for a in range(0, size, self.bytes)] or [Range("", 0, 0)]

    def wanted(self, row: tuple) -> bool:
        for i, kind, value in self.filters:
            x = row[i]
            if x is None or kind == "EqualTo" and x != value or kind == "In" and x not in value or kind == "StringStartsWith" and not x.startswith(value):
                return False
        return True

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        store, path = opened(partition.path)
        packed = path.endswith(".gz")
        with store.open_input_file(path) as f:
            size = f.size()
            at = (first_member if packed else first_record)(f, partition.start, size)
            while at < min(partition.end, size):
                at = yield from self.member(f, at, packed, path, size if packed else min(partition.end, size))

    def member(self, f, at: int, packed: bool, path: str, end: int):
        """The wanted records of a member, or of an uncompressed file from `at` to `end`; returns where the next one begins."""
        length = member_length(f, at) if packed else None
        data = Inflated(f, at, packed)
        while packed or at + data.read - len(data.kept) < end:
            head = data.head()
            if head is None:
                break
            headers = parsed(head)
            row, size = columns(headers), _number(headers.get("content-length"))
            if size is None:
                raise ValueError(f"{path}: the record in the member at byte {at} has no length")
            wanted = self.wanted(row)
            keep = wanted and self.payload and row[2] != "revisit"
            if length and not keep:
                if wanted:
                    yield (*row, None)
                return at + length
            payload = data.take(size, keep)
            if keep and "x-payload-length" in headers and digest(payload) != row[5]:
                raise ValueError(f"{path}: a payload in the member at byte {at} does not have its digest")
            if wanted:
                yield (*row, payload if keep else None)
        return data.end() if packed else end


def member_length(f, at: int) -> int | None:
    """The length in the extra field of a member written here; null for others."""
    f.seek(at)
    head = f.read(HEAD)
    return struct.unpack_from("<I", head, len(MAGIC))[0] if head.startswith(MAGIC) and len(head) == HEAD else None


def first_member(f, start: int, size: int) -> int:
    """The place of the first gzip member at or after `start` that begins with a record."""
    at = start
    while at < size:
        f.seek(at)
        data = f.read(min((1 << 20) + 1024, size - at))
        k = data.find(b"\x1f\x8b\x08")
        while 0 <= k < 1 << 20:
            try:
                if zlib.decompressobj(16 + zlib.MAX_WBITS).decompress(data[k : k + 1024], 8).startswith(b"WARC/1."):
                    return at + k
            except zlib.error:
                pass
            k = data.find(b"\x1f\x8b\x08", k + 1)
        at += 1 << 20
    return size


def first_record(f, start: int, size: int) -> int:
    """The place of the first record at or after `start` in an uncompressed file: after a blank line, with a type and a length."""
    at = max(0, start - 4)
    while at < size:
        f.seek(at)
        data = f.read(min((1 << 20) + 4096, size - at))
        k = data.find(b"WARC/1.")
        while 0 <= k < (1 << 20) + 4:
            names = parsed(data[k : k + 4096].partition(b"\r\n\r\n")[0])
            if at + k >= start and (at + k == 0 or data[max(0, k - 4) : k] == b"\r\n\r\n") and "warc-type" in names and "content-length" in names:
                return at + k
            k = data.find(b"WARC/1.", k + 1)
        at += 1 << 20
    return size


class WarcWriter(DataSourceWriter):
    """Each task writes one file under a hidden name; the commit renames those of the tasks that count."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"].rstrip("/"), schema.fieldNames()

    def write(self, rows: Iterator) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        path = f"{root}/.{uuid.uuid4()}.tmp"
        with store.open_output_stream(path) as out:
            for r in rows:
                out.write(record(r["page_id"], r["url"], r["record_type"], r["refers_to"], bytes(r["payload"] or b"")))
        return Written(path)

    def commit(self, messages: list) -> None:
        store, _ = opened(self.path)
        for i, m in enumerate(x for x in messages if x):
            folder, _, name = m.path.rpartition("/")
            store.move(m.path, f"{folder}/part-{i:05d}-{name[1:-4]}.warc.gz")

    def abort(self, messages: list) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m:
                store.delete_file(m.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, schema)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records of `pages`: page_id, url, record_type, refers_to, payload.

    Of rows with equal payloads (null counts as empty) that with the smallest id is a response, the others
    are revisits of it. Of rows that also share that id, all are responses. Rows with a null id are
    responses. Payloads are compared by SHA-1 and length; only ids and these pass the grouping, and payloads
    meet the ids of revisits.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    prints = stored(rows.select("page_id", "sha", "size"), "payloads")
    same = prints.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    same = stored(same, "same")
    again = skew_join(prints, same, ["sha", "size"], prints.count()).filter("page_id > first")
    again = stored(again.select("page_id", "sha", "size", "first").distinct(), "revisits")
    discard(prints, same)
    found = rows.join(again, ["page_id", "sha", "size"], "left")
    return found.select("page_id", "url", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to"), "payload")


def archive(pages: DataFrame, folder: str | None = None) -> str:
    """Writes a record per row of `pages` and returns the folder: by default a new one in the shared folder."""
    spark = registered(pages.sparkSession)
    folder = folder or f"{shared_dir(spark)}/vigil-warc-{uuid.uuid4()}"
    records(pages).write.format("warc").mode("append").save(folder)
    return folder


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of the archives in `folder`; with `payload` false that column is null and nothing is inflated but headers."""
    return registered(spark).read.format("warc").option("payload", str(payload).lower()).load(folder)
