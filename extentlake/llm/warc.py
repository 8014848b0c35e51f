"""Web archives in ZIP packages: a writer, and a reader that range-reads records without extraction.

A package is a ZIP file with two stored members, ``archive/data.warc.gz`` (WARC records, each a gzip
member of its own) and ``indexes/index.cdxj`` (a line per record with its offset and length).  The reader
fetches the end of the package, follows the end-of-central-directory record or its ZIP64 form to the
central directory, finds the stored members' data behind their local headers, reads the index, and then
reads runs of neighbouring records by byte range.  Packages without an index are scanned member by member.

Payloads are stored once: of equal payloads of at least ``REVISIT_BYTES`` bytes the record with the
largest key is a ``response``, the others are ``revisit`` records that refer to it; they keep the HTTP
header with the full payload's length, and its digest.  Smaller payloads are always responses, and so
are all whose equals have null keys only.  A null payload is an empty one.  Rows with equal keys and
payloads are each a record, and each a response if theirs is the largest key.

Packages go to a folder that all executors can reach.  Each task writes packages under fresh names and
returns them; the list is written as a table, so files of failed or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, shared_path, small_batches, written

#: Smallest payload that is stored once for all its copies.
REVISIT_BYTES = 1000
#: Payload bytes after which a task starts another package.
PACKAGE_BYTES = 128 << 20
#: Bytes of neighbouring records that are read at once.
RANGE_BYTES = 4 << 20

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_URN = "urn:page:"
_DATE = "1970-01-01T00:00:00Z"

RECORD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_INDEX_ROW = "package string, start long, length long, records int"


# --- writing ------------------------------------------------------------------------------------


def with_revisits(df: DataFrame, *, key: str, payload: str) -> DataFrame:
    """(key, url, payload, digest, refers_to): which rows revisit which key."""
    rows = df.select(
        F.col(key).alias("key"), "url", F.encode(F.coalesce(payload, F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    shared = (
        rows.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("key").isNotNull())
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("key").alias("first"))
    )
    joined = rows.join(shared, (F.col("digest") == F.col("_digest")) & (F.octet_length("payload") >= REVISIT_BYTES), "left")
    refers = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    # Revisits carry no payload any further, only its length.
    return joined.select(
        F.col("key").cast("string"),
        "url",
        F.octet_length("payload").cast("long").alias("size"),
        "digest",
        refers.cast("string").alias("refers_to"),
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
    )


def record_bytes(key: str | None, url: str | None, size: int, digest: str, refers_to: str | None, payload: bytes | None) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"") if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_URN}{'' if key is None else key}>"),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{_URN}{refers_to}>"),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class PackageWriter:
    """One package, written as a stream."""

    def __init__(self, sink) -> None:
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = self.payload = 0

    def add(self, record: bytes, key: str | None, url: str | None) -> None:
        data = _gzip(record)
        self.archive.write(data)
        entry = {"offset": self.at, "length": len(data), "filename": ARCHIVE, "key": key}
        self.lines.append(f"{json.dumps(url or '')} {json.dumps(entry)}\n")
        self.at += len(data)
        self.payload += len(record)

    def close(self) -> None:
        self.archive.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()


def write_packages(df: DataFrame, folder: str, *, key: str = "page_id", payload: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``df``'s rows as packages under ``folder``; the table of (package, records)."""
    small_batches(df.sparkSession)
    df = with_revisits(df, key=key, payload=payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        sink = package = None
        made: list[tuple[str, int]] = []

        def finish() -> None:
            package.close()
            sink.close()
            made.append((name, len(package.lines)))

        for batch in batches:
            for k, url, size, digest, refers, data in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    sink = store.open_output_stream(f"{base}/{name}")
                    package = PackageWriter(sink)
                package.add(record_bytes(k, url, size, digest, refers, data), k, url)
                if package.payload >= package_bytes:
                    finish()
                    package = None
        if package is not None:
            finish()
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{n}" for n, _ in made]), pa.array([r for _, r in made], pa.int64())], names=["package", "records"]
            )

    return written(df.mapInArrow(run, "package string, records long"), "packages")


# --- reading ------------------------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class Package:
    """A ZIP package behind a random-access file."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError(f"the package ends at {self.size}, within {at}+{n}")
        return bytes(data)

    def directory(self) -> tuple[int, int, int]:
        """Offset, bytes and entries of the central directory."""
        tail_at = max(0, self.size - 22 - 65535)
        tail = self.read(tail_at, self.size - tail_at)
        at = len(tail) - 22
        # The record ends with a comment, whose length must reach the end of the file.
        while at >= 0 and not (tail[at : at + 4] == b"PK\x05\x06" and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") == len(tail)):
            at -= 1
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP package")
        entries, length, offset = struct.unpack_from("<10xHII", tail, at)
        end = tail_at + at
        if (entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and end >= 20:
            locator = self.read(end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                (record_at,) = struct.unpack_from("<8xQ", locator)
                record = self.read(record_at, 56)
                if record[:4] != b"PK\x06\x06":
                    raise ValueError("the ZIP64 locator leads nowhere")
                entries, length, offset = struct.unpack_from("<32xQQQ", record)
        return offset, length, entries

    def members(self) -> list[Member]:
        offset, length, entries = self.directory()
        raw, at, found = self.read(offset, length), 0, []
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a central directory entry is damaged")
            method, packed, plain, n, extra, comment, header = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
            name = raw[at + 46 : at + 46 + n].decode("utf-8", "replace")
            fields = raw[at + 46 + n : at + 46 + n + extra]
            # The ZIP64 field has, in this order, those values that do not fit.
            where = 0
            while where + 4 <= len(fields):
                kind, size = struct.unpack_from("<HH", fields, where)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{size // 8}Q", fields, where + 4))
                    plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    header = wide.pop(0) if header == 0xFFFFFFFF else header
                where += 4 + size
            found.append(Member(name, method, packed, header))
            at += 46 + n + extra + comment
        return found

    def data_at(self, member: Member) -> int:
        """Where a stored member's data starts."""
        if member.method != 0:
            raise ValueError(f"{member.name} is compressed in the package, so its records cannot be read by range")
        head = self.read(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{member.name} has no local header")
        n, extra = struct.unpack_from("<26xHH", head)
        return member.header + 30 + n + extra

    def ranges(self) -> Iterator[tuple[int, int]]:
        """Start and length in the package of every record of every archive member, in order."""
        members = {m.name: m for m in self.members()}
        indexed: dict[str, list[tuple[int, int]]] = {}
        for name, m in members.items():
            if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx.json")):
                for line in self.read(self.data_at(m), m.size).decode().splitlines():
                    entry = json.loads(line[line.rindex("{") :])
                    indexed.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
        for name, m in members.items():
            if not (name.startswith("archive/") and name.endswith(".warc.gz")):
                continue
            base = self.data_at(m)
            if name in indexed:
                yield from ((base + at, n) for at, n in sorted(indexed[name]))
            else:
                yield from self._scanned(base, m.size)

    def _scanned(self, base: int, size: int) -> Iterator[tuple[int, int]]:
        """The gzip members of an archive that has no index."""
        at, start, pending, unpack = 0, 0, b"", zlib.decompressobj(31)
        while at < size or pending:
            if not pending:
                n = min(1 << 20, size - at)
                pending = self.read(base + at, n)
                at += n
            unpack.decompress(pending)
            pending = b""
            if unpack.eof:
                pending = unpack.unused_data
                end = at - len(pending)
                yield base + start, end - start
                start, unpack = end, zlib.decompressobj(31)
        if start != size:
            raise ValueError("the archive ends within a record")


def parse_record(data: bytes) -> dict:
    """The fields of an unpacked record, by RECORD's names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]

    def page(field: str) -> str | None:
        return fields[field].strip("<>").removeprefix(_URN) or None if field in fields else None

    revisit = fields["warc-type"] == "revisit"
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    return {
        "key": page("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": page("warc-refers-to"),
        "payload_bytes": lengths[0] if revisit and lengths else len(payload),
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def _opened(path: str) -> Package:
    store, inner = pafs.FileSystem.from_uri(path)
    file = store.open_input_file(inner)
    return Package(file, file.size())


def read_packages(packages: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the packages named in column ``package``, as RECORD."""
    spark: SparkSession = packages.sparkSession
    small_batches(spark)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, package = [], _opened(path)
                start = length = n = 0
                for at, size in package.ranges():
                    if n and (at != start + length or length + size > range_bytes):
                        rows.append((path, start, length, n))
                        n = 0
                    if not n:
                        start, length = at, 0
                    length, n = length + size, n + 1
                if n:
                    rows.append((path, start, length, n))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["package", "start", "length", "records"]
                    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, start, length, n in zip(*(c.to_pylist() for c in batch.columns)):
                rest, rows = _opened(path).read(start, length), []
                while rest:
                    unpack = zlib.decompressobj(31)
                    rows.append(parse_record(unpack.decompress(rest) + unpack.flush()))
                    if not unpack.eof:
                        raise ValueError(f"{path}: a record at {start}+{length} is cut short")
                    rest = unpack.unused_data
                if len(rows) != n:
                    raise ValueError(f"{path}: {n} records were expected at {start}+{length}, not {len(rows)}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[f] for r in rows], t) for f, t in zip(RECORD.names, kinds)], names=RECORD.names
                )

    # The rows of both tables are few but stand for many bytes: their tasks are not to be merged by size.
    spread = packages.select("package").repartition(partitions(spark), "package")
    ranges = spread.mapInArrow(locate, _INDEX_ROW).repartition(4 * partitions(spark), "package", "start")
    return ranges.mapInArrow(fetch, RECORD)


def round_trip(df: DataFrame, *, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Write ``df`` (key, url, payload) as packages in the shared folder and read them back."""
    return read_packages(write_packages(df, shared_path(df.sparkSession, "archives"), key=key, payload=payload))


def memory_package(records: list[tuple[bytes, str | None, str | None]]) -> bytes:
    """A package of some records, for small uses."""
    sink = io.BytesIO()
    package = PackageWriter(sink)
    for r in records:
        package.add(*r)
    package.close()
    return sink.getvalue()
