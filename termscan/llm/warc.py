"""WARC archives, one gzip member per record: written by tasks, read in byte ranges.

Each task writes files of its own into a folder that all executors share and returns their names; the
table of the names that Spark accepted is the archive, so files of lost or repeated attempts are never
read. Readers get byte ranges of these files. A task looks in its range for the magic number of gzip,
takes a place for the start of a record only if a member decodes there, by its checksum, to a WARC
header, and owns the records that start inside its range; from one record it goes on where the member ends.

A range that starts inside a record which stores another archive uncompressed finds the inner records
too. Then the records of two ranges overlap, and the file is read again in one range.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termscan.llm.common import durable, small_batches
from termscan.session import shared_folder, small_enough_to_broadcast

#: Payloads from this size on are stored once.
LEAST_SHARED = 1000
#: Bytes from which a task starts another file, bytes of a range, bytes read and decoded at a time.
FILE_BYTES, RANGE_BYTES = 1 << 30, 64 << 20
READ_BYTES, STEP_BYTES = 4 << 20, 1 << 14
#: Bytes of a row of stored payloads in a broadcast.
KEEPER_BYTES = 100
#: The type of the row that tells what a range holds.
SPAN = "#span"

MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: Fixed by the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES_SCHEMA = "path string, records long, bytes long"
_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS_SCHEMA = (
    "path string, offset long, bytes long, record_type string, record_id string, target_uri string, refers_to_id string, "
    "payload_digest string, content_length long, payload binary"
)
_RECORDS = pa.schema(
    [
        ("path", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
        ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("content_length", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (arrow_fs.LocalFileSystem(), path)


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _record(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}".encode()]
    head += [f"{name}: {_one_line(value)}".encode() for name, value in fields if value is not None]
    head.append(f"Content-Length: {len(block)}".encode())
    return _member(b"\r\n".join(head) + END + block + END)


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value) if re.search(r"[\r\n\x00]", value) else value


def _write_kernel(folder: str, date: str):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        out, path, name, records, size, done = None, "", "", 0, 0, []
        try:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("record_id", "uri", "digest", "n_bytes", "refers_to", "refers_to_uri")]
                for record_id, uri, digest, n_bytes, refers_to, refers_uri, payload in zip(*columns, batch.column("payload")):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                        info = f"<urn:uuid:{uuid.uuid4()}>"
                        head = _record("warcinfo", [("WARC-Record-ID", info), ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                                       b"format: WARC File Format 1.1\r\n")
                        out.write(head)
                        size, records = len(head), 1
                    kind = "response" if refers_to is None else "revisit"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
                    fields = [
                        ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri),
                        ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
                    ]
                    if kind == "revisit":
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to), ("WARC-Refers-To-Target-URI", refers_uri)]
                    data = _record(kind, fields, http if kind == "revisit" else http + (payload.as_py() or b""))
                    out.write(data)
                    size, records = size + len(data), records + 1
                    if size >= FILE_BYTES:
                        out.close()
                        done.append((f"{folder}/{name}", records, size))
                        out = None
            if out is not None:
                out.close()
                done.append((f"{folder}/{name}", records, size))
                out = None
        finally:
            if out is not None:
                out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done), _FILES)], schema=_FILES)

    return kernel


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``(record_id, uri, digest, n_bytes, refers_to, refers_to_uri, payload)``; returns ``(path, records, bytes)`` of the files.

    Rows with ``refers_to`` become revisits without a payload. Each partition makes one file per gigabyte.
    """
    spark = records.sparkSession
    small_batches(spark)
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return durable(records.mapInArrow(_write_kernel(folder, date), FILES_SCHEMA), "warc-files")


class _File:
    """A file read ahead in blocks."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.source = system.open_input_file(name)
        self.size = self.source.size()
        self.base, self.block = 0, b""

    def _hold(self, place: int) -> int:
        """Reads on so that the block holds ``place``, if the file does; where in the block it is."""
        if not self.base <= place < self.base + len(self.block):
            self.base, self.block = place, self.source.read_at(min(READ_BYTES, max(self.size - place, 0)), place)
        return place - self.base

    def at(self, place: int, count: int) -> bytes:
        """Up to ``count`` bytes from ``place``; fewer at the end of a block, none at the end of the file."""
        at = self._hold(place)
        return self.block[at : at + count]

    def close(self) -> None:
        self.source.close()

    def magic(self, place: int, end: int) -> int | None:
        """The first place from ``place`` on and before ``end`` where the magic number stands."""
        while place < end:
            at = self._hold(place)
            found = self.block.find(MAGIC, at)
            if found >= 0:
                return self.base + found if self.base + found < end else None
            after = self.base + len(self.block)
            if after >= self.size:
                return None
            # the number may stand across the end of the block
            place = max(place, after - len(MAGIC) + 1)
            if place + len(MAGIC) > after:
                self.base, self.block = place, self.source.read_at(min(READ_BYTES, self.size - place), place)
        return None

    def member(self, place: int) -> tuple[bytes, int] | None:
        """The data of the member at ``place`` and where it ends, if it is whole and starts as a WARC record does."""
        unpack, data, now = zlib.decompressobj(31), [], place
        try:
            while not unpack.eof:
                part = self.at(now, STEP_BYTES)
                if not part:
                    return None
                now += len(part)
                data.append(unpack.decompress(part))
                if len(data) == 1 and data[0] and not data[0].startswith(b"WARC/"[: len(data[0])]):
                    return None
        except zlib.error:
            return None
        whole = b"".join(data)
        return (whole, now - len(unpack.unused_data)) if whole.startswith(b"WARC/") else None


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t"):
            out[name] = f"{out.get(name, '')} {text.strip()}"
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out.setdefault(name, value.strip())
    return out


def parse(data: bytes) -> dict | None:
    """The fields of a record and its payload; None if the header does not say how long the block is, or says it wrong."""
    head, mark, rest = data.partition(END)
    fields = _fields(head)
    length = fields.get("content-length", "")
    if not mark or not length.isdigit() or len(rest) < int(length):
        return None
    block, content_length, payload = rest[: int(length)], int(length), rest[: int(length)]
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(END)
        said = _fields(http).get("content-length", "")
        content_length = int(said) if said.isdigit() else len(payload)
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest")
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"), "payload_digest": digest.partition(":")[2] if digest else None,
        "content_length": content_length, "payload": None if kind == "revisit" else payload,
    }


def _read_kernel(spans: bool):
    """With ``spans`` each range gives one row more, of type ``SPAN``: from its first record to the end of its last."""
    names = [f.name for f in _RECORDS]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                file = _File(path)
                rows, held, place, first = [], 0, start, None
                while (found := file.magic(place, end)) is not None:
                    member = file.member(found)
                    record = parse(member[0]) if member else None
                    if record is None:
                        place = found + 1
                        continue
                    first = found if first is None else first
                    place = member[1]
                    rows.append(record | {"path": path, "offset": found, "bytes": place - found})
                    held += len(member[0])
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS).select(names)
                        rows, held = [], 0
                file.close()
                if spans and first is not None:
                    rows.append({"path": path, "offset": first, "bytes": place - first, "record_type": SPAN})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS).select(names)

    return kernel


def read(files: DataFrame, range_bytes: int | None = RANGE_BYTES, spans: bool = False) -> DataFrame:
    """The records of the files ``(path, bytes)``, each read in ranges of ``range_bytes`` or, without it, in one.

    Bytes between records that decode to none are passed over. A payload is what follows the HTTP header
    of a record, or the whole block where there is none; revisits have a null one, and ``content_length``
    is what their HTTP header says.
    """
    small_batches(files.sparkSession)
    size = (F.lit(range_bytes) if range_bytes else F.greatest(F.col("bytes"), F.lit(1))).cast("long")
    # a task per range, as Spark would put the short rows that name them into one
    n = files.agg(F.sum(F.ceil(F.col("bytes") / size))).first()[0] or 1
    starts = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, size)).alias("start"))
    ranges = starts.select("path", "start", F.least("bytes", F.col("start") + size).alias("end"))
    return ranges.repartition(int(n)).mapInArrow(_read_kernel(spans), RECORDS_SCHEMA)


def read_whole(files: DataFrame, columns: list, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``columns`` of all records, written down once; files in which ranges overlap are read again in one range."""
    first = read(files, range_bytes, spans=True).select("path", "offset", "bytes", F.col("record_type").alias("__type"), *columns)
    first = durable(first, "warc-records")
    spans = first.where(F.col("__type") == SPAN).select("path", "offset", (F.col("offset") + F.col("bytes")).alias("after"))
    before = F.max("after").over(Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1))
    overlapping = spans.withColumn("before", before).where("offset < before").select("path").distinct()
    again = durable(files.join(overlapping, "path").select("path", "bytes"), "warc-overlaps")
    records = first.where(F.col("__type") != SPAN).drop("offset", "bytes", "__type")
    if not again.isEmpty():
        records = records.join(again.select("path"), "path", "left_anti").select("path", *records.columns[1:])
        records = records.union(read(again, None).select("path", *columns))
    return records.drop("path")


def stored(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Rows for ``write``: of equal payloads of at least ``least`` bytes that with the largest id is stored, the others refer to it.

    Payloads are equal if their lengths and SHA-1 are. A null payload is empty, a null id smaller than any
    other and stands as an empty id. Rows that repeat the largest id are all stored.
    """
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.length("payload").cast("long")})
    thin = rows.where(F.col("n_bytes") >= least).select("digest", "n_bytes", "order", "id", "uri")
    # nulls come first among structs, so the largest one has the largest id
    keepers = thin.groupBy("digest", "n_bytes").agg(F.max(F.struct("order", "id", "uri")).alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    keepers = durable(keepers.select("digest", "n_bytes", F.col("kept.id").alias("kept_id"), F.col("kept.uri").alias("kept_uri")), "warc-keepers")
    if small_enough_to_broadcast(keepers.count() * KEEPER_BYTES):
        keepers = F.broadcast(keepers)
    joined = rows.join(keepers.withColumn("shared", F.lit(True)), ["digest", "n_bytes"], "left")
    revisit = F.coalesce("shared", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("kept_id"))
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i, F.lit("")), F.lit(":"), F.col("digest"), F.lit(">"))
    return joined.select(
        name(F.col("id")).alias("record_id"), "uri", "digest", "n_bytes", F.when(revisit, name(F.col("kept_id"))).alias("refers_to"),
        F.when(revisit, F.col("kept_uri")).alias("refers_to_uri"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def digests() -> list[Column]:
    """What the report reads from a record, worked out while the payload is at hand."""
    page = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(.*):[0-9a-f]*>$", 1), F.lit("")).cast("long")
    stored_here = F.col("record_type") == "response"
    return [
        page("record_id").alias("page_id"),
        F.when(stored_here, F.length("payload")).otherwise(F.col("content_length")).cast("long").alias("payload_bytes"),
        F.when(stored_here, F.sha1("payload")).otherwise(F.lower("payload_digest")).alias("payload_digest"),
        F.col("record_type"),
        page("refers_to_id").alias("refers_to"),
    ]


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of each page, as its record in the archives says.

    Lengths and digests of stored payloads are those of the bytes read back. Rows that repeat have a
    record each; an empty table makes no archive and no rows; further columns of ``pages`` are not read.
    """
    folder = folder or f"{shared_folder(spark)}/termscan/warc-{uuid.uuid4().hex}"
    report = read_whole(write(stored(pages), folder), digests(), range_bytes)
    return report.where("record_type IN ('response', 'revisit')")
