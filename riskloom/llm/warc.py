"""WARC archives: written from pages, read back, and assembled into captures.

A capture is three records: the request, the response (or the revisit that
stands for an equal payload stored elsewhere) and the metadata.  Response and
metadata name the request in WARC-Concurrent-To.  Every record is a gzip member
of its own.  Assembly joins the records through those identifiers into one
nested row per capture, whichever files they lie in.

Tasks write files of bounded size straight to the shared folder under names of
their attempt and return what they wrote; the manifest table (Spark's own
commit) lists the files that count, so a file left by a lost attempt is never
read.  Payloads that are alone with their hash are written by the scan that
reads them; only those whose hash repeats are shuffled, to learn which is stored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import partitions, save, ship_package

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a file is closed, and bytes that are read or handed on at a time.
FILE_BYTES = 32 << 20
READ_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
LEVEL = 4
#: Bits of the driver's map of repeated payload hashes: 2 MB.
FILTER_BITS = 24

RECORD = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()),
    ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("http", pa.string()), ("fields", pa.string()), ("payload", pa.binary())])
RECORD_DDL = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
              "date string, payload_digest string, payload_bytes long, http string, fields string, payload binary")


def open_store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path in it of a URI or plain path."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(path)


def record_id(*parts: object) -> str:
    h = hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def render(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}".encode() for k, v in headers if v is not None]
    lines.append(b"Content-Length: %d" % len(block))
    return VERSION + b"\r\n" + b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def capture_records(page_id: int | None, url: str | None, payload: bytes, date: str, token: str, number: int,
                    response_id: str | None = None, stored: str | None = None) -> list[bytes]:
    """Request, response or revisit (of the record ``stored``), and metadata of one page."""
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    request = record_id(token, number, "request")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324, the format's digest
    try:
        parts = urlsplit(uri or "")
    except ValueError:
        parts = urlsplit("")
    asked = f"GET {parts.path or '/'}{'?' + parts.query if parts.query else ''} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    answer = [("WARC-Type", "revisit" if stored else "response"),
              ("WARC-Record-ID", response_id or record_id(token, number, "response")), ("WARC-Concurrent-To", request),
              ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest),
              ("WARC-Profile", REVISIT_PROFILE if stored else None), ("WARC-Refers-To", stored),
              ("Content-Type", "application/http; msgtype=response")]
    facts = json.dumps(url)
    fields = f"url: {facts}\r\n" if page_id is None else f"page_id: {page_id}\r\nurl: {facts}\r\n"
    return [
        render([("WARC-Type", "request"), ("WARC-Record-ID", request), ("WARC-Target-URI", uri), ("WARC-Date", date),
                ("Content-Type", "application/http; msgtype=request")], asked.encode()),
        render(answer, http if stored else http + payload),
        render([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(token, number, "metadata")),
                ("WARC-Concurrent-To", request), ("WARC-Target-URI", uri), ("WARC-Date", date),
                ("Content-Type", "application/warc-fields")], fields.encode())]


# ------------------------------------------------------------ writing


def _alone(bitmap: bytes, keys: np.ndarray) -> np.ndarray:
    bits, at = np.frombuffer(bitmap, np.uint8), keys & ((1 << FILTER_BITS) - 1)
    return (bits[at >> 3] >> (at & 7)) & 1 == 0


def _write(folder: str, date: str, stage: str, bitmap: bytes | None):
    """Rows (page_id, url, payload, key[, keep_id, sha]) -> manifest rows; with ``bitmap`` only payloads alone with
    their key are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = open_store(folder)
        token = f"{stage}-{task.partitionId():06d}-{task.taskAttemptId()}"
        out, name, files, number, records, size, written = None, None, 0, 0, 0, 0, []

        def close() -> None:
            out.close()
            written.append((f"{folder}/{name}", records, size))

        for b in batches:
            if bitmap is not None:
                b = b.take(pa.array(np.flatnonzero(_alone(bitmap, b.column("key").to_numpy()))))
            keeps, shas = ((b.column(c).to_pylist() if bitmap is None else [None] * b.num_rows) for c in ("keep_id", "sha"))
            for page, url, payload, keep, sha in zip(*(b.column(c) for c in ("page_id", "url", "payload")), keeps, shas,
                                                     strict=True):
                page, payload = page.as_py(), payload.as_py()
                own = record_id("stored", page, sha) if keep is not None and keep == page else None
                stored = record_id("stored", keep, sha) if keep is not None and keep != page else None
                if out is None:
                    name, files, records, size = f"{token}-{files:05d}.warc.gz", files + 1, 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = render([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(folder, name)),
                                   ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                                  b"format: WARC File Format 1.1\r\n")
                    info = member(info)
                    out.write(info)
                    size += len(info)
                for record in capture_records(page, url.as_py(), payload, date, f"{folder}/{token}", number, own, stored):
                    data = member(record)
                    out.write(data)
                    size, records = size + len(data), records + 1
                number += 1
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if written:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*written)], names=["path", "records", "bytes"])

    return run


def _repeating(bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(np.flatnonzero(~_alone(bitmap, b.column("key").to_numpy()))))

    return run


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               least_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write every row of ``pages`` as a capture under ``folder``; return the manifest (path, records, bytes), which is
    also kept in ``folder``/_manifest.

    The payload is ``html`` (a string in UTF-8, or binary); null counts as
    empty.  Of equal payloads of at least ``least_bytes`` the rows with the
    largest page_id are responses (all of them if that row is repeated) and
    the others revisit it; null ids are the smallest, and a group of null ids
    alone holds responses only.  Shorter payloads are all responses.  A null
    url has no WARC-Target-URI.  An empty table gives no file; other columns
    are ignored.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"),
                        F.coalesce(pages[html].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least_bytes, F.xxhash64("payload")))
    keyed = rows.where("key IS NOT NULL").select("page_id", "key", F.sha2("payload", 256).alias("sha"))
    groups = save(keyed.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keep_id"))
                  .where("n > 1 AND keep_id IS NOT NULL"), "payload-groups")
    slot = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    bitmap = bytearray(1 << (FILTER_BITS - 3))
    for at, bits in groups.select(F.shiftright(slot, 15).alias("at"), slot.bitwiseAND(32767).alias("pos")).groupBy(
            "at").agg(F.bitmap_construct_agg("pos")).collect():  # at most 512 rows
        bitmap[at << 12:(at + 1) << 12] = bits
    bitmap = bytes(bitmap)

    ddl = "path string, records long, bytes long"
    store, root = open_store(folder)
    store.create_dir(root)
    short = rows.withColumn("key", F.coalesce("key", F.lit(-1).cast("long")))
    long_enough = rows.where("key IS NOT NULL")
    straight = short.where(F.octet_length("payload") < least_bytes).withColumns(
        {"keep_id": F.lit(None).cast("long"), "sha": F.lit(None).cast("string")}).mapInArrow(
        _write(folder, date, "short", None), ddl)
    straight = straight.unionByName(long_enough.mapInArrow(_write(folder, date, "alone", bitmap), ddl))
    met = long_enough.mapInArrow(_repeating(bitmap), long_enough.schema).withColumn(
        "sha", F.sha2("payload", 256)).join(groups.select("key", "sha", "keep_id"), ["key", "sha"], "left")
    again = met.mapInArrow(_write(folder, date, "again", None), ddl)
    manifest = f"{folder}/_manifest"
    straight.unionByName(again).write.parquet(manifest)
    return spark.read.schema(ddl).parquet(manifest)


# ------------------------------------------------------------ reading


class _Bytes:
    """The uncompressed bytes of a WARC file, plain or gzip by member, a piece at a time."""

    def __init__(self, stream):
        self.stream, self.held, self.z, self.packed, self.rest = stream, bytearray(), None, None, b""

    def more(self) -> bool:
        data = self.rest or self.stream.read(READ_BYTES)
        self.rest = b""
        if not data:
            if self.z is not None and not self.z.eof:
                raise ValueError("a WARC file ends inside a gzip member")
            return False
        if self.packed is None:
            self.packed = data[:2] == b"\x1f\x8b"
        if not self.packed:
            self.held += data
            return True
        if self.z is None or self.z.eof:
            self.z = zlib.decompressobj(31)
        self.held += self.z.decompress(data)
        self.rest = self.z.unused_data
        return True

    def line(self) -> bytes | None:
        at = 0
        while (end := self.held.find(b"\r\n", at)) < 0:
            at = max(0, len(self.held) - 1)
            if not self.more():
                if self.held:
                    raise ValueError("a WARC file ends inside a header")
                return None
        out = bytes(self.held[:end])
        del self.held[:end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a WARC file ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of a stream."""
    data = _Bytes(stream)
    while (first := data.line()) is not None:
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while line := data.line():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, data.take(int(headers["content-length"]))


def _digest_hex(value: str | None) -> str | None:
    """Lower-case hex of a SHA-1 digest in base 32 or hex; any other digest as it stands."""
    if value is None:
        return None
    kind, _, code = value.partition(":")
    if kind.lower() == "sha1" and len(code) == 32:
        return base64.b32decode(code.upper()).hex()
    return code.lower() if kind.lower() == "sha1" else value


def parse(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A row of ``RECORD``; the payload of a response must have the digest that its record names."""
    kind, content = headers.get("warc-type"), headers.get("content-type", "")
    digest, http, fields, payload, size = _digest_hex(headers.get("warc-payload-digest")), None, None, None, None
    if content.startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        if kind == "response":
            found = hashlib.sha1(body).hexdigest()  # noqa: S324
            if (headers.get("warc-payload-digest") or "").lower().startswith("sha1:") and digest != found:
                raise ValueError(f"payload of {headers.get('warc-record-id')} has another digest")
            digest, size, payload = digest or found, len(body), body if with_payload else None
        elif kind == "revisit":
            said = [v for k, _, v in (x.partition(":") for x in http.split("\r\n")) if k.lower() == "content-length"]
            size = int(said[0]) if said else None
    elif content.startswith("application/warc-fields"):
        fields = block.decode("utf-8", "replace")
    return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
            headers.get("warc-target-uri"), headers.get("warc-date"), digest, size, http, fields, payload)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path): the WARC files of a folder that has no manifest of ``write_warc``; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option(
        "recursiveFileLookup", "true").load(folder).select("path")


def read_records(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the WARC ``files`` (path): the columns of ``RECORD``.  A file is read a piece at a time.
    ``payload`` stays null without ``with_payload``; sizes and digests are still those of the whole payloads."""
    spark = files.sparkSession
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                store, inside = open_store(path)
                with store.open_input_stream(inside, compression=None, buffer_size=0) as stream:
                    for headers, block in records_of(stream):
                        out.append(parse(headers, block, with_payload))
                        held += 500 + (len(block) if with_payload else 0)
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, f.type) for c, f in zip(zip(*out), RECORD)], schema=RECORD)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RECORD)], schema=RECORD)

    return files.select("path").repartition(partitions(spark)).mapInArrow(run, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (a response or revisit), metadata (array of records in
    order of their ids).

    A record belongs to the capture of the record that it names in
    WARC-Concurrent-To, else to its own.  Captures without a request, a
    response or metadata stay, with null or an empty array there.  Other
    record types (warcinfo, resource) and records without an id are no part
    of a capture.
    """
    rows = records.where("record_id IS NOT NULL").withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))

    def side(kinds: list[str], name: str) -> DataFrame:
        return rows.where(F.col("record_type").isin(kinds)).select(
            "capture_id", F.struct(*[c for c in rows.columns if c not in ("capture_id", "concurrent_to")]).alias(name))

    notes = side(["metadata"], "note").groupBy("capture_id").agg(F.array_sort(F.collect_list("note")).alias("metadata"))
    joined = side(["request"], "request").join(side(["response", "revisit"], "response"), "capture_id", "full").join(
        notes, "capture_id", "full")
    return joined.select("capture_id", "request", "response", F.coalesce(
        "metadata", F.array().cast(notes.schema["metadata"].dataType)).alias("metadata"))


def field(metadata: str, name: str):
    """Value of a warc-fields line of a capture's metadata, null where no record has it."""
    lines = F.flatten(F.transform(metadata, lambda m: F.split(F.coalesce(m["fields"], F.lit("")), "\r\n")))
    hit = F.get(F.filter(lines, lambda x: x.startswith(f"{name}: ")), 0)
    return F.substring(hit, len(name) + 3, 1 << 30)


def capture_index(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (page_id of the record that a revisit names)
    of assembled captures of ``write_warc``."""
    rows = captures.select(field("metadata", "page_id").cast("long").alias("page_id"), "response.*").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "record_id", F.col("refers_to").alias("target"))
    rows = save(rows, "captures")
    stored = rows.where("record_type = 'response'").join(
        rows.where("target IS NOT NULL").select(F.col("target").alias("record_id")).distinct(), "record_id", "left_semi")
    stored = stored.groupBy("record_id").agg(F.max("page_id").alias("refers_to")).withColumnRenamed("record_id", "target")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    met = rows.where("target IS NOT NULL").join(stored, "target", "left").select(columns)
    return rows.where("target IS NULL").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(met)
