"""WARC archives: a writer of gzip members and a splittable reader.

The writer makes one archive file a task in the shared folder, each record a gzip member of its own.  Records
whose payloads are equal are written once: that with the largest page_id is a response, the others are revisits
that refer to it.  File names are new for every attempt of a task and only those of finished tasks are listed in
the written manifest, so a lost executor leaves no doubled record.

The reader cuts the files into byte ranges.  A task looks for the gzip magic from the start of its range, takes
a place as a member only if a WARC header decodes there, and owns the records that start inside the range; the
last may end beyond it.

Defined results: a null payload or url counts as empty; payloads below ``min_revisit_bytes`` are always
responses; rows equal in page_id and payload all become responses (of the largest page_id) or revisits; a null
page_id never is referred to unless the whole group has none, and then all its rows are responses; empty input
gives no file and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fresh_dir, join_one, table, written

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
READ_BYTES, INFLATE_BYTES = 1 << 20, 1 << 14
#: Bytes of archives for one reading task, about.
TASK_BYTES = 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
DATE = "2026-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    text = (name or "").rpartition(":")[2].rstrip(">")
    return int(text) if text.lstrip("-").isdigit() else None


def safe_uri(url: str | None) -> str:
    """White space and control characters would break a header line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def member(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, level: int = 1) -> bytes:
    """One record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe_uri(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 0, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, is_revisit, refers_to).

    Equal payloads are found over SHA-256 digests alone.  The payloads themselves move once, where the revisits are too many to
    be sent to all tasks.
    """
    src = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("key", F.unhex(F.sha2("payload", 256)))
    keyed = written(src.filter(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "key"), "digests")
    groups = keyed.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
    again = join_one(keyed, groups, "key").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("p"), F.col("key").alias("k"), "refers_to").distinct()
    again = written(again, "revisits")
    joined = src.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("key") == F.col("k")), "left")
    return joined.select("page_id", "url", "payload", F.col("k").isNotNull().alias("is_revisit"), "refers_to")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; the manifest (path, bytes, records) comes as a written table."""
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        name, out, size, n = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in it:
            if out is None and batch.num_rows:
                filesystem.create_dir(root, recursive=True)
                out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                data = member(*row)
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((f"{folder}/{name}", size, n), schema)], schema=schema)

    return written(records.select("page_id", "url", "payload", "is_revisit", "refers_to").mapInArrow(write, "path string, bytes long, records long"), "manifest")


class Window:
    """Bytes of a file from a place on, read as they are needed."""

    def __init__(self, file, at: int):
        file.seek(at)
        self.file, self.base, self.data, self.ended = file, at, b"", False

    def need(self, at: int, n: int) -> bool:
        """Whether n bytes at the place are there now."""
        while not self.ended and self.base + len(self.data) < at + n:
            more = self.file.read(READ_BYTES)
            self.ended = not more
            self.data += more
        return self.base + len(self.data) >= at + n

    def drop(self, at: int) -> None:
        """Lets go of what lies before the place, once that is worth the copy."""
        if at - self.base >= READ_BYTES:
            self.data, self.base = self.data[at - self.base :], at

    def back(self, at: int) -> None:
        """Goes back to a place that was let go of."""
        if at < self.base:
            self.file.seek(at)
            self.base, self.data, self.ended = at, b"", False


def inflate(window: Window, at: int, most: int | None = None) -> tuple[bytes, int] | None:
    """The member at a place: its bytes (at least ``most``, if given) and where it ends; None if there is none.

    Of a whole member what is inflated is let go of, so the window stays small however long the member is.
    """
    z, out, place = zlib.decompressobj(31), [], at
    got = 0
    try:
        while not z.eof:
            if most is None:
                window.drop(place)
            if not window.need(place, 1):
                return None
            chunk = window.data[place - window.base : place - window.base + INFLATE_BYTES]
            piece = z.decompress(chunk) if most is None else z.decompress(chunk, most)
            out.append(piece)
            got += len(piece)
            place += len(chunk)
            if most is not None and got >= most:
                break
    except zlib.error:
        return None
    return b"".join(out), place - len(z.unused_data)


def first_member(window: Window, start: int, end: int) -> int | None:
    """Where the first member that begins in [start, end) begins: magic, then a header that decodes."""
    at = start
    window.back(at)
    while at < end and window.need(at, len(MAGIC)):
        found = window.data.find(MAGIC, at - window.base)
        if found < 0:
            at = window.base + len(window.data) - len(MAGIC) + 1
            window.drop(at)
            if window.ended:
                return None
            window.need(at, READ_BYTES)
            continue
        at = window.base + found
        if at >= end:
            return None
        head = inflate(window, at, 64)
        if head and head[0].startswith(b"WARC/1."):
            return at
        at += 1
    return None


def parse(record: bytes) -> tuple | None:
    """A response or revisit record as a row of RECORD; other types (None) are passed over."""
    cut = record.find(b"\r\n\r\n")
    head = record if cut < 0 else record[:cut]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    # Only the payload is copied out of the record.
    start = len(head) + 4
    end = min(start + int(fields["content-length"]), len(record))
    gap = record.find(b"\r\n\r\n", start, end)
    http = record[start : end if gap < 0 else gap]
    payload = b"" if gap < 0 else record[gap + 4 : end]
    page, url = page_of(fields.get("warc-record-id")), fields.get("warc-target-uri")
    if kind == "response":
        return page, url, kind, None, len(payload), digest(payload), payload
    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return page, url, kind, page_of(fields.get("warc-refers-to")), int(sizes[0]), fields.get("warc-payload-digest", "").rpartition(":")[2], b""


def read_range(path: str, start: int, end: int) -> Iterator[tuple]:
    filesystem, name = pafs.FileSystem.from_uri(path)
    with filesystem.open_input_file(name) as file:
        window = Window(file, start)
        at = first_member(window, start, end)
        while at is not None and at < end:
            window.drop(at)
            if not window.need(at, 1):
                return
            got = inflate(window, at)
            if got is None:
                at = first_member(window, at + 1, end)
                continue
            row = parse(got[0])
            if row:
                yield row
            at = got[1]


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """All records of the files (path, bytes), by byte ranges; RECORD's columns (payload null unless wanted)."""
    ranges = manifest.filter("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.col("start") + split_bytes)
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    schema = pa.schema(fields)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows = read_range(path, start, end)
                yield from batches(rows if payloads else ((*r[:-1], None) for r in rows), schema, 500 if payloads else 5000)

    # The ranges' own rows are tiny, so the number of tasks follows from what they point to.
    size = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0)).alias("ranges")).first()
    tasks = max(1, min(size.ranges, 4 * manifest.sparkSession.sparkContext.defaultParallelism), -(-size.bytes // TASK_BYTES))
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives and reads them back."""
    manifest = write_archives(with_revisits(table(spark, sf_dir, "pages")), fresh_dir(spark, "warc"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
SQL: dict[str, str] = {}
