"""WARC archives: writing with revisit records, and a splittable reader.

Writing. Payloads are grouped by SHA-256; of equal payloads of at least
``REVISIT_BYTES`` bytes the smallest page_id is a response, the others are
revisit records without payload. Each record is a gzip member of its own. A
task writes its rows to files of its own under a shared folder and returns
their names and sizes; that manifest is written by Spark, so files of tasks
that failed are never read.

Reading. A file is cut into byte ranges. A task scans its range for the gzip
magic, and a candidate counts only if it decompresses to a WARC header; the
task owns the records that start inside its range and reads the last one past
the range's end. A stored member may hold an archive of its own, so what looks
like a record is one only by its place: each range first reports where its
chain of members begins and ends, the chains of a file are tied together from
its first byte, and a range whose chain begins inside an earlier range's member
is entered at that member's end instead. Memory is a buffer and one record,
and for each file two numbers a range.

Files are opened by ``pyarrow.fs`` from their URI.

Defined cases: a null or empty html is an empty payload and always a response.
A null url is written as ``about:blank``; control characters and blanks in a url are
percent-encoded. A null page_id is never referred to; if all pages of a
payload have none, all are responses. Rows that repeat the smallest page_id of
a payload are responses each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byteops as B
from quire.session import materialize, scratch_path

REVISIT_BYTES = 100
#: Pages of one payload above this number are dealt to several keys; at most so many payloads are (their table is broadcast).
HOT, HOT_KEYS = 4096, 100_000
#: A task begins a new file after so many bytes.
FILE_BYTES = 64 << 20
#: Bytes of a reader's range.
RANGE_BYTES = 4 << 20
_READ = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"

MANIFEST = "path string, bytes long, records long"
RECORDS = "path string, offset long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, intact boolean, payload string"


def open_uri(uri: str):
    """(filesystem, path) of a file URI or plain path."""
    from pyarrow import fs

    if ":" not in uri.split("/", 1)[0]:
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit record."""
    target = "about:blank" if not url else "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()) if url.isascii() else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_name(refers_to)}", "WARC-Truncated: length"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the manifest."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    # Only payloads that occur again take part in the join; those of very many pages are dealt to several keys.
    large = F.octet_length("html") >= REVISIT_BYTES
    again = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again, "payloads")
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(again.where(F.col("n") > max(HOT, total // HOT_KEYS)).select("digest", F.ceil(F.col("n") / HOT).alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    keyed = rows.where(large).join(hot, "digest", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.spark_partition_id()), salts)).drop("salts")
    firsts = again.join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select("digest", "salt", "first")
    placed = keyed.join(firsts, ["digest", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    placed = placed.select("page_id", "url", "digest", refers.alias("refers_to"), "html")
    placed = placed.unionByName(rows.where(~large).withColumn("refers_to", F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = open_uri(folder)
        system.create_dir(base, recursive=True)
        done, out, path, size, count = [], None, "", 0, 0

        def close() -> None:
            out.close()
            done.append((path, size, count))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page, url, digest, refers_to, text = row
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    path, size, count = f"{folder}/{name}", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = record(page, url, text.encode(), digest, refers_to)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return materialize(placed.mapInArrow(run, MANIFEST), "manifest")


def _header(data: bytes) -> tuple[dict[str, str], int] | None:
    """The WARC header fields and where the block begins, if ``data`` begins with a whole header."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/1."):
        return None
    fields = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


class _Window:
    """Bytes of a file from an offset on, read as needed."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.ended = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        if not self.ended:
            got = self.file.read(_READ)
            self.ended = not got
            self.data += got
        return not self.ended

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def seek(self, at: int) -> None:
        self.__init__(self.file, at)


def _member(window: _Window, keep: bool = True) -> tuple[bytes, int] | None:
    """The member at the window's start (empty without ``keep``) and its compressed size; None if there is none or its header is no WARC header."""
    unzip, out, used, checked = zlib.decompressobj(31), [], 0, False
    head = b""
    try:
        while True:
            if used >= len(window.data) and not window.more():
                return None
            chunk = window.data[used:]
            part = unzip.decompress(chunk)
            used += len(chunk) - len(unzip.unused_data)
            if keep:
                out.append(part)
            if not checked:
                head += part
                if len(head) >= 7 and not head.startswith(b"WARC/1."):
                    return None
                checked = b"\r\n\r\n" in head
                if checked and _header(head) is None:
                    return None
            if unzip.eof:
                return (b"".join(out), used) if checked else None
    except zlib.error:
        return None


def chain(file, start: int, end: int, keep: bool = True) -> Iterator[tuple[int, bytes, int]]:
    """(offset, decompressed record, its end) of the members that start in [start, end), if one before does not reach past ``start``."""
    window = _Window(file, start)
    while True:
        at = window.data.find(_MAGIC)
        if at < 0:
            window.skip(max(0, len(window.data) - 2))
            if window.at >= end or not window.more():
                return
            continue
        window.skip(at)
        if window.at >= end:
            return
        here = window.at
        found = _member(window, keep)
        if found is None:
            window.skip(1)
        else:
            yield here, found[0], here + found[1]
            window.skip(found[1])


def extent(file, start: int, end: int) -> tuple[int, int] | None:
    """Where the chain of [start, end) begins, and where its last member ends."""
    first = last = None
    for offset, _, last in chain(file, start, end, keep=False):
        first = offset if first is None else first
    return None if first is None else (first, last)


def entered(file, extents: list[tuple[int, int, tuple[int, int] | None]]) -> Iterator[tuple[int, int]]:
    """(from, end) of a file's ranges that own records, given (start, end, extent) of all of them in order."""
    reached = 0
    for start, end, found in extents:
        if found is not None and found[0] < reached:  # inside a member of an earlier range
            start = reached
            found = extent(file, start, end) if start < end else None
        if found is not None:
            yield start, end
            reached = max(reached, found[1])


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decompressed record) of the records in [start, end) of a chain entered at ``start``."""
    for offset, data, _ in chain(file, start, end):
        yield offset, data


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def read(spark: SparkSession, files: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives in ``files`` (path, bytes), each found by the range it starts in.

    ``intact`` says whether a response's payload has the digest of its header.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + range_bytes).alias("end")).repartition(parts, "path", "start")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, local = open_uri(path)
                with system.open_input_file(local) as file:
                    found.append(extent(file, start, end) or (None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["path", "start", "end", "first", "last"])

    def tie(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("start", "end", "first", "last")), strict=True))
        path = group.column("path")[0].as_py()
        system, local = open_uri(path)
        with system.open_input_file(local) as file:
            owned = list(entered(file, [(s, e, None if f is None else (f, x)) for s, e, f, x in rows]))
        return pa.table({"path": pa.array([path] * len(owned), pa.string()), "start": pa.array([o[0] for o in owned], pa.int64()), "end": pa.array([o[1] for o in owned], pa.int64())})

    # A file of one range is entered at its first byte and needs no looking ahead.
    single = (F.col("start") == 0) & (F.col("end") - F.col("start") < range_bytes)
    several = ranges.where(~single).mapInArrow(look, "path string, start long, end long, first long, last long")
    several = several.groupBy("path").applyInArrow(tie, "path string, start long, end long").repartition(parts, "path", "start")
    ranges = ranges.where(single).unionByName(several)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        types = [kinds[f.split()[1]] for f in RECORDS.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, local = open_uri(path)
                rows, held = [], 0
                with system.open_input_file(local) as file:
                    for offset, data in members(file, start, end):
                        fields, body = _header(data)
                        block = data[body : body + int(fields["content-length"])]
                        kind = fields.get("warc-type")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        declared = re.search(rb"(?i)content-length: *(\d+)", http)
                        whole = kind == "response"
                        size = len(payload) if whole else int(declared[1]) if declared else None
                        intact = hashlib.sha256(payload).hexdigest() == digest if whole else None
                        rows.append((path, offset, kind, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), digest, size, _page(fields.get("warc-refers-to")), intact, payload.decode("utf-8", "replace") if whole and payloads else None))
                        held += len(data)
                        if held > 1 << 24:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(run, RECORDS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    manifest = write(pages, scratch_path(spark, "warc"))
    return read(spark, manifest.select("path", "bytes"), payloads=False)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of the archives below ``folder``, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))
