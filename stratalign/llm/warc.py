"""WARC archives: a writer and a splittable reader.

Writer: one gzip member per record.  Of records with equal payloads of at
least ``min_revisit_bytes`` the one with the largest id is a response and the
others revisit it.  Each task writes one file below a shared folder and reports
it; readers follow those reports only, so that files of lost or repeated tasks
are never seen.

Reader: a task gets a byte range of a file, scans it for the gzip magic,
accepts a candidate once the member decodes to a WARC header, and then walks
member by member.  It owns the records that start within its range.

Null html is an empty payload.  A null id orders before all others; among
repeated rows with one id and equal payloads one is the response.  An empty
table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.taskcontext import TaskContext

from .storage import Scratch, keep_columns, session_root

MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
RECORD_DDL = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def urn_id(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit whose HTTP header alone tells the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]+", " ", url or "")
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {target}"] if target else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {record_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(raw: bytes) -> dict | None:
    """A record's fields, or None if these bytes are no WARC record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    length = int(fields["content-length"])
    if len(rest) < length:
        return None
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": urn_id(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload": None if revisit else payload,
        "payload_bytes": int(size[1]) if revisit and size else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        "refers_to": urn_id(fields.get("warc-refers-to")),
    }


def _write(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        path = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        stream, size, records = None, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if stream is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(path, compression=None)
                record = encode_record(page_id, url, (html or "").encode(), refers_to, revisit, date)
                stream.write(record)
                size += len(record)
                records += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "bytes": [size], "records": [records]}, schema=_MANIFEST)

    return write


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, hot_rows: int = 10_000) -> DataFrame:
    """Writes the archives; returns their manifest (path, bytes, records), read from the shared folder."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    rows = keep_columns(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    digest = F.unhex(F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    # The number tells repeated rows (one id, one payload) apart, so it is written down: made anew it could change.
    rows = scratch.save(rows.withColumns({"digest": digest, "row": F.monotonically_increasing_id()}), "rows")
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("id"), F.col("row")))
    large = rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= min_revisit_bytes)
    groups = scratch.save(large.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best")).filter("n > 1"), "groups")
    # Payloads meet their groups by digest without the html.  Those of more than hot_rows rows, or a hundred-thousandth
    # of all, are so few (some 60 bytes each) that every task has them; the others fit a task.
    most = max(hot_rows, (groups.agg(F.sum("n")).first()[0] or 0) // 100_000)
    hot, cold = groups.filter(F.col("n") > most).select("digest", F.col("best").alias("hot")), groups.filter(F.col("n") <= most).select("digest", F.col("best").alias("cold"))
    narrow = rows.select("digest", "row").join(F.broadcast(hot), "digest", "left")
    met = narrow.filter("hot is not null").select("row", F.col("hot").alias("best")).unionByName(narrow.filter("hot is null").join(cold.hint("merge"), "digest").select("row", F.col("cold").alias("best")))
    revisits = met.filter("best.row <> row").select("row", F.when(F.col("best.known"), F.col("best.id")).alias("refers_to"), F.lit(True).alias("revisit"))
    # Row numbers are distinct: no task gets more than its share of the html.
    rows = rows.join(revisits.hint("merge"), "row", "left").select("page_id", "url", "html", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    manifest = scratch.save(rows.mapInArrow(_write(folder, date), "path string, bytes long, records long"), "manifest")
    scratch.drop("rows", "groups")
    return manifest


class _Window:
    """A file's bytes from any place on, read in pieces; a place within the last piece costs no reading."""

    def __init__(self, stream, size: int = 1 << 20):
        self.stream, self.size, self.start, self.data = stream, size, 0, b""

    def at(self, place: int) -> memoryview:
        """One byte or more from place on; none at the end of the file."""
        if not self.start <= place < self.start + len(self.data):
            self.stream.seek(place)
            self.start, self.data = place, self.stream.read(self.size)
        return memoryview(self.data)[place - self.start :]


def _members(stream, start: int, end: int) -> Iterator[bytes]:
    """Decoded gzip members that start in [start, end), from the first valid one on."""
    window, at, walking = _Window(stream), start, False
    while at < end:
        if not walking:
            found = _magic(window, at, end)
            if found is None:
                return
            at = found
        raw, after = _decode(window, at)
        walking = raw is not None
        if walking:
            yield raw
        at = after if walking else at + 1  # a damaged record: look for the next magic


def _magic(window: _Window, at: int, end: int) -> int | None:
    """Where the magic next starts in [at, end)."""
    tail = b""
    while at - len(tail) < end:
        piece = bytes(window.at(at))
        if not piece:
            return None
        found = (tail + piece).find(MAGIC)
        if found >= 0:
            place = at - len(tail) + found
            return place if place < end else None
        at += len(piece)
        tail = (tail + piece)[-(len(MAGIC) - 1) :]
    return None


def _decode(window: _Window, at: int) -> tuple[bytes | None, int]:
    """The member that starts at this place, if it is a whole WARC record, and the place after it.  What is no record
    is known by its first bytes."""
    unpack, out, size = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        piece = window.at(at)[:_CHUNK]
        if not len(piece):
            return None, at
        try:
            out.append(unpack.decompress(piece))
        except zlib.error:
            return None, at
        at += len(piece) - len(unpack.unused_data)
        if size < 5:
            size += len(out[-1])
            if size >= 5 and not b"".join(out).startswith(b"WARC/"):
                return None, at
    return (b"".join(out) if size >= 5 else None), at


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            fs, name = pafs.FileSystem.from_uri(path)
            out, size = [], 0
            with fs.open_input_file(name) as stream:
                for raw in _members(stream, start, end):
                    record = parse_record(raw)
                    if record is None:
                        continue
                    out.append(record)
                    size += record["payload_bytes"]
                    if len(out) >= 1000 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=_RECORD)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD)


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = 32 << 20) -> DataFrame:
    """Records of the files (columns path and bytes), read by byte ranges of split_bytes."""
    splits = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    tasks = max(1, files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1)
    return splits.repartition(int(tasks), "path", "start").mapInArrow(_read, RECORD_DDL)


def archive_folder(spark: SparkSession) -> str:
    root = session_root(spark)
    return f"{root if '://' in root else 'file://' + root}/warc-{uuid.uuid4().hex}"
