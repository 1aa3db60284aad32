"""BAM files by byte ranges.

A task finds the first BGZF block at or after its start, then the first record
within by checking that a chain of plausible records follows, and reads the
records that start in blocks of its range.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalign.functions import cigar as cg

from .sam import ALIGNMENTS_DDL

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BGZF = b"\x1f\x8b\x08\x04"
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_SCHEMA = pa.schema(
    [
        ("file_order", pa.struct([("file", pa.string()), ("start", pa.int64()), ("row", pa.int64())])),
        *[(n, pa.string() if t == "s" else pa.binary() if t == "b" else pa.int32() if t == "i" else pa.int64()) for n, t in (("qname", "s"), ("flag", "i"), ("tid", "i"), ("chrom", "s"), ("pos", "l"), ("mapq", "i"), ("cigar", "s"), ("mtid", "i"), ("mate_chrom", "s"), ("mpos", "l"), ("tlen", "l"), ("seq", "s"), ("qual", "b"), ("nh", "i"), ("hi", "i"), ("nm", "i"))],
    ]
)


def _block_size(head: bytes) -> int | None:
    """The whole size of the BGZF block with this header."""
    if len(head) < 18 or not head.startswith(_BGZF):
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        if head[at : at + 2] == b"BC" and struct.unpack_from("<H", head, at + 2)[0] == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", head, at + 2)[0]
    return None


def _blocks(stream, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the blocks from the first one at or after start."""
    stream.seek(start)
    data = stream.read(1 << 17)
    at = 0
    while True:
        at = data.find(_BGZF, at)
        if at < 0:
            return
        whole = _block_size(data[at : at + 64])
        if whole and (start + at + whole == size or _block_size(data[at + whole : at + whole + 64]) or len(data) < at + whole + 18):
            break
        at += 1
    place = start + at
    while place < size:
        stream.seek(place)
        head = stream.read(1 << 16)
        whole = _block_size(head)
        if whole is None:
            raise ValueError(f"no BGZF block at {place}")
        if len(head) < whole:
            head += stream.read(whole - len(head))
        yield place, zlib.decompress(head[:whole], 31)
        place += whole


def parse_header(data: bytes) -> tuple[list[tuple[str, int]], int]:
    """References and the length of the header."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = struct.unpack_from("<i", data, 4)[0]
    count, at, out = struct.unpack_from("<i", data, 8 + text)[0], 12 + text, []
    for _ in range(count):
        n = struct.unpack_from("<i", data, at)[0]
        out.append((data[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", data, at + 4 + n)[0]))
        at += 8 + n
    return out, at


def _plausible(data: bytes, at: int, references: int, depth: int = 4) -> bool:
    """A record, and up to depth more after it, could start here."""
    for k in range(depth):
        if at + 36 > len(data):
            return k > 0
        size, tid, pos, name, _, _, ops, flag, seq, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        if not (32 <= size < 1 << 26 and -1 <= tid < references and -1 <= mtid < references and pos >= -1 and mpos >= -1 and name >= 1 and seq >= 0 and flag < 1 << 12):
            return False
        if 32 + name + 4 * ops + (seq + 1) // 2 + seq > size:
            return False
        end = at + 36 + name
        if end <= len(data) and (data[end - 1] != 0 or any(not 33 <= b <= 126 for b in data[at + 36 : end - 1])):
            return False
        at += 4 + size
    return True


def _tags(data: bytes, at: int, end: int) -> dict[str, int]:
    sizes, out = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}, {}
    while at + 3 <= end:
        name, kind = data[at : at + 2].decode("latin-1"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            at = data.index(0, at) + 1
        elif kind == "B":
            at += 5 + sizes[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            if kind in "cCsSiI" and name in ("NH", "HI", "NM"):
                out[name] = struct.unpack_from("<" + {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}[kind], data, at)[0]
            at += sizes[kind]
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after another, and each place's number within its range."""
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + within, within


def _strings(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType, known: np.ndarray) -> pa.Array:
    """An Arrow column of strings or bytes from their bytes one after another; null where not known."""
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    bits = None if known.all() else pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, len(lengths), [bits, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype(np.uint8).tobytes())])


_LETTERS = np.frombuffer(_BASES.encode(), np.uint8)


def decode(data: bytes, at: np.ndarray, names: list[str]) -> list[pa.Array]:
    """Columns from qname to nm of the records at these places.  Fixed fields, names, bases and qualities are taken for all
    records at once; CIGARs once for each that differs; tags record by record."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[at[:, None] + np.arange(36)]

    def field(start: int, kind: str) -> np.ndarray:
        return np.ascontiguousarray(head[:, start : start + np.dtype(kind).itemsize]).view(kind).ravel().astype(np.int64)

    tid, mtid, size, bases, ops = field(4, "<i4"), field(24, "<i4"), field(0, "<i4"), field(20, "<i4"), field(16, "<u2")
    name_size = field(12, "u1") - 1
    name_at = at + 36
    ops_at = name_at + name_size + 1
    seq_at = ops_at + 4 * ops
    qual_at = seq_at + (bases + 1) // 2
    some, every = bases > 0, np.ones(len(at), bool)
    places, within = _ranges(seq_at, bases)  # seq_at + k for base k: its byte is at seq_at + k // 2
    packed = raw[places - within + within // 2]
    letters = _LETTERS[np.where(within % 2 == 0, packed >> 4, packed & 15)]
    known: dict[bytes, str] = {}

    def cigar(start: int, stop: int) -> str:
        content = data[start:stop]
        if content not in known:
            known[content] = "".join(f"{x >> 4}{_OPS[x & 15]}" for x in struct.unpack(f"<{len(content) // 4}I", content)) or "*"
        return known[content]

    tags = [_tags(data, start, stop) for start, stop in zip((qual_at + bases).tolist(), (at + 4 + size).tolist(), strict=True)]
    chrom = pa.array(names, pa.string())
    named = lambda k: chrom.take(pa.array(np.maximum(k, 0), mask=k < 0)) if len(names) else pa.nulls(len(k), pa.string())
    ints = lambda x, kind=pa.int32(): pa.array(x).cast(kind)
    return [
        _strings(raw[_ranges(name_at, name_size)[0]], name_size, pa.string(), every),
        ints(field(18, "<u2")),
        ints(tid),
        named(tid),
        ints(field(8, "<i4"), pa.int64()),
        ints(field(13, "u1")),
        pa.array([cigar(x, y) for x, y in zip(ops_at.tolist(), seq_at.tolist(), strict=True)], pa.string()),
        ints(mtid),
        named(mtid),
        ints(field(28, "<i4"), pa.int64()),
        ints(field(32, "<i4"), pa.int64()),
        _strings(letters, bases, pa.string(), some),
        _strings(raw[_ranges(qual_at, bases)[0]], bases, pa.binary(), some),
        *(pa.array([t.get(n) for t in tags], pa.int32()) for n in ("NH", "HI", "NM")),
    ]


def _records(stream, start: int, end: int, header: int, names: list[str]) -> tuple[bytes, np.ndarray]:
    """Records that start in the blocks of [start, end): those blocks' content, with what the last record needs, and where
    each record is in it."""
    blocks = _blocks(stream, start, stream.size())
    data, edge, after = bytearray(), None, None
    for place, content in blocks:
        if place >= end:
            edge, after = len(data), content
            break
        data += content
    edge = len(data) if edge is None else edge
    if after is not None:
        data += after
    if start == 0:
        at = header
    else:
        at = next((k for k in range(edge) if _plausible(data, k, len(names))), edge)
    found = []
    while at < edge:
        while len(data) < at + 4 or len(data) < at + 4 + struct.unpack_from("<i", data, at)[0]:
            more = next(blocks, None)
            if more is None:
                raise ValueError(f"a record at {at} of the blocks from {start} is cut off")
            data += more[1]
        found.append(at)
        at += 4 + struct.unpack_from("<i", data, at)[0]
    return bytes(data), np.array(found, np.int64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for split in batch.to_pylist():
            fs, name = pafs.FileSystem.from_uri(split["path"])
            with fs.open_input_file(name) as stream:
                data, places = _records(stream, split["start"], split["end"], split["header"], split["names"])
            for first in range(0, len(places), 4096):
                at = places[first : first + 4096]
                order = pa.StructArray.from_arrays([pa.array([split["path"]] * len(at), pa.string()), pa.array([split["start"]] * len(at), pa.int64()), pa.array(np.arange(first, first + len(at)))], ["file", "start", "row"])
                yield pa.RecordBatch.from_arrays([order, *decode(data, at, split["names"])], schema=_SCHEMA)


def _uri(path: str) -> str:
    import os

    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)


def read_references(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """References, header length and file size."""
    fs, name = pafs.FileSystem.from_uri(_uri(path))
    with fs.open_input_file(name) as stream:
        size, data = stream.size(), b""
        for _, content in _blocks(stream, 0, size):
            data += content
            try:
                references, length = parse_header(data)
            except (struct.error, IndexError):
                continue
            return references, length, size
    raise ValueError(f"{path}: no BAM header")


def read_bam(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    """Alignments of a BAM file, with the parsed CIGAR in ops."""
    references, header, size = read_references(path)
    names = [n for n, _ in references]
    splits = [(_uri(path), s, min(s + split_bytes, size), header, names) for s in range(0, size, split_bytes)]
    rows = spark.createDataFrame(splits, "path string, start bigint, end bigint, header bigint, names array<string>").repartition(len(splits), "start")
    return rows.mapInArrow(_read, ALIGNMENTS_DDL).withColumn("ops", cg.parse(F.col("cigar")))


def bam_header(spark: SparkSession, path: str) -> DataFrame:
    references, _, _ = read_references(path)
    return spark.createDataFrame([(k, n, length) for k, (n, length) in enumerate(references)], "tid int, name string, length long")
