"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition packs its pieces best-fit, longest first.  Full bins are done.
Two bins of at most half the capacity never survive one pass together, so a
group has one such bin at most; a fuller bin can only take in some of those.

Small bins go up and meet, with bins of every fill that could take one in, as many
of a fill as there are small bins in all: more cannot be of use to them.  What goes
up is so bounded by the number of groups, and nothing that could still be put
together is left out.  One task packs it, or, if it is more than ``_BLOCK`` items,
one for ``fan_in`` of the level below, and so on up a tree until one group is left.
A task of more than ``_BLOCK`` items packs them in as many groups as that takes.

Documents longer than the capacity are cut into pieces of exactly the capacity,
of which the first may be shorter; no other document is cut.  Null is the empty
text and gives the end token alone.  Ids may be null or repeated.  An empty
table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from . import textkit
from .bytebpe import ByteBpe, character_kinds
from .storage import Scratch, keep_columns

_PIECES = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_PIECES_DDL = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long, ids binary"
#: Level rows: an item and its bin (into, shift), and the bin's fill with its first item, else 0.
_PLACED = pa.schema([("uid", pa.int64()), ("into", pa.int64()), ("shift", pa.int64()), ("fill", pa.int64())])
_PLACED_DDL = "uid long, into long, shift long, fill long"
#: Items packed at a time.
_BLOCK = 400_000


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = length % capacity
    starts = ([0] if first else []) + list(range(first, length, capacity))
    return [(s, first if s == 0 and first else capacity) for s in starts]


def _tokenise(shared, end_id: int, capacity: int, with_ids: bool):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.shared(*shared.value)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in textkit.slices(batch, "text", 1 << 20):
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                out = []
                for doc_id, encoded in zip(ids, bpe.encode(texts), strict=True):
                    tokens = np.append(encoded, np.int32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                        raw = tokens[start : start + length].tobytes()
                        out.append((doc_id, number, k, start, length, zlib.crc32(raw), raw if with_ids else None))
                        number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return tokenise


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, uid, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian unsigned integers."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast((file.read(), character_kinds()))
    rows = keep_columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(textkit.trimmed(_tokenise(shared, end_id, capacity, with_ids)), _PIECES_DDL)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Longest first, into the fullest open bin with room: bin and offset of each item, and the bins' fills."""
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room
    rooms = 0  # bit r: there is a bin with room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            number, room = len(fills), capacity
            fills.append(0)
        bins[item], offsets[item] = number, fills[number]
        fills[number] += length
        room -= length
        if room:
            open_bins[room].append(number)
            rooms |= 1 << room
    return bins, offsets, fills


def _pack(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, lengths, held = [], [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            uid, length = np.concatenate(uids), np.concatenate(lengths)
            order = np.argsort(uid, kind="stable")
            uid, length = uid[order], length[order]
            bins, offsets, fills = best_fit(length, capacity)
            fill = np.array(fills, np.int64)
            lead = np.full(len(fill), -1, np.int64)
            first = offsets == 0
            lead[bins[first]] = uid[first]  # a bin bears the name of its first item
            for start in range(0, len(uid), 1 << 16):
                part = slice(start, start + (1 << 16))
                lead_item = first[part]
                yield pa.RecordBatch.from_arrays([pa.array(uid[part]), pa.array(lead[bins[part]]), pa.array(offsets[part]), pa.array(np.where(lead_item, fill[bins[part]], 0))], schema=_PLACED)

        for batch in batches:
            uids.append(batch.column(0).to_numpy())
            lengths.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= _BLOCK:
                yield from packed()
                uids, lengths, held = [], [], 0
        if held:
            yield from packed()

    return pack


def _useful(placed: DataFrame, capacity: int) -> DataFrame | None:
    """(uid, length) of the small bins, and of bins that could take one in; None without small bins."""
    number, least = placed.filter(F.col("fill").between(1, capacity // 2)).agg(F.count("*"), F.min("fill")).first()
    if not number:
        return None
    bins = placed.filter(F.col("fill").between(1, capacity - least)).select(F.col("into").alias("uid"), F.col("fill").alias("length"))
    place = F.row_number().over(Window.partitionBy("length").orderBy("uid"))
    return bins.withColumn("place", place).filter(F.col("place") <= number).select("uid", "length")


def pack(items: DataFrame, capacity: int = 1024, fan_in: int = 8, block_rows: int = 200_000) -> DataFrame:
    """uid, sequence_id, offset of items (uid, length); uids are distinct."""
    scratch = Scratch(items.sparkSession, "pack")
    current, level, moves = items.select("uid", "length"), 0, None
    rows = current.count()
    parts = max(1, -(-rows // block_rows))
    while True:
        dealt = current.repartition(parts, F.xxhash64("uid"))
        placed = scratch.save(dealt.mapInArrow(_pack(capacity), _PLACED_DDL), f"level{level}")
        step = placed.select("uid", F.col("into").alias("sequence_id"), F.col("shift").alias("offset"))
        if moves is None:
            moves = step
        else:  # the bins of the level below move as wholes; those that did not go up stay
            step = step.select(F.col("uid").alias("moved"), F.col("sequence_id").alias("to"), F.col("offset").alias("by"))
            moves = moves.join(step, F.col("sequence_id") == F.col("moved"), "left").select("uid", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))
        if parts == 1 and rows < _BLOCK or (useful := _useful(placed, capacity)) is None:
            return moves
        current = scratch.save(useful, f"up{level}")
        rows = current.count()
        parts, level = 1 if rows < _BLOCK else -(-parts // fan_in), level + 1


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """All pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    scratch = Scratch(docs.sparkSession, "pieces")
    cut_up = scratch.save(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    scratch.release()
    whole = cut_up.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    short = cut_up.filter(F.col("length") < capacity)
    placed = short.join(pack(short, capacity), "uid")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return whole.select(*columns).unionByName(placed.select(*columns))


def public_tokenizer(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
