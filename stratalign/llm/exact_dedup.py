"""Exact deduplication with skew-safe combining.

Three stages, each of which compares full contents and not only digests:

1. every input partition keeps the first row of each distinct text it holds;
2. local winners meet by (digest, salt), so that a text which a third of all
   rows share is spread over ``salts`` tasks;
3. salt winners meet by digest, at most ``salts`` rows for one text.

Equality: runs of ``[\\x20\\x09-\\x0D]`` count as one space; null is the empty text.
The row with the smallest id stays; a null id comes after all others.  Of
repeated rows with one id and equal texts just one is kept.  An empty table
gives no rows.  Texts travel compressed.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from .storage import Scratch, column, fresh_names, keep_columns
from .textkit import trimmed

_LAST = (1 << 63) - 1
_FIELDS = [("doc_id", pa.int64()), ("uid", pa.int64()), ("local", pa.int64()), ("into", pa.int64()), ("keep_id", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()), ("content", pa.binary())]
_ROWS = pa.schema(_FIELDS)
_DDL = "doc_id long, uid long, local long, into long, keep_id long, size long, digest binary, content binary"


def normalise(text: str | None) -> bytes:
    """UTF-8 with each run of white space as one space."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return b" " * raw[:1].isspace() + b" ".join(words) + b" " * raw[-1:].isspace()


def normalised(column):
    """The same normalisation as a Spark expression."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row by row: the local winner's uid; winners carry size and content."""
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    base, at = TaskContext.get().partitionId() << 33, 0
    groups: dict[bytes, list[list]] = {}  # digest -> [content, doc_id, uid, size]
    ids, intos, digests = [], [], []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            content = normalise(text.as_py())
            digest = hashlib.sha256(content).digest()
            found = groups.setdefault(digest, [])
            group = next((g for g in found if unpack.decompress(g[0], max_output_size=len(content) + 1) == content), None) if found else None
            if group is None:
                found.append(group := [pack.compress(content), doc_id, base + at, 0])
            elif (_LAST if doc_id is None else doc_id) < (_LAST if group[1] is None else group[1]):
                group[1], group[2] = doc_id, base + at
            group[3] += 1
            ids.append(doc_id)
            intos.append(group)
            digests.append(digest)
            at += 1
    for start in range(0, at, 2048):
        uids = list(range(base + start, base + min(start + 2048, at)))
        part = intos[start : start + 2048]
        won = [g[2] == u for g, u in zip(part, uids, strict=True)]
        yield _batch(
            ids[start : start + 2048],
            uids,
            [g[2] for g in part],
            [None] * len(part),
            [None] * len(part),
            [g[3] if w else None for g, w in zip(part, won, strict=True)],
            digests[start : start + 2048],
            [g[0] if w else None for g, w in zip(part, won, strict=True)],
        )


def _batch(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def _order(doc_id: int | None, uid: int) -> tuple:
    return (doc_id is None, doc_id or 0, uid)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digest.  Winners with equal contents form a group: each learns the group's first row
    (into, keep_id) and size, and only that first row keeps the content.  Rows without content pass."""
    unpack = zstandard.ZstdDecompressor()
    out: list[tuple] = []
    digest, groups = None, []  # a group: [compressed content, content, first row's order, size, members]

    def close() -> None:
        for content, _, first, size, members in groups:
            keep = None if first[0] else first[1]
            out.extend((d, u, local, first[2], keep, size, digest, content if u == first[2] else None) for d, u, local in members)
        groups.clear()

    for batch in batches:
        for doc_id, uid, local, into, keep_id, size, key, content in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            if content is None:
                out.append((doc_id, uid, local, into, keep_id, size, key, None))
                continue
            if key != digest:
                close()
                digest = key
            plain = unpack.decompressobj().decompress(content)
            group = next((g for g in groups if g[1] == plain), None)
            if group is None:
                groups.append(group := [content, plain, _order(doc_id, uid), 0, []])
            group[2] = min(group[2], _order(doc_id, uid))
            group[3] += size
            group[4].append((doc_id, uid, local))
        if len(out) >= 2048:
            yield _batch(*map(list, zip(*out, strict=True)))
            out.clear()
    close()
    for start in range(0, len(out), 2048):
        yield _batch(*map(list, zip(*out[start : start + 2048], strict=True)))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(df.sparkSession, "exact")
    narrow = keep_columns(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    local = narrow.mapInArrow(trimmed(_local), _DDL)
    # A winner's salt comes from its partition; a row that only follows its winner is dealt by its own number.
    salt = F.when(F.col("content").isNotNull(), F.pmod(F.shiftright("uid", 33), F.lit(salts))).otherwise(F.col("uid"))
    salted = local.repartition(F.col("digest"), salt).sortWithinPartitions("digest").mapInArrow(trimmed(_combine), _DDL)
    salted = scratch.save(salted, "salted")
    scratch.release()
    firsts = salted.filter("content is not null")
    final = firsts.repartition("digest").sortWithinPartitions("digest").mapInArrow(_combine, _DDL).drop("content")
    # local winner -> salt winner -> the row that stays
    to_salt = salted.filter("into is not null").select("uid", F.col("into").alias("salt_uid"))
    to_final = final.select(F.col("uid").alias("salt_uid"), "into", "keep_id", "size")
    winners = to_salt.join(to_final, "salt_uid").select(F.col("uid").alias("local"), "into", "keep_id", "size")
    return (
        salted.select("doc_id", "uid", "local", "digest")
        .join(winners, "local")
        .select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("uid") == F.col("into")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, with all their columns.  Of repeated rows with one id and equal texts the one stays
    whose text, as it is, is first in code point order, and of those the first by its other columns as JSON."""
    id_name, sha_name, row_name = fresh_names(df, "kept_id", "kept_sha256", "kept_row")
    kept = exact_duplicates(df, id_col, text_col, salts).filter("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(id_name), F.col("text_sha256").alias(sha_name))
    named = df.withColumns({id_name: F.coalesce(column(df, id_col).cast("long").cast("string"), F.lit("")), sha_name: F.sha2(normalised(column(df, text_col).cast("string")).cast("binary"), 256)})
    left = named.join(kept, [id_name, sha_name], "left_semi")
    text = column(left, text_col)
    # A null text comes after all others.
    order = F.struct(text.isNull(), text, F.to_json(F.struct(*(column(left, c) for c in df.columns if c != text_col))))
    stays = left.groupBy(id_name, sha_name).agg(F.min_by(F.struct(*(column(left, c) for c in df.columns)), order).alias(row_name))
    return stays.select(f"{row_name}.*")
