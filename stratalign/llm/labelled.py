"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import keep_columns


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's text modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def chosen_labels(labels: DataFrame, label_col: str, rows_per_class: int, folds: int = 5, held_out: int = 0) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label of at most rows_per_class documents of each class, chosen by a hash of the id, none of the
    held-out fold; and how many each class has in all.  Null ids and labels are left out; of contradicting
    labels the larger counts."""
    known = keep_columns(labels, doc_id="doc_id", label=label_col).filter("doc_id is not null and label is not null")
    known = known.filter(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).filter("label in (0, 1)")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    zero, one = (known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for label in (0, 1))
    return zero.unionByName(one), totals


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: int, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, bytes_per_class: int = 24 << 20) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Whole texts by label of the ``chosen_labels``, and how many documents each class has in all.  Of the chosen
    ones those count, in order of the hash, whose texts together have bytes_per_class bytes at most; of a
    repeated id's texts the first in code point order."""
    chosen, totals = chosen_labels(labels, label_col, rows_per_class, folds, held_out)
    rows = keep_columns(docs, doc_id=id_col, text=text_col).filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("label", "doc_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    held = rows.withColumn("held", F.sum(F.octet_length("text").cast("long")).over(order)).filter(F.col("held") <= bytes_per_class)
    texts: dict[int, list[str]] = {0: [], 1: []}
    for row in held.select("label", "text").toLocalIterator():
        texts[row["label"]].append(row["text"])
    return {k: sorted(v) for k, v in texts.items()}, totals
