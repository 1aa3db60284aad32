"""Mixing sources to target weights, with DataFrame functions only.

Sizes are word counts.  Sources in code point order, null last, take the
weights in turn and share the whole size; a target stops at ``most`` times its
source's size and the excess is reshared by weight.  A document is taken
floor(rate) times plus once more with probability equal to the fraction, by a
hash of seed and id, so that reruns agree and repeated rows fare alike.  Of a
few seeds a source takes the one whose total comes nearest to its target: alone,
the draws of a small source of long documents could miss it by far.

Null text has size 0, as has white space; sources of size 0 have target 0.  An
id may be null.  Of seeds with equal totals the first counts.  An empty table
gives no rows.  Other columns are kept by ``take_copies`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import Scratch, column, fresh_names, keep_columns

#: Source tables up to this many bytes may be broadcast, at 64 a row and the names' own.
BROADCAST_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds rank, from 0, in code point order with null last; no single task sees all sources."""
    held = scratch.save(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ordered")
    counts = held.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return held.withColumn("within", within).join(F.broadcast(before), "part").select("source", "source_size", (F.col("before") + F.col("within")).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, target of a table (source, size)."""
    scratch = Scratch(sizes.sparkSession, "mix")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = scratch.save(_ranked(sources, scratch).withColumn("weight", weight.cast("double")), "ranked")
    # Only totals come to the driver.  The level rises until no uncapped source is above its limit.
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    full = F.col("source_size") * most
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level >= full
        held, weighed = ranked.agg(F.sum(F.when(capped, full)), F.sum(F.when(~capped, F.col("weight")))).first()
        nxt = (total - (held or 0)) / weighed if weighed else None
        if nxt is None or nxt == level:
            break
        level = nxt
    capped = F.col("weight") * F.lit(level or 0.0) >= full
    return ranked.select("source", "source_size", F.when(capped | F.lit(level is None), full.cast("double")).otherwise(F.col("weight") * F.lit(level or 0.0)).alias("target"))


#: Seeds that a source may choose from; four come from each md5.
SEEDS = 16


def seeded_fractions(seed: str, key: Column, seeds: int = SEEDS) -> list[Column]:
    """Numbers in [0, 1), each from 32 bits of md5(seed ':' number ':' key)."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    digests = [F.md5(F.concat(F.lit(f"{seed}:{k}:"), name).cast("binary")) for k in range(-(-seeds // 4))]
    return [F.conv(F.substring(digests[k // 4], 1 + 8 * (k % 4), 8), 16, 10).cast("double") / F.lit(float(1 << 32)) for k in range(seeds)]


def _fraction(seed: str, key: Column, number: Column) -> Column:
    """The one of ``seeded_fractions`` that has this number."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.shiftright(number, 2).cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, (1 + 8 * (number % 4)).cast("int"), F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def _plan(sizes: DataFrame, weights: Sequence[int], most: int, seed: str, broadcast_bytes: int) -> DataFrame:
    """source, source_size, target, rate and the chosen seed's number of a table (doc_id, source, size)."""
    scratch = Scratch(sizes.sparkSession, "plan")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = scratch.save(source_targets(sizes, weights, most).withColumn("rate", rate), "targets")
    joined = _with_targets(sizes, targets, "source", "doc_id", broadcast_bytes)
    drawn = joined.withColumn("fraction", F.col("rate") - F.floor("rate")).select("source", "size", "target", F.floor("rate").alias("whole"), *(F.when(u < F.col("fraction"), F.col("size")).otherwise(0).alias(f"extra{k}") for k, u in enumerate(seeded_fractions(seed, F.col("doc_id")))))
    totals = drawn.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("whole")).alias("held"), *(F.sum(f"extra{k}").alias(f"extra{k}") for k in range(SEEDS)))
    miss = F.array(*(F.struct(F.abs((F.col("held") + F.col(f"extra{k}")).cast("double") - F.col("target")).alias("miss"), F.lit(k).alias("number")) for k in range(SEEDS)))
    chosen = totals.select(F.col("source").alias("its_source"), F.array_min(miss)["number"].alias("number"))
    plan = scratch.save(targets.join(chosen, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source"), "plan")
    scratch.release()
    return plan


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sizes = keep_columns(df, doc_id=id_col, text=text_col, source=source_col)
    sizes = sizes.select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"))
    sizes = Scratch(df.sparkSession, "sizes").save(sizes, "sizes")  # words are counted once
    joined = _with_targets(sizes, _plan(sizes, weights, most, seed, broadcast_bytes), "source", "doc_id", broadcast_bytes)
    joined = joined.withColumn("copies", _copies("rate", "number", seed, F.col("doc_id")))
    return joined.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _copies(rate: str, number: str, seed: str, doc_id: Column) -> Column:
    whole = F.floor(F.col(rate))
    return (whole + (_fraction(seed, doc_id, F.col(number)) < F.col(rate) - whole).cast("long")).cast("long")


def _with_targets(rows: DataFrame, targets: DataFrame, source_col: str, id_col: str, broadcast_bytes: int, salts: int = 32) -> DataFrame:
    """Joined by source, null with null; adds the other columns of targets.  A source table over the checked size is
    joined by (source, salt), so that a hot source is spread over tasks."""
    its_source, its_salt, salt = fresh_names(rows, "its_source", "its_salt", "salt")
    targets = targets.withColumnRenamed("source", its_source)
    same = column(rows, source_col).eqNullSafe(F.col(its_source))
    size = targets.agg(F.sum(F.coalesce(F.octet_length(its_source), F.lit(0)) + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(targets), same).drop(its_source)
    salted = targets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    dealt = rows.withColumn(its_salt, F.pmod(F.xxhash64(column(rows, id_col)), F.lit(salts)).cast("int"))
    return dealt.join(salted, column(dealt, source_col).eqNullSafe(F.col(its_source)) & (F.col(salt) == F.col(its_salt))).drop(its_source, salt, its_salt)


def take_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, with df's columns."""
    rate, number, copy = fresh_names(df, "its_rate", "its_number", "its_copy")
    sizes = keep_columns(df, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", word_count(F.col("text").cast("string")).alias("size"))
    sizes = Scratch(df.sparkSession, "sizes").save(sizes, "sizes")
    plan = _plan(sizes, weights, most, seed, broadcast_bytes).select("source", F.col("rate").alias(rate), F.col("number").alias(number))
    joined = _with_targets(df, plan, source_col, id_col, broadcast_bytes)
    copies = _copies(rate, number, seed, column(joined, id_col))
    repeated = joined.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies))))
    return repeated.select(*(column(repeated, c) for c in df.columns))
