"""Interval operators: joins by bins, merging, subtraction, depth.

Intervals are half-open (s, e) of long within keys such as a chromosome.  Range
conditions become equi-joins on (key, bin): both sides are spread over the bins
they touch, and a pair counts in the first bin they share, so no distinct is
needed and hot keys are split by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Limits of a bin's width.
LEAST_BIN, MOST_BIN = 64, 1 << 20


#: A side of so many rows at most is broadcast; the planner's estimate does not see that rows are spread over bins.
FEW = 100_000


def _sized(right: DataFrame, size: int | None) -> tuple[int, str]:
    """The bins' width, and how the right side's rows in their bins are joined: sent to all tasks if they are measured
    and few, else shuffled with the left side's.  The width is a power of two of about the mean length, so that
    intervals lie in two bins on average and a bin holds no more of them than can meet; one aggregate over the
    right side, which is the smaller one as a rule."""
    if size:
        return size, "merge"
    mean, rows = right.agg(F.avg(F.col("e") - F.col("s")), F.count("*")).first()
    size = max(LEAST_BIN, min(MOST_BIN, 1 << max(0, int(mean or 0) - 1).bit_length()))
    return size, "broadcast" if rows * (2 + (mean or 0) / size) <= FEW else "merge"


def _bins(s: Column, last: Column, size: int) -> Column:
    return F.sequence(F.floor(s / size), F.floor(F.greatest(last, s) / size))


def _binned(df: DataFrame, s: Column, last: Column, size: int) -> DataFrame:
    return df.withColumn("__bin", F.explode(_bins(s, last, size)))


def _renamed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def overlap_candidates(left: DataFrame, right: DataFrame, keys: Sequence[str], size: int | None = None, closed: bool = False, prefix: str = "r_") -> DataFrame:
    """Every left row at least once, beside the right rows of its bins, with ``met``: the two overlap (closed: or touch)
    and meet here for the first time.  Left rows without an interval stay too."""
    keys, reach, (size, way) = list(keys), 0 if closed else 1, _sized(right, size)
    a = left.withColumn("__bin", F.explode_outer(_bins(F.col("s"), F.col("e") - reach, size)))
    b = _renamed(_binned(right, F.col("s"), F.col("e") - reach, size), prefix, [*keys, "__bin"]).hint(way)
    rs, re = F.col(f"{prefix}s"), F.col(f"{prefix}e")
    met = (F.col("s") <= re) & (rs <= F.col("e")) if closed else (F.col("s") < re) & (rs < F.col("e"))
    first = F.col("__bin") == F.floor(F.greatest(F.col("s"), rs) / size)
    return a.join(b, [*keys, "__bin"], "left").withColumn("met", F.coalesce(met & first, F.lit(False))).drop("__bin")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], size: int | None = None, closed: bool = False, how: str = "inner", row: Sequence[str] = (), prefix: str = "r_") -> DataFrame:
    """Pairs that share a base (closed: or touch).  Both sides have s and e; the right side's other columns get a
    prefix.  how: inner, left_semi or left_anti, the last two by ``row``, the columns that tell left rows apart."""
    keys, reach = list(keys), 0 if closed else 1
    if how != "inner":
        hit = overlap_join(left.select(*dict.fromkeys([*row, *keys, "s", "e"])), right.select(*keys, "s", "e"), keys, size, closed).select(*row).distinct()
        return left.join(hit, list(row), how)
    size, way = _sized(right, size)
    a = _binned(left, F.col("s"), F.col("e") - reach, size)
    b = _renamed(_binned(right, F.col("s"), F.col("e") - reach, size), prefix, [*keys, "__bin"]).hint(way)
    rs, re = F.col(f"{prefix}s"), F.col(f"{prefix}e")
    met = (F.col("s") <= re) & (rs <= F.col("e")) if closed else (F.col("s") < re) & (rs < F.col("e"))
    first = F.col("__bin") == F.floor(F.greatest(F.col("s"), rs) / size)
    return a.join(b, [*keys, "__bin"]).filter(met & first).drop("__bin")


def containment_join(left: DataFrame, right: DataFrame, keys: Sequence[str], size: int | None = None, prefix: str = "r_") -> DataFrame:
    """Overlapping pairs with enclosed: the left interval lies within the right one."""
    met = overlap_join(left, right, keys, size, prefix=prefix)
    return met.withColumn("enclosed", (F.col(f"{prefix}s") <= F.col("s")) & (F.col("e") <= F.col(f"{prefix}e")))


def stab_join(points: DataFrame, right: DataFrame, keys: Sequence[str], point: str = "p", size: int | None = None, strict: bool = False, prefix: str = "r_") -> DataFrame:
    """Points within intervals: s <= p < e, or s < p < e where strict."""
    keys, (size, way) = list(keys), _sized(right, size)
    a = points.withColumn("__bin", F.floor(F.col(point) / size))
    b = _renamed(_binned(right, F.col("s"), F.col("e") - 1, size), prefix, [*keys, "__bin"]).hint(way)
    p, rs, re = F.col(point), F.col(f"{prefix}s"), F.col(f"{prefix}e")
    return a.join(b, [*keys, "__bin"]).filter(((rs < p) if strict else (rs <= p)) & (p < re)).drop("__bin")


def tolerance_flag(points: DataFrame, known: DataFrame, keys: Sequence[str], point: str, reach: int, name: str) -> DataFrame:
    """Adds a flag: some known point lies within reach."""
    near = known.select(*keys, F.explode(F.sequence(F.col(point) - reach, F.col(point) + reach)).alias(point)).distinct().withColumn(name, F.lit(True))
    return points.join(near, [*keys, point], "left").withColumn(name, F.coalesce(name, F.lit(False)))


#: Windows over positions span one tile, not a whole chromosome.
TILE = 1 << 18


def _tiled(df: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Intervals cut at the tiles' edges, with their tile."""
    parts = df.filter("e > s").select(*keys, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / tile), F.floor((F.col("e") - 1) / tile))).alias("__tile"))
    return parts.select(*keys, "__tile", F.greatest("s", F.col("__tile") * tile).alias("s"), F.least("e", (F.col("__tile") + 1) * tile).alias("e"))


def _islands(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Touching intervals merged: a new island starts where s is beyond every earlier e."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*keys, "s", "e").distinct().withColumn("__new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__island")


def merge(df: DataFrame, keys: Sequence[str] = ("chrom",), tile: int = TILE) -> DataFrame:
    """Union of intervals, touching ones merged: tile by tile, and then, of what reaches a tile's edge, all together;
    those are two islands a tile at most."""
    keys = list(keys)
    within = _islands(_tiled(df, keys, tile), [*keys, "__tile"])
    # An island off the edges is alone in its window; the input is referred to once, so that plans don't double.
    edge = (F.col("s") % tile == 0) | (F.col("e") % tile == 0)
    return _islands(within.withColumn("__own", F.when(~edge, F.col("s"))), [*keys, "__own"]).drop("__own")


def _events(df: DataFrame, keys: Sequence[str], **steps: int) -> DataFrame:
    signs = F.explode(F.array(*[F.struct(F.col(c).alias("at"), *[F.lit(sign * v).alias(k) for k, v in steps.items()]) for c, sign in (("s", 1), ("e", -1))]))
    return df.select(*keys, signs.alias("__x")).select(*keys, "__x.*")


def subtract(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chrom",), tile: int = TILE) -> DataFrame:
    """What left covers and right does not, in one sweep over both sides' ends within each tile."""
    keys = list(keys)
    group = [*keys, "__tile"]
    events = _events(_tiled(left, keys, tile), group, a=1, b=0).unionByName(_events(_tiled(right, keys, tile), group, a=0, b=1))
    summed = events.groupBy(*group, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*group).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = summed.select(*keys, F.col("at").alias("s"), F.lead("at").over(w).alias("e"), F.sum("a").over(upto).alias("in_a"), F.sum("b").over(upto).alias("in_b"))
    return merge(swept.filter("in_a > 0 and in_b = 0 and e > s"), keys, tile)


def bases(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.col("e") - F.col("s")), F.lit(0)).cast("long").alias("bases"))


def depth_segments(df: DataFrame, keys: Sequence[str] = ("chrom",), tile: int | None = None) -> DataFrame:
    """Segments (s, e, depth) of constant depth.  With a tile, intervals are first cut at its multiples."""
    keys = list(keys)
    group = [*keys, "__tile"] if tile else keys
    events = _events(_tiled(df, keys, tile) if tile else df, group, step=1).groupBy(*group, "at").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*group).orderBy("at")
    swept = events.select(*keys, F.col("at").alias("s"), F.lead("at").over(w).alias("e"), F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("depth"))
    return swept.filter("depth > 0 and e is not null")


def depth_histogram(df: DataFrame, keys: Sequence[str] = ("chrom",), tile: int | None = 1 << 20) -> DataFrame:
    """depth -> number of positions."""
    return depth_segments(df, keys, tile).groupBy("depth").agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("positions"))


def bases_within(queries: DataFrame, merged: DataFrame, keys: Sequence[str], row: str, tile: int = 1 << 12) -> DataFrame:
    """row -> bases of the merged intervals within each query interval; queries without any are left out.

    The bases before a query's end less those before its start: both are a running sum over tiles and what lies
    before the point within its tile, so that a long query costs no more than a short one.
    """
    keys = list(keys)
    ends = F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(-1).alias("sign")), F.struct(F.col("e").alias("p"), F.lit(1).alias("sign"))))
    points = queries.filter("e > s").select(row, *keys, ends.alias("x")).select(row, *keys, "x.p", "x.sign", F.floor(F.col("x.p") / tile).alias("__tile"))
    parts = _tiled(merged, keys, tile)
    sums = parts.groupBy(*keys, "__tile").agg(F.sum(F.col("e") - F.col("s")).alias("bases"))
    every = sums.unionByName(points.select(*keys, "__tile", F.lit(0).cast("long").alias("bases")).distinct()).groupBy(*keys, "__tile").agg(F.sum("bases").alias("bases"))
    upto = F.coalesce(F.sum("bases").over(Window.partitionBy(*keys).orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = points.join(every.select(*keys, "__tile", upto.alias("upto")), [*keys, "__tile"]).join(parts, [*keys, "__tile"], "left")
    inside = F.coalesce(F.sum(F.greatest(F.least("e", "p") - F.col("s"), F.lit(0))), F.lit(0))
    before = placed.groupBy(row, "sign").agg((F.max("upto") + inside).alias("bases"))
    return before.groupBy(row).agg(F.sum(F.col("sign") * F.col("bases")).cast("long").alias("bases")).filter("bases > 0")
