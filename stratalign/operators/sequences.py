"""Operators that depend on order: saturation, steps, bulks, bins, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def count_of_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """times -> how many keys occur so often."""
    return df.groupBy(*keys).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias(name))


def _written(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint: range bounds come from samples, and rows of a lost executor made anew
    could lie elsewhere.  A session without a checkpoint folder, as in tests, holds the rows instead."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rn") -> DataFrame:
    """A global row number without a single-partition window: range partitions in order, each numbered from the
    number of rows before it."""
    keyed = df.withColumns({f"__k{i}": c for i, c in enumerate(order)})
    keys = [f"__k{i}" for i in range(len(order))]
    held = _written(keyed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    counts = held.groupBy("__part").agg(F.count("*").alias("n")).collect()  # a row a partition
    before, total = [], 0
    for row in sorted(counts):
        before.append((row["__part"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "__part int, __before long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return held.withColumn("__within", within).join(F.broadcast(offsets), "__part").withColumns({name: F.col("__within") + F.col("__before"), "total": F.lit(total).cast("long")}).drop("__part", "__before", "__within", *keys)


def saturation(events: DataFrame, keys: Sequence[str], order: Sequence[Column], percents: Sequence[int], name: str = "n", least: int = 1) -> DataFrame:
    """pct -> keys seen at least ``least`` times within the first pct percent of the events in the given order."""
    numbered = ranked(events, order)
    if least > 1:
        numbered = numbered.withColumn("__seen", F.row_number().over(Window.partitionBy(*keys).orderBy("rn"))).filter(F.col("__seen") >= least)
    first = numbered.groupBy(*keys).agg(F.min("rn").alias("first"), F.first("total").alias("total"))
    counts = [F.count_if(F.col("first") <= F.expr(f"total * {p} div 100")).alias(str(p)) for p in percents]
    return first.agg(*counts).unpivot([], [str(p) for p in percents], "pct", name).select(F.col("pct").cast("int").alias("pct"), name)


def step_histogram(df: DataFrame, value: str, length: str, bins: int) -> DataFrame:
    """Each row adds one to the bins from value * bins / length up to (value + 1) * bins / length: a difference
    array and its running sum."""
    steps = F.array(F.struct(F.expr(f"{value} * {bins} div {length}").alias("bin"), F.lit(1).alias("step")), F.struct(F.expr(f"({value} + 1) * {bins} div {length}").alias("bin"), F.lit(-1).alias("step")))
    summed = df.select(F.explode(steps).alias("x")).groupBy("x.bin").agg(F.sum("x.step").alias("step"))  # a row a bin
    return summed.select("bin", F.sum("step").over(Window.orderBy("bin")).cast("long").alias("reads"))


def changes(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows of a small histogram whose value differs from the row before (0 before the first)."""
    before = F.lag(value, 1, 0).over(Window.orderBy(order))
    return df.withColumn("__before", before).filter(F.col(value) != F.col("__before")).drop("__before")


def main_bulk(histogram: DataFrame, order: str, count: str, share: float) -> DataFrame:
    """Bins of a histogram up to the one in which the running share passes ``share``."""
    w = Window.orderBy(order)
    upto = F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(count).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = histogram.withColumn("__upto", upto)
    return marked.withColumn("__before", F.lag("__upto", 1, 0.0).over(w)).filter(F.col("__before") <= share).drop("__upto", "__before")


def quantile_bins(df: DataFrame, column: str, quantiles: Sequence[float]) -> DataFrame:
    """Adds bin: how many of the exact quantiles the value has reached."""
    cuts = df.agg(F.percentile(column, list(quantiles)).alias("cuts")).first()["cuts"] or []
    passed = [F.when(F.col(column) >= c, 1).otherwise(0) for c in cuts]
    return df.withColumn("bin", sum(passed[1:], passed[0]) if passed else F.lit(0))


def top(df: DataFrame, by: str, ties: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *ties).limit(n)


def tiers(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n lowest and highest rows by value, equal values counting once by their smallest key."""
    once = df.groupBy(value).agg(F.min(key).alias(key))
    low = once.orderBy(F.col(value)).limit(n).select(key, F.lit(True).alias("low"))
    high = once.orderBy(F.col(value).desc()).limit(n).select(key, F.lit(True).alias("high"))
    return low.join(high, key, "full").select(key, F.coalesce("low", F.lit(False)).alias("low"), F.coalesce("high", F.lit(False)).alias("high"))


def best_per_group(df: DataFrame, keys: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """value of the row that is greatest by the columns; of ties the later key wins."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*by)).alias(value))


def last_by(df: DataFrame, keys: Sequence[str], order: str, columns: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(n) for n, c in columns.items()])


def percentiles_p(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """keys, p, value: the p(n+1)/100 percentile of each group, between its least and largest values.  A group's ranks
    come from one window; only the two rows beside each percentile go on."""
    w = Window.partitionBy(*keys)
    ranked_ = df.select(*keys, F.col(value).alias("x"), F.row_number().over(w.orderBy(value)).alias("rn"), F.count("*").over(w).alias("n"))
    spread = ranked_.withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents])))
    at = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("p") * (F.col("n") + 1) / 100))
    part = F.greatest(F.lit(0.0), 1 - F.abs(F.col("rn") - at))
    return spread.filter(F.abs(F.col("rn") - at) < 1).groupBy(*keys, "p").agg(F.sum(F.col("x") * part).alias("value"))
