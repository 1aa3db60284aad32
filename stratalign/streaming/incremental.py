"""Counters over growing inputs: the fused counters are sums, so batches merge.

An extension beside the batch analyses.  State is one small Parquet table per
micro-batch number; a repeated batch overwrites its own, so that restarts count
nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalign.plans import statistics as st


def merge(parts: DataFrame) -> DataFrame:
    """One row of sums from rows of counters."""
    return parts.agg(*[F.sum(c).alias(c) for c in parts.columns])


def stream_counters(reads: DataFrame, folder: str, mapq: int = 30) -> StreamingQuery:
    """Starts counting a stream of reads (flag, mapq, spliced) into folder/state; stops when the input is read."""

    def add(batch: DataFrame, number: int) -> None:
        st.bam_stat(batch, mapq).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def counters(spark: SparkSession, folder: str) -> DataFrame:
    return merge(spark.read.parquet(f"{folder}/state").drop("batch"))
