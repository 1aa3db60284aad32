"""Mate pairs: matching, insert sizes, inner distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stratalign.functions.flags import READ1, REVERSE, clear, has
from stratalign.operators.intervals import bases_within, stab_join


def mates(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with matched: both mates are there.  One aggregate in place of a self-join."""
    sides = reads.groupBy(*keys).agg(F.count_if(has(READ1)).alias("n1"), F.count_if(clear(READ1)).alias("n2"))
    return sides.withColumn("matched", (F.col("n1") > 0) & (F.col("n2") > 0))


def insert_sizes(reads: DataFrame, keys: Sequence[str], most: int = 8000) -> DataFrame:
    """size -> total, inward, outward, other, over keys with two reads; size is capped into the last bucket."""
    forward = F.min(F.when(clear(REVERSE), F.col("pos")))
    backward = F.min(F.when(has(REVERSE), F.col("pos")))
    pairs = reads.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pos").alias("a"), F.max(F.col("pos") + F.col("len")).alias("z"), forward.alias("f"), backward.alias("v")).filter("n = 2")
    return pairs.groupBy(F.least(F.col("z") - F.col("a"), F.lit(most)).alias("size")).agg(F.count("*").alias("total"), F.count_if(F.col("f") < F.col("v")).alias("inward"), F.count_if(F.col("f") > F.col("v")).alias("outward"), F.count_if(F.col("f").isNull() | F.col("v").isNull() | (F.col("f") == F.col("v"))).alias("other"))


def inner_distances(reads: DataFrame, key: str) -> DataFrame:
    """key, tid, a (end of the earlier mate), z (start of the later one), dist; dist is null across references."""
    pairs = reads.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("ln").alias("kinds"), F.min("tid").alias("tid"), F.max("tid").alias("other"), F.min("end").alias("a"), F.max("pos").alias("z"))
    same = F.col("tid") == F.col("other")
    return pairs.filter("n = 2 and kinds = 2").select(key, "tid", "a", "z", F.when(same, F.col("z") - F.col("a")).alias("dist"))


def distance_histogram(df: DataFrame, low: int, high: int, step: int, column: str = "dist") -> DataFrame:
    """lo -> pairs with lo < dist <= lo + step, empty bins included."""
    inside = df.filter((F.col(column) > low) & (F.col(column) <= high)).withColumn("lo", (F.ceil((F.col(column) - low) / step) - 1) * step + low)
    counted = inside.groupBy("lo").agg(F.count("*").alias("pairs"))
    grid = df.sparkSession.range(low, high, step).select(F.col("id").alias("lo"))
    return grid.join(counted, "lo", "left").select("lo", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def classify(pairs: DataFrame, transcripts: DataFrame, exons: DataFrame, key: str = "qname") -> DataFrame:
    """The inner-distance classes.  pairs: key, chrom, mate_chrom, read1_end, read2_start and overlap (aligned bases
    that mates share); transcripts: tx_id, chrom, s, e; exons: merged chrom, s, e."""
    same = pairs.filter(F.col("chrom") == F.col("mate_chrom"))
    apart = same.withColumn("dist", F.when(F.col("read2_start") >= F.col("read1_end"), F.col("read2_start") - F.col("read1_end")).otherwise(-F.col("overlap")))
    ends = stab_join(apart.select(key, "chrom", (F.col("read1_end") - 1).alias("p")), transcripts.select("chrom", "s", "e", "tx_id"), ["chrom"]).select(key, "r_tx_id")
    starts = stab_join(apart.select(key, "chrom", F.col("read2_start").alias("p")), transcripts.select("chrom", "s", "e", "tx_id"), ["chrom"]).select(key, "r_tx_id")
    common = ends.join(starts, [key, "r_tx_id"]).select(key).distinct().withColumn("shared", F.lit(True))
    gaps = apart.filter("dist > 0").select(key, "chrom", F.col("read1_end").alias("s"), F.col("read2_start").alias("e"))
    exonic = bases_within(gaps, exons, ["chrom"], key)
    known = exons.select("chrom").distinct().withColumn("known", F.lit(True))
    joined = apart.join(common, key, "left").join(exonic, key, "left").join(known, "chrom", "left").withColumn("bases", F.coalesce("bases", F.lit(0)))
    label = (
        F.when(F.col("shared").isNull(), "sameTranscript=No,dist=genomic")
        .when(F.col("dist") <= 0, "readPairOverlap")
        .when(F.col("known").isNull(), "unknownChromosome,dist=genomic")
        .when(F.col("bases") == F.col("dist"), "sameTranscript=Yes,sameExon=Yes,dist=mRNA")
        .when(F.col("bases") > 0, "sameTranscript=Yes,sameExon=No,dist=mRNA")
        .otherwise("sameTranscript=Yes,nonExonic=Yes,dist=genomic")
    )
    labelled = joined.withColumn("class", label)
    distance = F.when(F.col("class") == "sameTranscript=Yes,sameExon=No,dist=mRNA", F.col("bases")).otherwise(F.col("dist"))
    across = pairs.filter(F.col("chrom") != F.col("mate_chrom")).select(key, F.lit(None).cast("long").alias("dist"), F.lit("sameChrom=No").alias("class"))
    return labelled.select(key, distance.cast("long").alias("dist"), "class").unionByName(across)
