"""GTF annotation: exons, transcripts and genes, 0-based and half-open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratalign.operators.intervals import bases, merge
from stratalign.sources.probe import GZIP, first_bytes

FEATURES = ("exon", "CDS", "start_codon", "stop_codon")


def attribute(name: str, column: str = "attributes") -> Column:
    """The first value of a GTF attribute; empty is null."""
    return F.nullif(F.regexp_extract(column, rf'(?:^|;)\s*{name}\s+"?([^";]*)"?', 1), F.lit(""))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a plain or gzip file, known by its first bytes and not by its name."""
    zipped = first_bytes(spark, path, 2) == GZIP
    if zipped == path.endswith(".gz"):  # Spark goes by the name
        return spark.read.text(path).withColumn("row", F.monotonically_increasing_id())

    def lines(batches):
        import gzip

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                found = (gzip.decompress(raw) if zipped else raw).decode().splitlines()
                yield pa.RecordBatch.from_pydict({"value": pa.array(found, pa.string()), "row": pa.array(range(len(found)), pa.int64())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string, row long")


def read_gtf(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> DataFrame:
    """Feature lines: gene_id, tx_id, feature, chrom, s, e, strand, row and the asked attributes.

    Comments, empty lines, lines of fewer than nine fields and lines without gene_id are left out; a start after
    its end, or one that is no number, is an error.
    """
    part = F.split("value", "\t")
    lines = read_text(spark, path).filter(~F.col("value").startswith("#") & (F.size(part) >= 9))
    rows = lines.select("row", part[0].alias("chrom"), part[2].alias("feature"), part[3].alias("start"), part[4].alias("end"), part[6].alias("strand"), part[8].alias("attributes")).filter(F.col("feature").isin(*FEATURES))
    start, end = F.expr("try_cast(start as bigint)"), F.expr("try_cast(end as bigint)")
    sane = F.when(start.isNull() | end.isNull() | (start > end), F.raise_error(F.concat(F.lit("bad GTF interval: "), "start", F.lit("-"), "end"))).otherwise(start - 1)
    rows = rows.withColumn("gene_id", attribute("gene_id")).filter("gene_id is not null")
    tx = F.coalesce(attribute("transcript_id"), F.concat("gene_id", F.lit("__no_tx")))
    return rows.select("row", "gene_id", tx.alias("tx_id"), "feature", "chrom", sane.cast("long").alias("s"), end.alias("e"), "strand", *[attribute(a).alias(a) for a in extra])


def has_attribute(spark: SparkSession, path: str, name: str, lines: int = 1000) -> bool:
    """Whether one of the first exon lines has the attribute: a probe, as its limit is the feature."""
    part = F.split("value", "\t")
    probe = read_text(spark, path).filter((F.size(part) >= 9) & (part[2] == "exon")).orderBy("row").limit(lines).select(part[8].alias("attributes"))
    return not probe.filter(attribute(name).isNotNull()).isEmpty()


def biotype_attribute(spark: SparkSession, path: str, asked: str = "gene_biotype") -> str | None:
    """The asked attribute, or its usual other name, if the file has it."""
    for name in dict.fromkeys([asked, "gene_biotype", "gene_type"]):
        if has_attribute(spark, path, name):
            return name
    return None


def genes(features: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """gene_id, gene_ord (first seen), chrom, strand and attributes of its first exon, span, effective length and
    exons in file order.  The length merges exons whatever their chromosome."""
    exons = features.filter("feature = 'exon'")
    first = lambda c: F.min_by(c, "row").alias(c)
    named = exons.groupBy("gene_id").agg(F.min("row").alias("__row"), first("chrom"), first("strand"), F.min("s").alias("s"), F.max("e").alias("e"), *[first(a) for a in extra], F.array_sort(F.collect_list(F.struct("row", "chrom", "s", "e", "strand"))).alias("exons"))
    lengths = bases(merge(exons, ["gene_id"]), ["gene_id"]).withColumnRenamed("bases", "length")
    ordered = named.join(lengths, "gene_id")
    return ordered.withColumn("gene_ord", (F.row_number().over(Window.orderBy("__row")) - 1).cast("int")).drop("__row")


def transcripts(features: DataFrame) -> DataFrame:
    """tx_id, gene_id, chrom, strand, span, sorted exons and the thick range (null without CDS lines).

    The last start and stop codon lines win; on the minus strand the codons' other ends count.
    """
    exons = features.filter("feature = 'exon'").groupBy("tx_id", "gene_id").agg(F.min_by("chrom", "row").alias("chrom"), F.min_by("strand", "row").alias("strand"), F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons"), F.min("row").alias("row"))
    last = lambda kind, c: F.max_by(F.when(F.col("feature") == kind, F.col(c)), F.when(F.col("feature") == kind, F.col("row")))
    codons = features.filter("feature <> 'exon'").groupBy("tx_id").agg(F.count_if(F.col("feature") == "CDS").alias("cds"), last("start_codon", "s").alias("start_s"), last("start_codon", "e").alias("start_e"), last("stop_codon", "s").alias("stop_s"), last("stop_codon", "e").alias("stop_e"))
    joined = exons.join(codons, "tx_id", "left")
    plus, minus = F.col("strand") == "+", F.col("strand") == "-"
    # On the minus strand a codon's far end is two bases before its last, or two after its first.
    start = F.when(plus, F.coalesce("start_s", "s")).when(minus, F.coalesce(F.col("stop_e") - 3, F.col("s"))).otherwise(F.col("s"))
    end = F.when(plus, F.coalesce("stop_e", "e")).when(minus, F.coalesce(F.col("start_s") + 3, F.col("e"))).otherwise(F.col("e"))
    known = F.col("cds") > 0
    return joined.select("tx_id", "gene_id", "chrom", "strand", "s", "e", "exons", "row", F.when(known, start).alias("cds_start"), F.when(known, end).alias("cds_end"))
