"""Gene counting: hits, statuses, the duplication matrix.

Inputs: blocks with what tells reads apart, flag, chrom, s, e; genes (exons) with
gene_id, chrom, s, e, strand and, for biotypes, biotype.  A read without blocks has
one row without an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratalign.functions.flags import DUPLICATE, has, is_multi, strand_matches
from stratalign.operators.intervals import overlap_candidates


def _met(blocks: DataFrame, exons: DataFrame, carry: Sequence[str], protocol: str, paired: bool) -> tuple[DataFrame, Column]:
    """Blocks beside exons, and the gene of those that share a base on a fitting strand."""
    wanted = dict.fromkeys([*carry, "flag", "chrom", "s", "e"])
    met = overlap_candidates(blocks.select(*wanted), exons.select("gene_id", "strand", "chrom", "s", "e"), ["chrom"])
    fits = F.col("met") if protocol == "unstranded" else F.col("met") & strand_matches(protocol, F.col("r_strand"), paired)
    return met, F.when(fits, F.col("r_gene_id"))


def gene_hits(blocks: DataFrame, exons: DataFrame, carry: Sequence[str], protocol: str = "unstranded", paired: bool = False) -> DataFrame:
    """A row for each read: carry (which tells reads apart), the sorted distinct genes, their number n, and gene_id, the
    first of them."""
    met, gene = _met(blocks, exons, carry, protocol, paired)
    hits = met.groupBy(*carry).agg(F.array_sort(F.collect_set(gene)).alias("genes"))
    return hits.withColumns({"n": F.size("genes"), "gene_id": F.try_element_at("genes", F.lit(1))})


def sole_genes(blocks: DataFrame, exons: DataFrame, carry: Sequence[str], protocol: str = "unstranded", paired: bool = False) -> DataFrame:
    """As gene_hits without the genes: n is 0, 1 or 2 (for several), and gene_id the least.  No list is made."""
    met, gene = _met(blocks, exons, carry, protocol, paired)
    ends = met.groupBy(*carry).agg(F.min(gene).alias("gene_id"), F.max(gene).alias("last"))
    return ends.withColumn("n", F.when(F.col("gene_id").isNull(), 0).when(F.col("gene_id") == F.col("last"), 1).otherwise(2)).drop("last")


def vote(a: str, b: str):
    """Genes hit by both mates if there are any, else those hit by one."""
    both = F.array_intersect(a, b)
    return F.when(F.size(both) > 0, F.array_sort(both)).otherwise(F.array_sort(F.array_union(a, b)))


def gene_counts(hits: DataFrame) -> DataFrame:
    """gene_id with the four counters by duplicates and multimappers, of fragments with exactly one gene."""
    one = hits.filter("n = 1").select("gene_id", has(DUPLICATE).alias("dup"), is_multi().alias("multi"))
    return one.groupBy("gene_id").agg(
        F.count("*").alias("all_multi"),
        F.count_if(~F.col("dup")).alias("filt_multi"),
        F.count_if(~F.col("multi")).alias("all_unique"),
        F.count_if(~F.col("dup") & ~F.col("multi")).alias("filt_unique"),
    )


def dup_matrix(counts: DataFrame, genes: DataFrame, total) -> DataFrame:
    """The 14 columns per gene; genes has gene_id and length, total is the number of counted fragments."""
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("all_multi", "filt_multi", "all_unique", "filt_unique")]
    base = genes.select("gene_id", "length").join(counts, "gene_id", "left").select("gene_id", "length", *zero)
    nan = F.lit(float("nan"))

    def block(kind: str, tag: str) -> list:
        everything, kept = F.col(f"all_{kind}"), F.col(f"filt_{kind}")
        rpk = everything * (F.lit(1000.0) / F.col("length"))
        rate = F.when(everything > 0, (everything - kept) / everything).otherwise(nan)
        return [rate.alias(f"dup_rate{tag}"), (everything - kept).alias(f"dups_per_id{tag}"), rpk.alias(f"rpk{tag}"), (rpk * (F.lit(1e6) / total)).alias(f"rpkm{tag}")]

    return base.select("*", *block("multi", "_multi"), *block("unique", ""))


def read_status(hits: DataFrame) -> DataFrame:
    """hits with status: multimapping, then by the number of genes."""
    n = F.col("n")
    return hits.withColumn("status", F.when(is_multi(), "multimapping").when(n == 0, "no_features").when(n == 1, "assigned").otherwise("ambiguous"))


def biotype_status(hits: DataFrame, genes: DataFrame) -> DataFrame:
    """Unique reads with biotypes (distinct) and a status; each gene without a biotype is a feature of its own."""
    unique = hits.filter(~is_multi())
    spread = unique.select("rid", F.explode_outer("genes").alias("gene_id")).join(genes.select("gene_id", "biotype").distinct(), "gene_id", "left")
    each = spread.groupBy("rid").agg(F.collect_set("biotype").alias("biotypes"), F.count_if(F.col("gene_id").isNotNull() & F.col("biotype").isNull()).alias("untyped"))
    n = F.size("biotypes") + F.col("untyped")
    return each.withColumn("status", F.when(n == 0, "no_features").when(n == 1, "assigned").otherwise("ambiguous"))
