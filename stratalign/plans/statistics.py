"""Alignment statistics: fused counters, histograms, per-cycle matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalign.functions import cigar as cg
from stratalign.functions.flags import DUPLICATE, MATE_REVERSE, MATE_UNMAPPED, PAIRED, PROPER_PAIR, QC_FAIL, READ1, READ2, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED, clear, has, primary


def read_class(cut: int = 30) -> Column:
    """The exclusive classes; the first that fits counts."""
    return F.when(has(QC_FAIL), "qc_failed").when(has(DUPLICATE), "duplicate").when(has(SECONDARY), "non_primary").when(has(UNMAPPED), "unmapped").when(F.col("mapq") < cut, "non_unique").otherwise("unique")


def bam_stat(reads: DataFrame, cut: int = 30) -> DataFrame:
    """All counters in one aggregate over one scan; spliced is a column of reads."""
    reads = reads.withColumn("__class", read_class(cut))
    unique = F.col("__class") == "unique"
    each = {name: F.col("__class") == kind for name, kind in (("qc_failed", "qc_failed"), ("duplicates", "duplicate"), ("non_primary", "non_primary"), ("unmapped", "unmapped"), ("non_unique", "non_unique"), ("unique", "unique"))}
    each |= {"read_1": unique & has(READ1), "read_2": unique & has(READ2), "forward": unique & clear(REVERSE), "reverse": unique & has(REVERSE), "spliced": unique & F.col("spliced"), "non_spliced": unique & ~F.col("spliced"), "proper_pairs": unique & has(PAIRED) & has(PROPER_PAIR)}
    return reads.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in each.items()])


def flagstat(reads: DataFrame) -> DataFrame:
    """Duplicates are those that the exclusive classes count: failed reads are not among them."""
    pair = primary() & has(PAIRED)
    each = {
        "secondary": has(SECONDARY),
        "supplementary": has(SUPPLEMENTARY),
        "duplicates": has(DUPLICATE) & clear(QC_FAIL),
        "primary_duplicates": primary() & has(DUPLICATE),
        "mapped": clear(UNMAPPED),
        "primary_reads": primary(),
        "primary_mapped": primary() & clear(UNMAPPED),
        "paired": pair,
        "read1": pair & has(READ1),
        "read2": pair & has(READ2),
        "properly_paired": pair & has(PROPER_PAIR),
        "both_mapped": pair & clear(UNMAPPED | MATE_UNMAPPED),
        "singletons": pair & clear(UNMAPPED) & has(MATE_UNMAPPED),
    }
    if {"tid", "mtid"} <= set(reads.columns):
        apart = pair & clear(UNMAPPED | MATE_UNMAPPED) & (F.col("tid") != F.col("mtid"))
        each |= {"mate_other_chrom": apart, "mate_other_chrom_mapq5": apart & (F.col("mapq") >= 5)}
    return reads.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in each.items()])


def idxstats(reads: DataFrame, header: DataFrame) -> DataFrame:
    """Per reference: length, mapped and unmapped reads; a row with a null tid has the unplaced ones."""
    placed = reads.filter("tid >= 0").groupBy("tid").agg(F.count_if(clear(UNMAPPED)).alias("mapped"), F.count_if(has(UNMAPPED)).alias("unmapped"))
    listed = header.join(placed, "tid", "left").select(*header.columns, F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))
    rest = reads.filter("tid is null or tid < 0").agg(F.count_if(has(UNMAPPED)).alias("unmapped"))
    return listed.unionByName(rest.select(*[F.lit(0 if c == "length" else None).cast(header.schema[c].dataType).alias(c) for c in header.columns], F.lit(0).cast("long").alias("mapped"), "unmapped"))


def length_sums(reads: DataFrame) -> DataFrame:
    last = has(READ2)
    ln = F.col("len")
    return reads.filter(primary()).agg(
        F.sum(ln).alias("total"),
        F.sum(F.when(~last, ln)).alias("first_total"),
        F.sum(F.when(last, ln)).alias("last_total"),
        F.sum(F.when(clear(UNMAPPED), ln)).alias("mapped"),
        F.sum(F.when(has(DUPLICATE), ln)).alias("duplicated"),
        F.max(ln).alias("longest"),
        F.max(F.when(~last, ln)).alias("longest_first"),
        F.max(F.when(last, ln)).alias("longest_last"),
    )


def histogram(df: DataFrame, column: str, name: str = "reads") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def checksums(reads: DataFrame) -> DataFrame:
    """Sums modulo 2**32 of CRC-32 over names, packed bases and raw qualities, over every record."""
    seq = F.coalesce("seq", F.lit(""))
    even = F.when(F.length(seq) % 2 == 1, F.concat(seq, F.lit("="))).otherwise(seq)
    packed = F.unhex(F.translate(even, "=ACMGRSVTWYHKDBN", "0123456789ABCDEF"))
    total = lambda c: F.pmod(F.sum(F.crc32(c)), F.lit(1 << 32))
    return reads.agg(total(F.col("qname").cast("binary")).alias("names"), total(packed).alias("sequences"), total("qual").alias("qualities"))


def base_composition(reads: DataFrame) -> DataFrame:
    """cycle x base over sequences; any other letter counts as n."""
    each = reads.select(F.posexplode(F.split("seq", "")).alias("at", "base")).filter("base <> ''")
    return each.groupBy((F.col("at") + 1).cast("long").alias("cycle"), F.when(F.col("base").isin("a", "c", "g", "t"), F.col("base")).otherwise("n").alias("base")).agg(F.count("*").alias("n"))


def quality_by_cycle(reads: DataFrame, offset: int = 33, most: int = 63) -> DataFrame:
    """cycle x quality bucket, of quality strings."""
    each = reads.select(F.posexplode(F.split("qual", "")).alias("at", "q")).filter("q <> ''").withColumn("code", F.expr("cast(ascii(q) as int)")).filter(F.col("code") >= offset)
    return each.groupBy((F.col("at") + 1).cast("long").alias("cycle"), F.least(F.col("code") - offset, F.lit(most)).cast("int").alias("quality")).agg(F.count("*").alias("n"))


def cycle_matrices(reads: DataFrame) -> DataFrame:
    """fragment x cycle x base x quality counts of primary reads in one explode; cycles of reverse reads are
    turned to read order.  The per-cycle sections of the report are sums over it."""
    last = has(READ2) & has(PAIRED)
    codes = F.transform(F.split(F.hex("qual"), "(?<=\\G..)"), lambda h: F.conv(h, 16, 10).cast("int"))
    pairs = F.arrays_zip(F.split("seq", "").alias("base"), codes.alias("quality"))
    each = reads.filter(primary()).select(F.when(last, "last").otherwise("first").alias("fragment"), has(REVERSE).alias("reverse"), F.length("seq").alias("n"), F.posexplode(pairs).alias("at", "x"))
    each = each.filter("at < n")
    cycle = F.when(F.col("reverse"), F.col("n") - 1 - F.col("at")).otherwise(F.col("at"))
    base = F.when(F.col("x.base").isin("A", "C", "G", "T", "N"), F.col("x.base")).otherwise("other")
    return each.groupBy("fragment", cycle.alias("cycle"), "reverse", base.alias("base"), F.least(F.coalesce("x.quality", F.lit(255)), F.lit(63)).alias("quality")).agg(F.count("*").alias("n"))


def indel_histogram(reads: DataFrame) -> DataFrame:
    """kind x length of insertions and deletions; ops is the parsed CIGAR."""
    each = reads.select(F.explode(cg.indels(F.col("ops"))).alias("x"))
    return each.groupBy(F.col("x.op").alias("kind"), F.col("x.len").alias("len")).agg(F.count("*").alias("n"))


def indel_cycles(reads: DataFrame) -> DataFrame:
    """cycle (from 1) x (insertions, deletions) x (first, last).  An insertion counts at its first base in read order, a
    deletion at the base before it; deletions before the first base are left out, and reads marked as both
    ends or, in pairs, as none."""
    order = F.when(clear(PAIRED) | (has(READ1) & clear(READ2)), "first").when(clear(READ1) & has(READ2), "last")
    each = reads.select(order.alias("end"), has(REVERSE).alias("reverse"), F.col("len").alias("n"), F.explode(cg.indels(F.col("ops"))).alias("x")).filter("end is not null")
    insertion, at = F.col("x.op") == "I", F.col("x.cycle")
    back = F.greatest(F.col("n") - at - F.when(insertion, F.col("x.len")).otherwise(1), F.lit(0)) + 1
    cycle = F.when(F.col("reverse"), back).when(insertion, at + 1).otherwise(at)
    counted = each.filter(insertion | (at > 0)).groupBy(cycle.alias("cycle"))
    return counted.agg(*[F.count_if((F.col("x.op") == op) & (F.col("end") == end)).alias(f"{name}_{end}") for op, name in (("I", "insertions"), ("D", "deletions")) for end in ("first", "last")])


def _mapped_and_primary() -> Column:
    return primary() & clear(UNMAPPED)


def template_orientation() -> Column:
    """inward, outward or other, as one mate sees it."""
    first = F.when(has(READ1), 1).otherwise(-1)
    apart, forward = first * F.signum(F.col("mpos") - F.col("pos")), F.when(has(REVERSE), -1).otherwise(1)
    return F.when(has(REVERSE) == has(MATE_REVERSE), "other").when((apart == 0) | (apart == first * forward), "inward").otherwise("outward")


def templates(reads: DataFrame) -> DataFrame:
    """size (absolute, at most 8000) and orientation of each primary read whose mate is mapped too; both mates count."""
    kept = reads.filter(_mapped_and_primary() & has(PAIRED) & clear(MATE_UNMAPPED) & ((F.col("tlen") != 0) | (F.col("tid") == F.col("mtid"))))
    return kept.select(F.least(F.abs("tlen"), F.lit(8000)).alias("size"), template_orientation().alias("orientation"))


def template_sizes(reads: DataFrame) -> DataFrame:
    """size -> total, inward, outward, other."""
    return templates(reads).groupBy("size").agg(F.count("*").alias("total"), *[F.count_if(F.col("orientation") == o).alias(o) for o in ("inward", "outward", "other")])


def report_counters(reads: DataFrame) -> DataFrame:
    """What the statistics report sums up in one pass: fragments, mates, bases, mismatches, qualities."""
    p, mapped, last = primary(), _mapped_and_primary(), has(PAIRED) & has(READ2)
    codes = F.transform(F.split(F.hex("qual"), "(?<=\\G..)"), lambda h: F.coalesce(F.conv(h, 16, 10).cast("long"), F.lit(0)))
    quality = F.when(p & clear(QC_FAIL) & F.col("qual").isNotNull(), F.aggregate(codes, F.lit(0).cast("long"), lambda x, y: x + y))
    aligned = F.when(clear(UNMAPPED | SECONDARY), cg.query_aligned_length(F.col("ops")))
    counts = {
        "qc_failed": has(QC_FAIL),
        "first_fragments": p & ~last,
        "last_fragments": p & last,
        "mapped_and_paired": mapped & has(PAIRED) & clear(QC_FAIL | MATE_UNMAPPED),
        "mapq0": mapped & (F.col("mapq") == 0),
    }
    sums = {"bases_aligned": aligned, "mismatches": F.when(mapped, F.greatest(F.col("nm"), F.lit(0))), "quality_sum": quality, "quality_bases": F.when(quality.isNotNull(), F.octet_length("qual"))}
    return reads.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for n, c in sums.items()])


def duplicate_check(reads: DataFrame) -> DataFrame:
    """fails: reads are mapped and none of them is marked as a duplicate."""
    mapped, dup = F.count_if(clear(UNMAPPED)), F.count_if(clear(UNMAPPED) & has(DUPLICATE))
    return reads.agg(mapped.alias("mapped"), dup.alias("duplicates"), ((mapped > 0) & (dup == 0)).alias("fails"))


def map_names(df: DataFrame, mapping: dict[str, str], prefix: str, column: str) -> DataFrame:
    """chrom: the mapped name, else the name with the prefix."""
    key = F.col(column).cast("string")
    if not mapping:
        return df.withColumn("chrom", F.concat(F.lit(prefix), key))
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn("chrom", F.coalesce(F.try_element_at(table, key), F.concat(F.lit(prefix), key)))
