"""Alignment flag bits and the read filters of each analysis as Column predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The bits of an alignment's flag.
PAIRED, PROPER_PAIR, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800


def has(mask: int, flag: Column | str = "flag") -> Column:
    """Any of the mask's bits is set."""
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(F.lit(mask)) != 0


def clear(mask: int, flag: Column | str = "flag") -> Column:
    """None of the mask's bits is set."""
    return ~has(mask, flag)


def mapq_at_least(cut: int) -> Column:
    return F.col("mapq") >= cut


#: Filters by analysis; what differs between them is which bits must be clear and whether quality counts.
def counting(paired: bool) -> Column:
    kept = clear(UNMAPPED | SUPPLEMENTARY | QC_FAIL)
    return kept & has(PAIRED) if paired else kept


def primary() -> Column:
    return clear(SECONDARY | SUPPLEMENTARY)


def usable(cut: int | None = None) -> Column:
    """Clear of qc failure, duplicate, secondary and unmapped, and of low quality if a cut is given."""
    kept = clear(QC_FAIL | DUPLICATE | SECONDARY | UNMAPPED)
    return kept if cut is None else kept & mapq_at_least(cut)


def duplication_reads(cut: int) -> Column:
    return clear(UNMAPPED | QC_FAIL) & mapq_at_least(cut)


def inner_distance_reads(cut: int) -> Column:
    return usable(cut) & clear(MATE_UNMAPPED) & has(PAIRED)


def integrity_reads() -> Column:
    return clear(UNMAPPED | QC_FAIL | SECONDARY)


def complexity_reads() -> Column:
    return primary() & (F.col("tid") >= 0)


def gene_body_reads() -> Column:
    return clear(UNMAPPED | SECONDARY | SUPPLEMENTARY | QC_FAIL) & (F.coalesce(F.col("nh"), F.lit(1)) <= 1)


def is_multi() -> Column:
    """More than one reported place; a missing tag means one."""
    return F.coalesce(F.col("nh"), F.lit(1)) > 1


def strand_matches(protocol: str, gene_strand: Column, paired: bool) -> Column:
    """A read's strand fits the gene's under the protocol; a gene without strand always fits."""
    if protocol == "unstranded":
        return F.lit(True)
    plus = clear(REVERSE)
    if paired:
        plus = F.when(has(READ1), plus).otherwise(~plus)
    same = F.when(gene_strand == "+", plus).when(gene_strand == "-", ~plus)
    return (gene_strand == ".") | (same if protocol == "forward" else ~same)


def gene_body_strand_matches(protocol: str, gene_strand: Column) -> Column:
    """The gene-body rule: single-end reads count as first of pair, a gene without strand never fits."""
    if protocol == "unstranded":
        return F.lit(True)
    first = clear(PAIRED) | has(READ1)
    plus = clear(REVERSE)
    flipped = ~plus
    strand_plus = F.when(first, flipped).otherwise(plus) if protocol == "reverse" else F.when(first, plus).otherwise(flipped)
    return F.when(gene_strand == "+", strand_plus).when(gene_strand == "-", ~strand_plus).otherwise(F.lit(False))
