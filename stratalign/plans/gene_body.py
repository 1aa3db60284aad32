"""Gene-body analysis: what fragments are assigned to, strand votes, junctions.

A fragment is a read of its own, or both mates of a proper pair; a proper pair of which
just one mate is left takes no part.  Blocks have frag, proper, rid, flag, chrom, s, e;
exons are merged within each gene: gene_id, strand, chrom, s, e.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratalign.functions import cigar as cg
from stratalign.functions.flags import PAIRED, PROPER_PAIR, QC_FAIL, READ1, READ2, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED, clear, gene_body_strand_matches, has, is_multi
from stratalign.operators.intervals import overlap_candidates, overlap_join, tolerance_flag


def alignment_counters(reads: DataFrame) -> DataFrame:
    """The counts of each stage of the filter, in one pass: unmapped reads, multimappers among all mapped ones,
    secondary and primary alignments, ends of primary pairs, and what is left after supplementary and failed reads."""
    mapped, primary = clear(UNMAPPED), clear(UNMAPPED | SECONDARY)
    each = {
        "not_aligned": has(UNMAPPED),
        "non_unique": mapped & is_multi(),
        "secondary": mapped & has(SECONDARY),
        "primary": primary,
        "left": primary & has(PAIRED) & has(READ1),
        "right": primary & has(PAIRED) & has(READ2),
        "proper": primary & has(PAIRED) & has(PROPER_PAIR),
        "reads": primary & clear(SUPPLEMENTARY | QC_FAIL),
    }
    return reads.agg(*[F.count_if(c).alias(n) for n, c in each.items()])


def fragment_key(reads: DataFrame) -> DataFrame:
    """Adds proper, and frag: alike for the mates of a proper pair, by name and both places in order, and else the read's
    own."""
    own, mate = F.struct("tid", "pos"), F.struct(F.col("mtid").alias("tid"), F.col("mpos").alias("pos"))
    proper = has(PAIRED) & has(PROPER_PAIR)
    pair = F.concat_ws("|", F.lit("pair"), "qname", F.to_json(F.least(own, mate)), F.to_json(F.greatest(own, mate)))
    return reads.withColumn("proper", proper).withColumn("frag", F.when(proper, pair).otherwise(F.concat(F.lit("read|"), F.col("rid").cast("string"))))


def whole_fragments(blocks: DataFrame) -> DataFrame:
    """frag, blocks, reads, without proper pairs of which one mate is missing."""
    counted = blocks.groupBy("frag", "proper").agg(F.count("*").alias("blocks"), F.count_distinct("rid").alias("reads"))
    return counted.filter(~F.col("proper") | (F.col("reads") == 2)).select("frag", "blocks", "reads")


def block_genes(blocks: DataFrame, exons: DataFrame) -> DataFrame:
    """frag, rid, flag, s, gene_id, strand, enclosed, crossed for every block and every gene that it meets (null for
    none): one of the gene's exons encloses the block, or one shares bases and does not."""
    met = overlap_candidates(blocks.select("frag", "rid", "flag", "chrom", "s", "e"), exons.select("gene_id", "strand", "chrom", "s", "e"), ["chrom"])
    inside = F.col("met") & (F.col("r_s") <= F.col("s")) & (F.col("e") <= F.col("r_e"))
    gene, strand = (F.when(F.col("met"), F.col(c)) for c in ("r_gene_id", "r_strand"))
    return met.groupBy("frag", "rid", "flag", "s", gene.alias("gene_id"), strand.alias("strand")).agg(F.max(inside).alias("enclosed"), F.max(F.col("met") & ~inside).alias("crossed"))


def assign(blocks: DataFrame, exons: DataFrame, introns: DataFrame, protocol: str = "unstranded") -> DataFrame:
    """frag, reads, origin, crossed.  The genes that enclose every block of the fragment, of both mates, on a fitting
    strand: one makes it exonic, several ambiguous; without any it is intronic if a block touches an intron,
    and else intergenic.  crossed: a block shares bases with an exon that does not enclose it."""
    each = block_genes(blocks, exons)
    fits = F.col("enclosed") & gene_body_strand_matches(protocol, F.col("strand"))
    by_gene = each.groupBy("frag", "gene_id").agg(F.count_if(fits).alias("inside"), F.max("crossed").alias("crossed"))
    whole = whole_fragments(blocks)
    counted = by_gene.join(whole, "frag").groupBy("frag", "reads").agg(F.count_if(F.col("inside") == F.col("blocks")).alias("genes"), F.max("crossed").alias("crossed"))
    touched = overlap_join(blocks.select("frag", "chrom", "s", "e"), introns.select("chrom", "s", "e"), ["chrom"], closed=True, how="left_semi", row=["frag", "s"]).select("frag").distinct().withColumn("intron", F.lit(True))
    origin = F.when(F.col("genes") == 1, "exonic").when(F.col("genes") > 1, "ambiguous").when(F.col("intron"), "intronic").otherwise("intergenic")
    return counted.join(touched, "frag", "left").select("frag", "reads", origin.alias("origin"), "crossed")


def origins(fragments: DataFrame) -> DataFrame:
    """Reads by origin, those without a gene, and fragments that cross an exon's edge, in one row."""
    reads = lambda c: F.coalesce(F.sum(F.when(c, F.col("reads"))), F.lit(0)).alias
    kinds = [reads(F.col("origin") == k)(k) for k in ("exonic", "ambiguous", "intronic", "intergenic")]
    return fragments.agg(*kinds, reads(F.col("origin").isin("intronic", "intergenic"))("no_feature"), F.count_if("crossed").alias("overlapping_exon"))


def strand_votes(blocks: DataFrame, exons: DataFrame) -> DataFrame:
    """forward and reverse votes: each block of a whole fragment votes once for each gene that encloses it."""
    each = block_genes(blocks, exons).filter("enclosed").join(whole_fragments(blocks).select("frag"), "frag", "left_semi")
    same = has(REVERSE) == (F.col("strand") == "-")
    first = clear(PAIRED) | has(READ1)
    known = F.col("strand").isin("+", "-")
    agrees = F.when(known, same).otherwise(F.lit(False)) == first
    return each.agg(F.count_if(agrees).alias("forward"), F.count_if(~agrees).alias("reverse"))


def junctions(reads: DataFrame) -> DataFrame:
    """tid or chrom columns stay; first and last 1-based positions of each intron as the analysis has them (counted in
    read bases from the start), and the four bases around it (null where fewer than three bases come before)."""
    found = reads.withColumn("x", F.explode(cg.junction_sites(F.col("ops"), F.col("pos"))))
    at = F.col("x.seq_pos")
    first = F.col("pos") + 1 + at
    bases = lambda start: F.substring("seq", start.cast("int"), F.lit(2))
    enough = (at > 2) & (at + 1 < F.length("seq"))
    motif = F.when(enough, F.concat_ws("/", bases(at - 1), bases(at + 1)))
    return found.withColumns({"first": first, "last": first + F.col("x.e") - F.col("x.s"), "motif": motif}).drop("x")


def junction_events(found: DataFrame, known: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """known, partly and novel events: both ends, one, or none within reach of a known position (keys, p)."""
    listed = known.select(*keys, "p").distinct()
    marked = found
    for end in ("first", "last"):
        marked = tolerance_flag(marked, listed.withColumnRenamed("p", end), keys, end, reach, f"near_{end}")
    n = F.col("near_first").cast("int") + F.col("near_last").cast("int")
    return marked.agg(F.count("*").alias("events"), F.count_if(n == 2).alias("known"), F.count_if(n == 1).alias("partly"), F.count_if(n == 0).alias("novel"))


def motif_shares(found: DataFrame, most: int = 11) -> DataFrame:
    """The commonest motifs with their percentage of all events."""
    total = found.agg(F.count("*").alias("n")).first()["n"]
    counted = found.filter("motif is not null").groupBy("motif").agg(F.count("*").alias("events"))
    return counted.withColumn("percent", F.col("events") * 100.0 / F.lit(max(1, total))).orderBy(F.col("events").desc(), "motif").limit(most)


def known_positions(introns: DataFrame, keys: list[str]) -> DataFrame:
    """1-based last base before and first base after each intron."""
    ends: Column = F.explode(F.array(F.col("s").cast("long"), F.col("e").cast("long") + 1))
    return introns.select(*keys, ends.alias("p")).distinct()
