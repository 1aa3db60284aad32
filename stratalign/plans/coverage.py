"""Reads against annotation: regions, strands, junctions, coverage by transcript."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from stratalign.functions.flags import PAIRED, READ1, REVERSE, clear, has
from stratalign.operators.intervals import containment_join, depth_segments, overlap_candidates, overlap_join, stab_join


def region_tags(tags: DataFrame, regions: DataFrame, order: Sequence[str], keys: Sequence[str], otherwise: str, row: Sequence[str]) -> DataFrame:
    """region -> tags whose point p lies strictly within a region's interval; the first region in order counts.  ``row``
    has the columns that tell tags apart."""
    names = F.array(*map(F.lit, order))
    # A strict stab of p is an overlap of [p, p + 1) with the open interval.
    points = tags.select(*dict.fromkeys([*row, *keys]), F.col("p").alias("s"), (F.col("p") + 1).alias("e"))
    inner = regions.select(*keys, "region", (F.col("s") + 1).alias("s"), "e").filter("s < e")
    met = overlap_candidates(points, inner, keys)
    place = F.when(F.col("met"), F.array_position(names, F.col("r_region")))
    first = met.groupBy(*row).agg(F.min(place).cast("int").alias("__best"))
    return first.groupBy(F.coalesce(F.try_element_at(names, F.col("__best")), F.lit(otherwise)).alias("region")).agg(F.count("*").alias("tags"))


def strand_classes(spans: DataFrame, transcripts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """key -> reads: end of the pair (none for single-end), mapped strand, and the strands of all transcripts met."""
    met = overlap_join(spans, transcripts.select(*keys, "s", "e", "strand"), keys)
    strands = met.groupBy("rid", "flag").agg(F.array_join(F.array_sort(F.collect_set("r_strand")), ":").alias("strands"))
    end = F.when(clear(PAIRED), "").when(has(READ1), "1").otherwise("2")
    key = F.concat(end, F.when(has(REVERSE), "-").otherwise("+"), F.col("strands"))
    return strands.groupBy(key.alias("key")).agg(F.count("*").alias("reads"))


def strandedness_verdict(classes: DataFrame, cut: float = 0.75) -> DataFrame:
    """Shares of both layouts and of neither, and what they say."""
    n = F.col("reads")
    sense = F.col("key").isin("1++", "1--", "2+-", "2-+", "++", "--")
    anti = F.col("key").isin("1+-", "1-+", "2++", "2--", "+-", "-+")
    shares = classes.agg(*[(F.coalesce(F.sum(F.when(c, n)), F.lit(0)) / F.sum(n)).alias(name) for name, c in (("sense", sense), ("antisense", anti), ("failed", ~sense & ~anti))])
    return shares.withColumn("verdict", F.when(F.col("sense") > cut, "forward").when(F.col("antisense") > cut, "reverse").otherwise("unstranded"))


def strandedness_suggestion(shares, protocol: str) -> str | None:
    """What the reads say where it is something else than the given protocol; shares is a row of the verdict."""
    if shares["verdict"] is None or shares["sense"] + shares["antisense"] + shares["failed"] == 0:
        return None
    return None if shares["verdict"] == protocol else shares["verdict"]


def enclosing_genes(blocks: DataFrame, exons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rid, gene_id: genes one of whose exons encloses each block of the read (relational division by count)."""
    met = containment_join(blocks.select("rid", *keys, "s", "e"), exons.select(*keys, "s", "e", "gene_id"), keys).filter("enclosed")
    inside = met.groupBy("rid", F.col("r_gene_id").alias("gene_id")).agg(F.count_distinct("s").alias("inside"))
    every = blocks.groupBy("rid").agg(F.count("*").alias("blocks"))
    return inside.join(every, "rid").filter("inside = blocks").select("rid", "gene_id")


def read_origin(blocks: DataFrame, exons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """origin -> reads: all met blocks lie within exons, some only overlap them, or none is met."""
    met = containment_join(blocks.select("rid", *keys, "s", "e"), exons.select(*keys, "s", "e"), keys)
    by_block = met.groupBy("rid", "s").agg(F.max(F.col("enclosed").cast("int")).alias("inside"))
    by_read = by_block.groupBy("rid").agg(F.min("inside").alias("inside"))
    origin = F.when(F.col("inside") == 1, "exonic").when(F.col("inside") == 0, "overlapping").otherwise("intergenic")
    return blocks.select("rid").distinct().join(by_read, "rid", "left").groupBy(origin.alias("origin")).agg(F.count("*").alias("reads"))


def classify_junctions(junctions: DataFrame, starts: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds class: both intron ends are annotated, one of them is, or none."""
    keys = list(keys)
    flag = lambda df, c, name: df.select(*keys, c).distinct().withColumn(name, F.lit(1))
    known = junctions.join(flag(starts, "s", "__ks"), [*keys, "s"], "left").join(flag(ends, "e", "__ke"), [*keys, "e"], "left")
    n = F.coalesce("__ks", F.lit(0)) + F.coalesce("__ke", F.lit(0))
    return known.withColumn("class", F.when(n == 2, "annotated").when(n == 1, "partial_novel").otherwise("complete_novel")).drop("__ks", "__ke")


def mark_known(events: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds known: the event's keys are among those of the annotation."""
    listed = known.select(*keys).distinct().withColumn("known", F.lit(True))
    return events.join(listed, list(keys), "left").withColumn("known", F.coalesce("known", F.lit(False)))


def distinct_starts(starts: DataFrame, spans: DataFrame, keys: Sequence[str], tx: str) -> DataFrame:
    """tx -> how many distinct positions p of reads' starts lie within the transcript."""
    met = stab_join(starts.select(*keys, "p").distinct(), spans, keys)
    return met.groupBy(F.col(f"r_{tx}").alias(tx)).agg(F.count_distinct("p").alias("starts"))


def introns(exons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps between consecutive exons of a transcript."""
    before = F.lag("e").over(Window.partitionBy(*keys).orderBy("s", "e"))
    return exons.select(*keys, before.alias("__e"), F.col("s").alias("e")).filter(F.col("__e") < F.col("e")).select(*keys, F.col("__e").alias("s"), "e")


def sampling_grid(transcripts: DataFrame, step: int, most: int) -> DataFrame:
    """slot and position p at every step of a transcript."""
    slots = F.sequence(F.lit(0), F.least(F.lit(most - 1), F.expr(f"cast((e - s - 1) div {step} as int)")))
    return transcripts.filter("e > s").withColumn("slot", F.explode(slots)).withColumn("p", F.col("s") + F.col("slot") * step)


def exonic_grid(exons, n: int):
    """The integrity grid of a transcript's sorted exon pairs as an array expression of 1-based positions: all
    bases and both boundary positions of short transcripts, else evenly spaced bases with exon boundaries."""
    all_bases = F.flatten(F.transform(exons, lambda x: F.sequence(x["s"] + 1, x["e"])))
    length = F.size(all_bases)
    ends = F.flatten(F.transform(exons, lambda x: F.array(x["s"] + 1, x["e"])))
    stride = F.expr("1") * F.greatest(F.floor(length / n), F.lit(1))
    picked = F.transform(F.sequence(F.lit(0), length - 1, stride.cast("int")), lambda k: F.element_at(all_bases, (k + 1).cast("int")))
    return F.when(length <= n, F.array_sort(F.concat(all_bases, F.array(F.array_min(ends), F.array_max(ends))))).otherwise(F.array_sort(F.array_distinct(F.concat(picked, ends))))


def slot_depth(grid: DataFrame, blocks: DataFrame, keys: Sequence[str], tx: str, block_bases: int = 128) -> DataFrame:
    """tx, slot -> blocks over the slot's position, slots without any included."""
    # Blocks are far more than slots: the bins are of their size, about that of a short read, and not measured.
    met = stab_join(grid, blocks, keys, size=block_bases).groupBy(tx, "slot").agg(F.count("*").alias("depth"))
    return grid.select(tx, "slot").join(met, [tx, "slot"], "left").select(tx, "slot", F.coalesce("depth", F.lit(0)).alias("depth"))


def integrity(slots: DataFrame, tx: str, sizes: DataFrame | None = None) -> DataFrame:
    """tin: 100 times the exponential of the coverage's entropy over the number of slots; 0 without coverage.  ``sizes``
    (tx, slots) has the numbers where they differ from those of the rows: a position that stands in a grid
    twice counts once in the coverage and twice in the number."""
    depth = F.col("depth").cast("double")
    sums = slots.groupBy(tx).agg(F.count("*").alias("rows"), F.sum("depth").alias("total"), F.sum(F.when(depth > 0, depth * F.log(depth)).otherwise(0.0)).alias("ent"))
    sums = sums.withColumn("slots", F.col("rows")) if sizes is None else sums.join(sizes, tx)
    tin = F.when(F.col("total") > 0, 100 * F.exp(F.log("total") - F.col("ent") / F.col("total")) / F.col("slots")).otherwise(0.0)
    return sums.select(tx, tin.alias("tin"))


def transcript_depth(blocks: DataFrame, transcripts: DataFrame, keys: Sequence[str], tx: str) -> DataFrame:
    """tx, s, e, depth: segments of constant depth in transcript offsets."""
    met = overlap_join(blocks, transcripts, keys)
    inside = met.select(F.col(f"r_{tx}").alias(tx), (F.greatest("s", "r_s") - F.col("r_s")).alias("s"), (F.least("e", "r_e") - F.col("r_s")).alias("e"))
    return depth_segments(inside, [tx])


def mean_coverage(depth: DataFrame, transcripts: DataFrame, tx: str) -> DataFrame:
    covered = depth.groupBy(tx).agg(F.sum(F.col("depth") * (F.col("e") - F.col("s"))).alias("covered"))
    return transcripts.join(covered, tx, "left").select(tx, "length", (F.coalesce("covered", F.lit(0)).cast("double") / F.col("length")).alias("mean"))


def _parts(depth: DataFrame, cut) -> DataFrame:
    """Segments cut at multiples of cut, with the bin of each part: no row per base."""
    bins = F.explode(F.sequence(F.floor(F.col("s") / cut), F.floor((F.col("e") - 1) / cut)))
    parts = depth.withColumn("bin", bins)
    return parts.withColumn("bases", F.least(F.col("e"), (F.col("bin") + 1) * cut) - F.greatest(F.col("s"), F.col("bin") * cut))


def coverage_profile(depth: DataFrame, lengths: DataFrame, tx: str, bins: int = 100) -> DataFrame:
    """bin -> summed depth, each transcript cut into bins of ceil(length / bins) bases."""
    sized = depth.join(lengths.select(tx, F.expr(f"(length + {bins - 1}) div {bins}").alias("__cut")), tx)
    return _parts(sized, F.col("__cut")).groupBy("bin").agg(F.sum(F.col("depth") * F.col("bases")).cast("long").alias("depth"))


def prime_bias(depth: DataFrame, means: DataFrame, tx: str, reach: int) -> DataFrame:
    """tx -> mean depth of the first and last bases over the whole mean."""
    joined = depth.join(means, tx)
    first = F.greatest(F.least(F.col("e"), F.lit(reach)) - F.col("s"), F.lit(0))
    last = F.greatest(F.col("e") - F.greatest(F.col("s"), F.col("length") - reach), F.lit(0))
    each = joined.groupBy(tx, "mean").agg(F.sum(F.col("depth") * first).alias("five"), F.sum(F.col("depth") * last).alias("three"))
    return each.select(tx, *[(F.col(c).cast("double") / reach / F.col("mean")).alias(c) for c in ("five", "three")])
