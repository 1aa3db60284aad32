"""The analyses of one alignment file: a function of (alignments, annotation, parameters) each.

Nothing runs until a result is read; an analysis that is not asked for costs
nothing.  Alignments are held once (``persist``), since text and BAM scans prune
no columns; annotation is small beside them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.storagelevel import StorageLevel

from stratalign.functions import cigar as cg, flags as fl
from stratalign.functions.numeric import logistic_fit
from stratalign.operators import intervals as iv, sequences as sq
from stratalign.plans import complexity, counting as ct, coverage as cv, gene_body as gb, pairs as pr, statistics as st
from stratalign.sources import bam, gtf, sam
from stratalign.sources.probe import GZIP, first_bytes


@dataclass
class Params:
    """Options of a run; names follow the command line."""

    paired: bool = False
    protocol: str = "unstranded"
    mapq: int = 30
    min_intron: int = 50
    biotype: str = "gene_biotype"
    skip_dup_check: bool = False
    inner_low: int = -250
    inner_high: int = 250
    inner_step: int = 5
    inner_sample: int = 1_000_000
    tin_samples: int = 100
    tin_min_coverage: int = 10
    saturation_step: int = 5
    saturation_seed: int = 42
    complexity_step: float = 1e6
    complexity_max: float = 1e10
    complexity_bootstraps: int = 100
    complexity_seed: int = 408
    complexity_max_segment: int = 100_000_000
    chromosome_map: dict[str, str] = field(default_factory=dict)
    chromosome_prefix: str = ""


class QcSession:
    def __init__(self, spark: SparkSession, alignments: str, annotation: str, params: Params | None = None):
        self.spark, self.path, self.gtf_path, self.params = spark, alignments, annotation, params or Params()

    # -- inputs

    @cached_property
    def header(self) -> DataFrame:
        with_bam = first_bytes(self.spark, self.path, 2) == GZIP
        return bam.bam_header(self.spark, self.path) if with_bam else sam.read_header(self.spark, self.path)

    @cached_property
    def reads(self) -> DataFrame:
        p = self.params
        rows = sam.with_lengths(sam.read_alignments(self.spark, self.path))
        if p.chromosome_map or p.chromosome_prefix:
            rows = st.map_names(rows, p.chromosome_map, p.chromosome_prefix, "chrom").withColumn("chrom_u", F.upper("chrom"))
        rows = rows.withColumn("rid", F.concat_ws(":", "file_order.file", "file_order.start", "file_order.row"))
        return rows.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def biotype(self) -> str | None:
        return gtf.biotype_attribute(self.spark, self.gtf_path, self.params.biotype)

    @cached_property
    def features(self) -> DataFrame:
        return gtf.read_gtf(self.spark, self.gtf_path, [self.biotype] if self.biotype else []).persist()

    @cached_property
    def genes(self) -> DataFrame:
        genes = gtf.genes(self.features, [self.biotype] if self.biotype else [])
        return genes.withColumn("biotype", F.col(self.biotype) if self.biotype else F.lit(None).cast("string")).persist()

    @cached_property
    def exons(self) -> DataFrame:
        """Exons with their gene's strand."""
        return self.features.filter("feature = 'exon'").select("gene_id", "tx_id", "chrom", "s", "e").join(self.genes.select("gene_id", "strand", "biotype"), "gene_id")

    @cached_property
    def transcripts(self) -> DataFrame:
        return gtf.transcripts(self.features).withColumn("chrom", F.upper("chrom")).persist()

    def blocks(self, reads: DataFrame, walk: cg.Walk | None = None, upper: bool = False, more: Sequence[str] = (), outer: bool = False) -> DataFrame:
        """rid, flag, nh, chrom, s, e of each aligned block, and more; where outer, a read without any has one row."""
        array = F.col("blocks") if walk is None else cg.blocks(F.col("ops"), F.col("pos"), walk)
        return reads.select("rid", "flag", "nh", F.col("chrom_u" if upper else "chrom").alias("chrom"), (F.explode_outer if outer else F.explode)(array).alias("x"), *more).select("*", "x.s", "x.e").drop("x")

    # -- counting and duplication

    @cached_property
    def fragments(self) -> DataFrame:
        """rid, flag, nh, genes of each counted fragment; mates are joined by their key and vote."""
        p = self.params
        kept = self.reads.filter(fl.counting(p.paired))
        mates = ["qname", "tid", "pos", "mtid", "mpos", "hi", "file_order"] if p.paired else []
        hits = ct.gene_hits(self.blocks(kept, more=mates, outer=True), self.exons, ["rid", "flag", "nh", *mates], p.protocol, p.paired)
        if not p.paired:
            return hits.persist()
        own, other = F.struct("tid", "pos"), F.struct(F.col("mtid").alias("tid"), F.col("mpos").alias("pos"))
        first = F.when(fl.has(fl.READ1), own).otherwise(other)
        second = F.when(fl.has(fl.READ1), other).otherwise(own)
        keyed = hits.groupBy("qname", first.alias("one"), second.alias("two"), F.coalesce("hi", F.lit(-1)).alias("hit"))
        side = lambda c, which: F.max_by(F.when(which, F.col(c)), F.when(which, F.col("file_order")))
        r1, r2 = fl.has(fl.READ1), fl.clear(fl.READ1)
        sides = keyed.agg(F.min("rid").alias("rid"), side("genes", r1).alias("g1"), side("genes", r2).alias("g2"), F.max(F.when(fl.has(fl.DUPLICATE), 1).otherwise(0)).alias("dup"), F.max("nh").alias("nh"))
        empty = F.array().cast("array<string>")
        genes = F.when(F.col("g1").isNull() | F.col("g2").isNull(), F.coalesce("g1", "g2", empty)).otherwise(ct.vote("g1", "g2"))
        voted = sides.select("rid", (F.col("dup") * fl.DUPLICATE).alias("flag"), "nh", genes.alias("genes"))
        return voted.withColumns({"n": F.size("genes"), "gene_id": F.try_element_at("genes", F.lit(1))}).persist()

    @cached_property
    def total_fragments(self) -> int:
        lone = self.reads.filter(fl.has(fl.UNMAPPED) & fl.clear(fl.MATE_UNMAPPED) & fl.has(fl.PAIRED)).count() if self.params.paired else 0
        return self.fragments.count() + lone

    def validate(self) -> None:
        check = st.duplicate_check(self.reads).first()
        if check["fails"] and not self.params.skip_dup_check:
            raise ValueError("no read is marked as a duplicate: mark duplicates first, or skip this check")
        if check["mapped"] and self.fragments.filter("n > 0").isEmpty():
            raise ValueError("no read meets a gene: do the chromosome names of alignments and annotation agree?")

    def dup_matrix(self) -> DataFrame:
        genes = self.genes.select("gene_id", "length", "gene_ord")
        matrix = ct.dup_matrix(ct.gene_counts(self.fragments), genes, F.lit(float(self.total_fragments)))
        return matrix.join(genes.select("gene_id", "gene_ord"), "gene_id").orderBy("gene_ord").drop("gene_ord")

    def counting_summary(self) -> dict[str, float]:
        """Reads, fragments by what they were assigned to, and shares, for the run's summary."""
        reads = self.reads.agg(F.count("*").alias("total_reads"), F.count_if(fl.clear(fl.UNMAPPED)).alias("mapped_reads")).first().asDict()
        n = F.col("n")
        each = {"assigned": n == 1, "no_features": n == 0, "ambiguous": n > 1, "duplicates": fl.has(fl.DUPLICATE), "multimappers": fl.is_multi()}
        out = reads | self.fragments.agg(F.count("*").alias("fragments"), *[F.count_if(c).alias(k) for k, c in each.items()]).first().asDict()
        share = lambda k: 100.0 * out[k] / out["fragments"] if out["fragments"] else 0.0
        return out | {"assigned_pct": share("assigned"), "duplicate_pct": share("duplicates")}

    def duplication_summary(self) -> dict[str, int]:
        rate = F.col("dup_rate")
        return self.dup_matrix().agg(F.count("*").alias("total_genes"), F.count_if(F.col("all_unique") > 0).alias("genes_with_reads"), F.count_if((rate > 0) | F.isnan(rate)).alias("genes_with_duplication")).first().asDict()

    def fit(self) -> tuple[float, float]:
        """Intercept and slope as they are reported: exponentials of the coefficients."""
        intercept, slope = logistic_fit(self.dup_matrix())
        return math.exp(intercept), math.exp(slope)

    @cached_property
    def read_hits(self) -> DataFrame:
        kept = self.reads.filter(fl.counting(self.params.paired))
        return ct.gene_hits(self.blocks(kept, outer=True), self.exons, ["rid", "flag", "nh"], self.params.protocol, self.params.paired)

    def read_counts(self) -> DataFrame:
        counts = ct.read_status(self.read_hits).filter("status = 'assigned'").groupBy("gene_id").agg(F.count("*").alias("reads"))
        return self.genes.join(counts, "gene_id", "left").select("gene_ord", "gene_id", "exons", "strand", "length", F.coalesce("reads", F.lit(0)).alias("reads")).orderBy("gene_ord")

    def read_summary(self) -> DataFrame:
        status = ct.read_status(self.read_hits).groupBy("status").agg(F.count("*").alias("reads"))
        unmapped = self.reads.filter(fl.has(fl.UNMAPPED)).agg(F.lit("unmapped").alias("status"), F.count("*").alias("reads"))
        return status.unionByName(unmapped)

    def biotype_counts(self) -> DataFrame:
        """Every biotype of the annotation, those without reads included."""
        known = ct.biotype_status(self.read_hits, self.genes).filter("status = 'assigned' and size(biotypes) = 1")
        counts = known.groupBy(F.col("biotypes")[0].alias("biotype")).agg(F.count("*").alias("reads"))
        every = self.genes.select("biotype").filter("biotype is not null").distinct()
        return every.join(counts, "biotype", "left").select("biotype", F.coalesce("reads", F.lit(0)).alias("reads")).orderBy(F.col("reads").desc(), "biotype")

    def biotype_summary(self) -> DataFrame:
        """status -> reads, where reads of several genes of one biotype are assigned."""
        unique = ct.biotype_status(self.read_hits, self.genes).groupBy("status").agg(F.count("*").alias("reads"))
        return unique.unionByName(self.read_summary().filter("status in ('multimapping', 'unmapped')"))

    # -- statistics

    def bam_stat(self) -> DataFrame:
        return st.bam_stat(self.reads, self.params.mapq)

    def flagstat(self) -> DataFrame:
        return st.flagstat(self.reads)

    def idxstats(self) -> DataFrame:
        return st.idxstats(self.reads, self.header).orderBy(F.col("tid").asc_nulls_last())

    def length_sums(self) -> DataFrame:
        return st.length_sums(self.reads)

    def checksums(self) -> DataFrame:
        return st.checksums(self.reads)

    def depth_histogram(self) -> DataFrame:
        return iv.depth_histogram(self.blocks(self.reads.filter(fl.clear(fl.UNMAPPED | fl.SECONDARY))), ["chrom"]).orderBy("depth")

    def mapq_histogram(self) -> DataFrame:
        return st.histogram(self.reads.filter(fl.clear(fl.SECONDARY | fl.SUPPLEMENTARY | fl.UNMAPPED | fl.QC_FAIL | fl.DUPLICATE)), "mapq")

    def cycle_matrices(self) -> DataFrame:
        return st.cycle_matrices(self.reads)

    def indels(self) -> DataFrame:
        return st.indel_histogram(self.reads.filter(fl.clear(fl.UNMAPPED | fl.SECONDARY)))

    def indel_cycles(self) -> DataFrame:
        return st.indel_cycles(self.reads.filter(fl.clear(fl.UNMAPPED | fl.SECONDARY)))

    def report_counters(self) -> DataFrame:
        return st.report_counters(self.reads)

    def template_sizes(self) -> DataFrame:
        return st.template_sizes(self.reads)

    def read_lengths(self) -> DataFrame:
        """len -> primary reads, and those of first and last fragments."""
        last = fl.has(fl.PAIRED) & fl.has(fl.READ2)
        return self.reads.filter(fl.primary()).groupBy("len").agg(F.count("*").alias("reads"), F.count_if(~last).alias("first"), F.count_if(last).alias("last"))

    def gc_steps(self, last: bool = False) -> DataFrame:
        """bin -> reads where the step function over 200 bins changes, of first or last fragments."""
        which = (fl.has(fl.PAIRED) & fl.has(fl.READ2)) == F.lit(last)
        kept = self.reads.filter(fl.primary() & which & F.col("seq").isNotNull())
        gc = F.length(F.regexp_replace("seq", "[^GC]", ""))
        return sq.changes(sq.step_histogram(kept.select(gc.alias("gc"), F.length("seq").alias("n")), "gc", "n", 199), "bin", "reads")

    def gc_depth(self, span: int = 20_000) -> DataFrame:
        """Bins opened where a read starts more than span after the bin's first read: tid, start, depth, gc (the sum of the
        reads' shares).  A gap of more than span between reads always opens one, so runs of reads without such
        a gap are independent of one another and are what a task gets."""
        kept = self.reads.filter(fl.clear(fl.UNMAPPED | fl.SECONDARY) & F.col("seq").isNotNull()).select("tid", "pos", F.length("seq").alias("n"), F.length(F.regexp_replace("seq", "[^GC]", "")).alias("gc"))
        places = kept.groupBy("tid", "pos").agg(F.count("*").alias("depth"), F.sum(F.col("gc").cast("double") / F.col("n")).alias("gc"))
        before = F.lag("pos").over(Window.partitionBy("tid").orderBy("pos"))
        runs = places.withColumn("opens", F.when(before.isNull() | (F.col("pos") - before > span), F.col("pos")))
        runs = runs.withColumn("run", F.last("opens", ignorenulls=True).over(Window.partitionBy("tid").orderBy("pos")))

        def bins(pdf):
            import numpy as np
            import pandas as pd

            pdf = pdf.sort_values("pos")
            pos, at, cuts = pdf["pos"].to_numpy(), 0, []
            while at < len(pos):
                cuts.append(at)
                at = int(np.searchsorted(pos, pos[at] + span, "right"))
            return pd.DataFrame({"tid": pdf["tid"].to_numpy()[cuts], "start": pos[cuts], "depth": np.add.reduceat(pdf["depth"].to_numpy(), cuts), "gc": np.add.reduceat(pdf["gc"].to_numpy(), cuts)})

        return runs.select("tid", "run", "pos", "depth", "gc").groupBy("tid", "run").applyInPandas(bins, "tid int, start long, depth long, gc double")

    def strandedness(self) -> DataFrame:
        kept = self.reads.filter(fl.usable(self.params.mapq)).withColumn("end", F.col("pos") + cg.query_aligned_length(F.col("ops")) + cg.intron_bases(F.col("ops")))
        spans = kept.select("rid", "flag", F.upper("chrom").alias("chrom"), F.col("pos").alias("s"), F.col("end").alias("e"))
        return cv.strand_classes(spans, self.transcripts, ["chrom"])

    def layout(self) -> str:
        """PairEnd or SingleEnd where all reads with a verdict are of one kind, else Unknown."""
        paired = F.col("key").startswith("1") | F.col("key").startswith("2")
        row = self.strandedness().agg(F.count_if(paired).alias("pairs"), F.count_if(~paired).alias("single")).first()
        return "Unknown" if bool(row["pairs"]) == bool(row["single"]) else "PairEnd" if row["pairs"] else "SingleEnd"

    def position_duplication(self) -> DataFrame:
        keyed = self.reads.filter(fl.duplication_reads(self.params.mapq)).withColumn("key", cg.blocks(F.col("ops"), F.col("pos"), cg.POSITION_KEY))
        return sq.count_of_counts(keyed, ["chrom", "pos", "key"], "positions").orderBy("times")

    def sequence_duplication(self) -> DataFrame:
        return sq.count_of_counts(self.reads.filter(fl.duplication_reads(self.params.mapq)), ["seq"], "sequences").orderBy("times")

    # -- features and junctions

    @cached_property
    def regions(self) -> DataFrame:
        """region, chrom, s, e: coding, untranslated, intron and flanking regions, each without those before it."""
        t = self.transcripts
        exon = t.select("chrom", "strand", F.coalesce("cds_start", "s").alias("cs"), F.coalesce("cds_end", "e").alias("ce"), F.explode("exons").alias("x")).select("chrom", "strand", "cs", "ce", "x.s", "x.e")
        clip = lambda low, high: exon.select("chrom", "strand", F.greatest("s", low).alias("s"), F.least("e", high).alias("e")).filter("s < e")
        far = F.lit(1 << 60)
        before, after = clip(F.lit(0), F.col("cs")), clip(F.col("ce"), far)
        five = before.filter("strand = '+'").unionByName(after.filter("strand = '-'"))
        three = after.filter("strand = '+'").unionByName(before.filter("strand = '-'"))
        m = lambda df: iv.merge(df, ["chrom"])
        cds = m(clip(F.col("cs"), F.col("ce")))
        five, three = iv.subtract(m(five), cds), iv.subtract(m(three), cds)
        gaps = t.select("chrom", F.explode(F.zip_with("exons", F.slice("exons", 2, F.greatest(F.size("exons") - 1, F.lit(1))), lambda a, b: F.struct(a["e"].alias("s"), b["s"].alias("e")))).alias("x")).select("chrom", "x.s", "x.e").filter("s is not null and e is not null and s < e")
        taken = cds.unionByName(five).unionByName(three)
        out = {"CDS": cds, "5UTR": five, "3UTR": three, "Intron": iv.subtract(m(gaps), taken)}
        taken = taken.unionByName(out["Intron"])
        for side, plus_end in (("TSS_up", "s"), ("TES_down", "e")):
            for kb in (1, 5, 10):
                reach = F.lit(kb * 1000)
                left = (F.col("strand") == "+") == F.lit(plus_end == "s")
                flank = t.select("chrom", F.when(left, F.greatest(F.col("s") - reach, F.lit(0))).otherwise(F.col("e")).alias("a"), F.when(left, F.col("s")).otherwise(F.col("e") + reach).alias("b"))
                out[f"{side}_{kb}kb"] = iv.subtract(m(flank.select("chrom", F.col("a").alias("s"), F.col("b").alias("e")).filter("s < e")), taken)
        union = None
        for name, df in out.items():
            part = df.select(F.lit(name).alias("region"), "chrom", "s", "e")
            union = part if union is None else union.unionByName(part)
        return union.persist()

    def read_distribution(self) -> DataFrame:
        """region, bases, tags; a tag with both untranslated regions or both flanks is unassigned, wider flanks
        include narrower ones."""
        names = ["CDS", "5UTR", "3UTR", "Intron", *[f"{s}_{k}kb" for s in ("TSS_up", "TES_down") for k in (1, 5, 10)]]
        tags = self.blocks(self.reads.filter(fl.usable()), cg.EXONS, upper=True).select("rid", "chrom", F.expr("s + (e - s) div 2").alias("p"))
        met = iv.stab_join(tags, self.regions, ["chrom"], strict=True).groupBy("rid", "p").agg(F.collect_set("r_region").alias("in"))
        inside = lambda n: F.array_contains("in", n)
        up, down = inside("TSS_up_10kb"), inside("TES_down_10kb")
        first = F.when(inside("CDS"), "CDS").when(inside("5UTR") & inside("3UTR"), "none").when(inside("5UTR"), "5UTR").when(inside("3UTR"), "3UTR").when(inside("Intron"), "Intron").when(up & down, "none").when(up, "TSS_up").when(down, "TES_down").otherwise("none")
        sorted_tags = met.withColumn("first", first)
        counts = sorted_tags.agg(*[F.count_if((F.col("first") == n.rsplit("_", 1)[0]) & inside(n) if "kb" in n else F.col("first") == n).alias(n) for n in names]).unpivot([], names, "region", "tags")
        return self.spark.createDataFrame([(k, n) for k, n in enumerate(names)], "ord int, region string").join(counts, "region").join(iv.bases(self.regions, ["region"]), "region", "left").select("ord", "region", F.coalesce("bases", F.lit(0)).alias("bases"), "tags").orderBy("ord").drop("ord")

    @property
    def introns(self) -> DataFrame:
        kept = self.reads.filter(fl.usable(self.params.mapq))
        introns = kept.select("file_order", "rid", F.col("chrom_u").alias("chrom"), F.explode(cg.blocks(F.col("ops"), F.col("pos"), cg.INTRONS)).alias("x"))
        return introns.select("file_order", "rid", "chrom", "x.s", "x.e")

    @cached_property
    def junction_events(self) -> DataFrame:
        return self.introns.filter(F.col("e") - F.col("s") >= self.params.min_intron).persist()

    def short_introns(self) -> int:
        return self.introns.filter(F.col("e") - F.col("s") < self.params.min_intron).count()

    @cached_property
    def known_introns(self) -> DataFrame:
        exons = self.transcripts.select("tx_id", "chrom", F.explode("exons").alias("x")).select("tx_id", "chrom", "x.s", "x.e")
        return cv.introns(exons, ["tx_id", "chrom"])

    def junctions(self) -> DataFrame:
        found = self.junction_events.groupBy("chrom", "s", "e").agg(F.count("*").alias("reads"), F.min("file_order").alias("first_seen"))
        return cv.classify_junctions(found, self.known_introns.select("chrom", "s"), self.known_introns.select("chrom", "e"), ["chrom"]).orderBy("first_seen")

    def junction_saturation(self) -> DataFrame:
        """pct, known and novel junctions among the first pct percent of the events in a seeded order."""
        p = self.params
        percents = sorted({*range(p.saturation_step, 101, p.saturation_step), 100})
        order = (F.xxhash64("rid", "s", F.lit(p.saturation_seed)), F.col("rid"), F.col("s"))
        events = cv.mark_known(self.junction_events, self.known_introns, ["chrom", "s", "e"])
        numbered = sq.ranked(events, order)
        first = numbered.groupBy("chrom", "s", "e", "known").agg(F.min("rn").alias("first"), F.first("total").alias("total"))
        grid = self.spark.createDataFrame([(x,) for x in percents], "pct int")
        seen = [F.count_if((F.col("first") <= F.expr(f"total * {x} div 100")) & (F.col("known") == k)).alias(f"{n}{x}") for x in percents for n, k in (("k", F.lit(True)), ("n", F.lit(False)))]
        row = first.agg(*seen).first()
        return grid.join(self.spark.createDataFrame([(x, row[f"k{x}"], row[f"n{x}"]) for x in percents], "pct int, known long, novel long"), "pct").orderBy("pct")

    def inner_distance(self) -> DataFrame:
        p = self.params
        kept = self.reads.filter(fl.inner_distance_reads(p.mapq))
        leftmost = (F.col("tid") < F.col("mtid")) | ((F.col("tid") == F.col("mtid")) & ((F.col("mpos") > F.col("pos")) | ((F.col("mpos") == F.col("pos")) & fl.clear(fl.READ1))))
        end = F.col("pos") + cg.query_aligned_length(F.col("ops")) + cg.intron_bases(F.col("ops"))
        rows = kept.filter(leftmost).select("file_order", "rid", "qname", F.col("chrom_u").alias("chrom"), F.upper("mate_chrom").alias("mate_chrom"), end.alias("read1_end"), F.col("mpos").alias("read2_start"), cg.blocks(F.col("ops"), F.col("pos"), cg.EXONS).alias("x"))
        overlap = F.aggregate("x", F.lit(0).cast("long"), lambda acc, b: acc + F.greatest(F.least(b["e"], F.col("read1_end")) - F.greatest(b["s"], F.col("read2_start")), F.lit(0)))
        rows = rows.withColumn("overlap", overlap).drop("x").orderBy("file_order").limit(p.inner_sample)
        # The first transcript of each chromosome takes no part.
        numbered = self.transcripts.withColumn("k", F.row_number().over(Window.partitionBy("chrom").orderBy("row"))).filter("k > 1")
        exons = iv.merge(self.transcripts.select("chrom", F.explode("exons").alias("x")).select("chrom", "x.s", "x.e"), ["chrom"])
        classes = pr.classify(rows, numbered.select("tx_id", "chrom", "s", "e"), exons, "rid")
        return rows.select("file_order", "rid", "qname").join(classes, "rid").orderBy("file_order")

    # -- coverage

    @cached_property
    def tin_slots(self) -> DataFrame:
        grid = self.transcripts.select("tx_id", "chrom", cv.exonic_grid(F.col("exons"), self.params.tin_samples).alias("grid"))
        return grid.select("tx_id", "chrom", F.size("grid").alias("slots"), F.posexplode(F.array_distinct("grid")).alias("slot", "p")).withColumn("p", F.col("p") - 1)

    def tin(self) -> DataFrame:
        """tx_id, tin; zero where no more than the least number of distinct starts lies within the transcript."""
        p = self.params
        kept = self.reads.filter(fl.integrity_reads())
        starts = kept.select(F.col("chrom_u").alias("chrom"), F.col("pos").alias("p"))
        spans = self.transcripts.select("tx_id", "chrom", "s", "e")
        enough = cv.distinct_starts(starts, spans, ["chrom"], "tx_id").filter(F.col("starts") > p.tin_min_coverage)
        blocks = self.blocks(kept.filter(fl.clear(fl.DUPLICATE)), upper=True).select("chrom", "s", "e")
        slots = self.tin_slots.join(enough.select("tx_id"), "tx_id", "left_semi")
        scores = cv.integrity(cv.slot_depth(slots, blocks, ["chrom"], "tx_id"), "tx_id", self.tin_slots.select("tx_id", "slots").distinct())
        return self.transcripts.select("tx_id", "chrom", "s", "e").join(scores, "tx_id", "left").select("tx_id", "chrom", "s", "e", F.coalesce("tin", F.lit(0.0)).alias("tin"), F.col("tin").isNotNull().alias("passed"))

    def tin_summary(self) -> DataFrame:
        """Mean, median and population deviation over transcripts that passed."""
        return self.tin().filter("passed").agg(F.avg("tin").alias("mean"), F.median("tin").alias("median"), F.stddev_pop("tin").alias("sd"))

    @cached_property
    def gene_body_reads(self) -> DataFrame:
        return gb.fragment_key(self.reads.filter(fl.gene_body_reads()))

    @cached_property
    def merged_exons(self) -> DataFrame:
        return iv.merge(self.exons, ["gene_id", "strand", "chrom"]).persist()

    @cached_property
    def gene_body_blocks(self) -> DataFrame:
        """Blocks of whole fragments with frag and proper."""
        blocks = self.gene_body_reads.select("frag", "proper", "rid", "flag", "chrom", F.explode(cg.blocks(F.col("ops"), F.col("pos"), cg.GENE_BODY)).alias("x")).select("*", "x.s", "x.e").drop("x")
        return blocks.join(gb.whole_fragments(blocks).select("frag"), "frag", "left_semi").persist()

    def gene_body_counters(self) -> DataFrame:
        return gb.alignment_counters(self.reads)

    def read_origin(self) -> DataFrame:
        return gb.origins(gb.assign(self.gene_body_blocks, self.merged_exons, self.known_introns_as_named, self.params.protocol))

    def strand_votes(self) -> DataFrame:
        return gb.strand_votes(self.gene_body_blocks, self.merged_exons)

    @cached_property
    def known_introns_as_named(self) -> DataFrame:
        """Introns of all transcripts, under the annotation's own chromosome names."""
        return cv.introns(self.exons.select("tx_id", "chrom", "s", "e").distinct(), ["tx_id", "chrom"])

    @cached_property
    def gene_body_junctions(self) -> DataFrame:
        return gb.junctions(self.gene_body_reads.filter(F.size(cg.blocks(F.col("ops"), F.col("pos"), cg.GENE_BODY)) > 0)).select("chrom", "first", "last", "motif").persist()

    def junction_event_classes(self) -> DataFrame:
        return gb.junction_events(self.gene_body_junctions, gb.known_positions(self.known_introns_as_named, ["chrom"]), ["chrom"])

    def junction_motifs(self) -> DataFrame:
        return gb.motif_shares(self.gene_body_junctions)

    def prime_bias(self) -> DataFrame:
        """five, three, five_three: medians over the best transcript of each gene, of the 1000 with the highest mean."""
        depth = self.transcript_depth()
        lengths = self.exons.select("gene_id", "tx_id", "s", "e").distinct().groupBy("gene_id", "tx_id").agg(F.sum(F.col("e") - F.col("s")).alias("length"))
        means = cv.mean_coverage(depth, lengths, "tx_id").filter("length >= 500 and mean >= 1").join(lengths.select("gene_id", "tx_id"), "tx_id")
        best = means.join(sq.best_per_group(means, ["gene_id"], ["mean", "tx_id"], "tx_id"), ["gene_id", "tx_id"])
        each = cv.prime_bias(depth, sq.top(best.select("tx_id", "mean", "length"), "mean", ["tx_id"], 1000), "tx_id", 100)
        ratio = F.when((F.col("three") != 0) | (F.col("five") != 0), F.when(F.col("three") == 0, F.lit(float("inf"))).otherwise(F.try_divide("five", "three")))
        return each.agg(F.median("five").alias("five"), F.median("three").alias("three"), F.median(ratio).alias("five_three"))

    def transcript_depth(self) -> DataFrame:
        """Depth in exon-concatenated offsets; exons of the minus strand are taken in reverse, and the last base of
        each block does not count.  A block counts for the transcripts of genes that enclose it, on either strand."""
        exons = self.exons.select("gene_id", "tx_id", "chrom", "strand", "s", "e").distinct()
        order = F.when(F.col("strand") == "-", -F.col("s")).otherwise(F.col("s"))
        before = F.coalesce(F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("tx_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = exons.withColumn("before", before)
        enclosed = iv.containment_join(self.gene_body_blocks.select("rid", "chrom", "s", "e"), self.merged_exons, ["chrom"]).filter("enclosed")
        blocks = enclosed.select("rid", F.col("r_gene_id").alias("gene_id"), "chrom", "s", (F.col("e") - 1).alias("e")).filter("s < e")
        met = iv.overlap_join(blocks, placed, ["chrom", "gene_id"])
        inside = met.select(F.col("r_tx_id").alias("tx_id"), (F.greatest("s", "r_s") - F.col("r_s") + F.col("r_before")).alias("s"), (F.least("e", "r_e") - F.col("r_s") + F.col("r_before")).alias("e"))
        return iv.depth_segments(inside, ["tx_id"])

    def coverage_profile(self, tier: str = "total") -> DataFrame:
        """bin -> depth over all transcripts, or the 500 with the highest or lowest mean, of equal means one."""
        depth = self.transcript_depth()
        lengths = self.exons.select("tx_id", "s", "e").distinct().groupBy("tx_id").agg(F.sum(F.col("e") - F.col("s")).alias("length"))
        if tier != "total":
            means = cv.mean_coverage(depth, lengths, "tx_id").filter("mean > 0")
            depth = depth.join(sq.tiers(means, "mean", "tx_id", 500).filter(tier).select("tx_id"), "tx_id", "left_semi")
        return cv.coverage_profile(depth, lengths, "tx_id").orderBy("bin")

    # -- complexity

    def fragment_histogram(self) -> DataFrame:
        kept = self.reads.filter(fl.complexity_reads()).withColumn("end", cg.reference_end(F.col("ops"), F.col("pos")))
        paired = fl.has(fl.PAIRED)
        pairs = kept.filter(paired).groupBy("qname").agg(F.count("*").alias("n"), F.min("tid").alias("tid"), F.max("tid").alias("other"), F.min("pos").alias("s"), F.max("end").alias("e"), F.collect_list(F.struct("tid", "pos", "end")).alias("each"))
        merged = (F.col("n") == 2) & (F.col("tid") == F.col("other")) & (F.col("e") - F.col("s") <= self.params.complexity_max_segment)
        whole = pairs.filter(merged).select(F.lit("pair").alias("kind"), "tid", "s", "e")
        lone = pairs.filter(~merged).select(F.explode("each").alias("x")).select(F.lit("pair").alias("kind"), "x.tid", F.col("x.pos").alias("s"), F.col("x.end").alias("e"))
        single = kept.filter(~paired).select(F.lit("single").alias("kind"), "tid", F.col("pos").alias("s"), F.lit(None).cast("long").alias("e"))
        return complexity.frequency_of_frequencies(whole.unionByName(lone).unionByName(single), ["kind", "tid", "s", "e"]).orderBy("j")

    def complexity_curve(self) -> list[tuple[float, float, float, float]]:
        p = self.params
        histogram = [(r["j"], r["n_j"]) for r in self.fragment_histogram().collect()]
        return complexity.estimate(histogram, p.complexity_step, p.complexity_max, p.complexity_bootstraps, seed=p.complexity_seed)
