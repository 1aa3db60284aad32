"""Text renderings of the analyses, in the formats their tools write."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import UTC, datetime
from decimal import Decimal

from stratalign.functions.numeric import logistic_predict


def number15(x: float | int | None) -> str:
    """Fifteen significant digits, fixed or scientific, whichever is shorter; NA for missing."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NA"
    if isinstance(x, int):
        return str(x)
    if math.isinf(x):
        return "Inf" if x > 0 else "-Inf"
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{x:.14e}".partition("e")
    digits = mantissa.rstrip("0").rstrip(".")
    power = int(exponent)
    scientific = f"{digits}e{'-' if power < 0 else '+'}{abs(power):02d}"
    places = max(0, len(digits.lstrip("-").replace(".", "")) - 1 - power)
    fixed = f"{x:.{places}f}"
    return fixed if len(fixed) <= len(scientific) else scientific


def shortest(x: float) -> str:
    """The fewest digits that read back as the same number, never with an exponent."""
    return "NaN" if math.isnan(x) else format(Decimal(repr(float(x))), "f").removesuffix(".0")


def percent(part: float, whole: float) -> str:
    return f"{100 * part / whole:.2f}%" if whole else "N/A"


def table(header: Iterable[str] | None, rows: Iterable[Iterable], sep: str = "\t") -> str:
    lines = [sep.join(header)] if header else []
    lines += [sep.join(x if isinstance(x, str) else number15(x) for x in row) for row in rows]
    return "\n".join(lines) + "\n"


# The column heads of the duplication matrix.
MATRIX_COLUMNS = ["ID", "geneLength", "allCountsMulti", "filteredCountsMulti", "dupRateMulti", "dupsPerIdMulti", "RPKMulti", "PKMMulti", "allCounts", "filteredCounts", "dupRate", "dupsPerId", "RPK", "RPKM"]
_MATRIX_FIELDS = ["gene_id", "length", "all_multi", "filt_multi", "dup_rate_multi", "dups_per_id_multi", "rpk_multi", "rpkm_multi", "all_unique", "filt_unique", "dup_rate", "dups_per_id", "rpk", "rpkm"]


def dup_matrix(rows) -> str:
    return table(MATRIX_COLUMNS, ([r[f] for f in _MATRIX_FIELDS] for r in rows))


def intercept_slope(intercept: float, slope: float, sample: str) -> str:
    return f"{sample} - dupRadar Int (duprate at low read counts): {shortest(intercept)}\n{sample} - dupRadar Sl (progression of the duplication rate): {shortest(slope)}\n"


# Heads of the files that a report collector reads.
INTERCEPT_HEAD = """# id: dupRadar
# plot_type: 'generalstats'
# pconfig:
#     dupRadar_intercept:
#         title: 'dupRadar int'
#         namespace: 'dupRadar'
#         description: 'dupRadar duplication rate at low read counts'
#         max: 100
#         min: 0
#         format: '{:.2f}'
Sample\tdupRadar_intercept
"""
CURVE_HEAD = """# id: 'dupradar'
# section_name: 'dupRadar'
# description: 'Duplication rate vs expression'
# plot_type: 'linegraph'
# pconfig:
#     title: 'dupRadar General Linear Model'
#     xlab: 'Expression (reads/kbp)'
#     ylab: 'Duplication rate (%)'
#     ymin: 0
#     ymax: 100
#     xlog: True
"""
BIOTYPE_HEAD = """# id: 'biotype_counts'
# section_name: 'Biotype Counts'
# description: "shows reads overlapping genomic features of different biotypes,
#     counted by stratalign based on the <a href='http://bioinf.wehi.edu.au/featureCounts'>featureCounts</a> implementation."
# plot_type: 'bargraph'
# anchor: 'featurecounts_biotype'
# pconfig:
#     id: "featurecounts_biotype_plot"
#     title: "featureCounts: Biotypes"
#     xlab: "# Reads"
#     cpswitch_counts_label: "Number of Reads"
"""
RRNA_HEAD = """#id: 'biotype-gs'
#plot_type: 'generalstats'
#pconfig:
#    percent_rRNA:
#        title: '% rRNA'
#        namespace: 'Biotype Counts'
#        description: '% reads overlapping rRNA features'
#        max: 100
#        min: 0
#        scale: 'RdYlGn-rev'
Sample\tpercent_rRNA
"""


def intercept_mqc(intercept: float, sample: str) -> str:
    return f"{INTERCEPT_HEAD}{sample}\t{shortest(intercept)}\n"


def dup_curve_mqc(intercept: float, slope: float, low: float | None, high: float | None, points: int = 101) -> str:
    """The fitted curve in percent at log-spaced expressions from the least to the largest; intercept and slope are
    exponentials of the coefficients, as they are reported."""
    if low is None or high is None:
        return CURVE_HEAD
    first, last = math.log10(low), math.log10(high)
    xs = [10 ** (first + (last - first) * k / (points - 1)) for k in range(points)]
    return CURVE_HEAD + "".join(f"{shortest(x)}\t{shortest(100 * logistic_predict(x, math.log(intercept), math.log(slope)))}\n" for x in xs)


def gene_counts(rows, sample: str) -> str:
    head = ["Geneid", "Chr", "Start", "End", "Strand", "Length", sample]
    body = ([r["gene_id"], *[";".join(str(v) for v in column) for column in (
        [x["chrom"] for x in r["exons"]], [x["s"] + 1 for x in r["exons"]], [x["e"] for x in r["exons"]], [x["strand"] for x in r["exons"]])], r["length"], r["reads"]] for r in rows)
    return table(head, body)


# The statuses of a read-count summary, in their order.
SUMMARY_STATUSES = ["Assigned", "Unassigned_Unmapped", "Unassigned_Read_Type", "Unassigned_Singleton", "Unassigned_MappingQuality", "Unassigned_Chimera", "Unassigned_FragmentLength", "Unassigned_Duplicate", "Unassigned_MultiMapping", "Unassigned_Secondary", "Unassigned_NonSplit", "Unassigned_NoFeatures", "Unassigned_Overlapping_Length", "Unassigned_Ambiguity"]


def count_summary(status: dict[str, int], sample: str) -> str:
    known = {"Assigned": "assigned", "Unassigned_Unmapped": "unmapped", "Unassigned_MultiMapping": "multimapping", "Unassigned_NoFeatures": "no_features", "Unassigned_Ambiguity": "ambiguous"}
    return table(["Status", sample], ([s, status.get(known.get(s, ""), 0)] for s in SUMMARY_STATUSES))


def biotype_counts(rows) -> str:
    return table(["Biotype", "Count"], ([r["biotype"], r["reads"]] for r in rows))


def biotype_counts_mqc(rows) -> str:
    return BIOTYPE_HEAD + "".join(f"{r['biotype']}\t{r['reads']}\n" for r in rows)


def rrna_mqc(rows, assigned: int, sample: str, name: str = "rRNA") -> str:
    share = sum(r["reads"] for r in rows if r["biotype"] == name) / assigned * 100 if assigned else 0.0
    return f"{RRNA_HEAD}'{sample}'\t{shortest(share)}\n"


def bam_stat(r) -> str:
    lines = [("Total records", "total"), ("QC failed", "qc_failed"), ("Optical/PCR duplicate", "duplicates"), ("Non primary hits", "non_primary"), ("Unmapped reads", "unmapped"), ("mapq < mapq_cut (non-unique)", "non_unique"), ("mapq >= mapq_cut (unique)", "unique"), ("Read-1", "read_1"), ("Read-2", "read_2"), ("Reads map to '+'", "forward"), ("Reads map to '-'", "reverse"), ("Non-splice reads", "non_spliced"), ("Splice reads", "spliced"), ("Reads mapped in proper pairs", "proper_pairs")]
    return "".join(f"{label + ':':<40}{r[key]}\n" for label, key in lines)


def flagstat(r) -> str:
    """Sixteen lines of passed + failed counts; the failed column is always 0."""
    get = lambda k: r[k] if k in r.asDict() else 0
    share = lambda a, b: f"({percent(get(a), get(b))} : N/A)"
    lines = [
        f"{r['total']} + 0 in total (QC-passed reads + QC-failed reads)",
        f"{r['primary_reads']} + 0 primary",
        f"{r['secondary']} + 0 secondary",
        f"{r['supplementary']} + 0 supplementary",
        f"{r['duplicates']} + 0 duplicates",
        f"{get('primary_duplicates')} + 0 primary duplicates",
        f"{r['mapped']} + 0 mapped {share('mapped', 'total')}",
        f"{r['primary_mapped']} + 0 primary mapped {share('primary_mapped', 'primary_reads')}",
        f"{r['paired']} + 0 paired in sequencing",
        f"{r['read1']} + 0 read1",
        f"{r['read2']} + 0 read2",
        f"{r['properly_paired']} + 0 properly paired {share('properly_paired', 'paired')}",
        f"{r['both_mapped']} + 0 with itself and mate mapped",
        f"{r['singletons']} + 0 singletons {share('singletons', 'paired')}",
        f"{get('mate_other_chrom')} + 0 with mate mapped to a different chr",
        f"{get('mate_other_chrom_mapq5')} + 0 with mate mapped to a different chr (mapQ>=5)",
    ]
    return "\n".join(lines) + "\n"


def idxstats(rows) -> str:
    return table(None, ([r["name"] or "*", r["length"], r["mapped"], r["unmapped"]] for r in rows))


def strandedness(shares, layout: str) -> str:
    """layout: PairEnd, SingleEnd, or anything else where reads of both kinds or none were seen."""
    named = {"PairEnd": ('"1++,1--,2+-,2-+"', '"1+-,1-+,2++,2--"'), "SingleEnd": ('"++,--"', '"+-,-+"')}
    if layout not in named:
        return "\n\nUnknown Data type\n"
    sense, anti = named[layout]
    return f"\n\nThis is {layout} Data\nFraction of reads failed to determine: {shares['failed']:.4f}\nFraction of reads explained by {sense}: {shares['sense']:.4f}\nFraction of reads explained by {anti}: {shares['antisense']:.4f}\n"


def duplication_table(rows, unit: str) -> str:
    return table(["Occurrence", "UniqReadNumber"], ([r["times"], r[unit]] for r in rows))


def _vector(values) -> str:
    return f"c({','.join(map(str, values))})"


def duplication_script(positions, sequences, sample: str) -> str:
    # The plotting commands.
    mark = [f"log10(pos_uniqRead[{k}])" for k in range(1, 5)]
    share = [f"round(pos_uniqRead[{k}]*100/sum(pos_uniqRead*pos_occ))" for k in range(1, 5)]
    return f"""pdf('{sample}.DupRate_plot.pdf')
par(mar=c(5,4,4,5),las=0)
seq_occ={_vector(r["times"] for r in sequences)}
seq_uniqRead={_vector(r["sequences"] for r in sequences)}
pos_occ={_vector(r["times"] for r in positions)}
pos_uniqRead={_vector(r["positions"] for r in positions)}
plot(pos_occ,log10(pos_uniqRead),ylab='Number of Reads (log10)',xlab='Occurrence of read',pch=4,cex=0.8,col='blue',xlim=c(1,500),yaxt='n')
points(seq_occ,log10(seq_uniqRead),pch=20,cex=0.8,col='red')
ym=floor(max(log10(pos_uniqRead)))
legend(300,ym,legend=c('Mapping-based','Sequence-based'),col=c('blue','red'),pch=c(4,20))
axis(side=2,at=0:ym,labels=0:ym)
axis(side=4,at={_vector(mark)}, labels={_vector(share)})
mtext(4, text = "Reads %", line = 2)
dev.off()
"""


def read_distribution(rows, reads: int, tags: int) -> str:
    assigned = sum(r["tags"] for r in rows if "kb" not in r["region"] or "10kb" in r["region"])
    head = f"{'Total Reads':<30}{reads}\n{'Total Tags':<30}{tags}\n{'Total Assigned Tags':<30}{assigned}\n{'=' * 69}\n{'Group':<20}{'Total_bases':<20}{'Tag_count':<20}{'Tags/Kb':<20}\n"
    return head + "".join(f"{r['region']:<20}{r['bases']:<20}{r['tags']:<20}{r['tags'] * 1000 / (r['bases'] + 1):<18.2f}\n" for r in rows) + "=" * 69 + "\n"


def junctions(rows) -> str:
    """A space stands before the class."""
    head = ["chrom", "intron_st(0-based)", "intron_end(1-based)", "read_count", "annotation"]
    return table(head, ([r["chrom"].replace("CHR", "chr"), r["s"], r["e"], r["reads"], f" {r['class']}"] for r in rows))


# The classes in the order of the log, with their names there.
JUNCTION_CLASSES = [("annotated", "Known"), ("partial_novel", "Partial Novel"), ("complete_novel", "Novel")]


def junction_log(classes: dict[str, tuple[int, int]], filtered: int, annotation: str) -> str:
    """classes: class -> (events, junctions); filtered: events of introns that are too short."""
    events, kinds = ([classes.get(c, (0, 0))[k] for c, _ in JUNCTION_CLASSES] for k in (0, 1))
    line = "=" * 67
    out = [f"Reading reference gene model:  {annotation}  ...  Done", "Load BAM file ...  Done", "", line, f"Total splicing  Events:\t{sum(events) + filtered}"]
    out += [f"{name} Splicing Events:\t{n}" for (_, name), n in zip(JUNCTION_CLASSES, events, strict=True)] + [f"Filtered Splicing Events:\t{filtered}", "", f"Total splicing  Junctions:\t{sum(kinds)}"]
    out += [f"{name} Splicing Junctions:\t{n}" for (_, name), n in zip(JUNCTION_CLASSES, kinds, strict=True)] + ["", line, "Create BED file ...", "Create Interact file ..."]
    return "\n".join(out) + "\n"


def junction_script(classes: dict[str, tuple[int, int]], filtered: int, prefix: str) -> str:
    """Two pies, of events (short introns are part of the whole) and of junctions."""
    out = []
    for k, (unit, title, name) in enumerate((("events", "splicing events", "splice_events"), ("junction", "splicing junctions", "splice_junction"))):
        each = {c: classes.get(c, (0, 0))[k] for c, _ in JUNCTION_CLASSES}
        whole = sum(each.values()) + (filtered if k == 0 else 0)
        shares = [each[c] * 100.0 / whole if whole else 0.0 for c in ("partial_novel", "complete_novel", "annotated")]
        labels = ",".join(f'"{label} {math.floor(x + 0.5)}%"' for label, x in zip(("partial_novel", "complete_novel", "known"), shares, strict=True))
        out += [f'pdf("{prefix}.{name}.pdf")', f"{unit}={_vector(map(shortest, shares))}", f'pie({unit},col=c(2,3,4),init.angle=30,angle=c(60,120,150),density=c(70,70,70),main="{title}",labels=c({labels}))', "dev.off()"]
    return "\n".join(out) + "\n"


# Colours of the junction classes.
COLOURS = {"annotated": "205,0,0", "partial_novel": "0,205,0", "complete_novel": "0,0,205"}


def junction_bed(rows) -> str:
    return table(None, ([r["chrom"].replace("CHR", "chr"), r["s"] - 1, r["e"] + 1, r["class"], r["reads"], ".", r["s"] - 1, r["e"] + 1, COLOURS[r["class"]], 2, "1,1", f"0,{r['e'] - r['s'] + 1}"] for r in rows))


def junction_interact(rows) -> str:
    return table(None, ([c := r["chrom"].replace("CHR", "chr"), r["s"] - 1, r["e"] + 1, r["class"], min(1000, r["reads"]), r["reads"], "stratalign", COLOURS[r["class"]], c, r["s"] - 1, r["s"], ".", ".", c, r["e"], r["e"] + 1, ".", "."] for r in rows))


def saturation_script(rows, prefix: str) -> str:
    known, new = [r["known"] for r in rows], [r["novel"] for r in rows]
    every = [a + b for a, b in zip(known, new, strict=True)]
    ends = lambda k: ",".join(str(x[k] // 1000 if x else 0) for x in (known, every, new))
    return f"""pdf('{prefix}.junctionSaturation_plot.pdf')
x={_vector(r["pct"] for r in rows)}
y={_vector(known)}
z={_vector(every)}
w={_vector(new)}
m=max({ends(-1)})
n=min({ends(0)})
plot(x,z/1000,xlab='percent of total reads',ylab='Number of splicing junctions (x1000)',type='o',col='blue',ylim=c(n,m))
points(x,y/1000,type='o',col='red')
points(x,w/1000,type='o',col='green')
legend(5,{every[-1] // 1000 if every else 0}, legend=c("All junctions","known junctions", "novel junctions"),col=c("blue","red","green"),lwd=1,pch=1)
dev.off()
"""


def saturation_summary(rows) -> str:
    return table(["Percent", "All_Junctions", "Known_Junctions", "Novel_Junctions"], ([r["pct"], r["known"] + r["novel"], r["known"], r["novel"]] for r in rows))


def inner_distance(rows) -> str:
    return table(None, ([r["qname"], "NA" if r["dist"] is None else r["dist"], r["class"]] for r in rows))


def inner_distance_histogram(rows, step: int) -> str:
    return table(None, ([r["lo"], r["lo"] + step, r["pairs"]] for r in rows))


# The classes of inner distances in the order of the summary, with their names there.
DISTANCE_CLASSES = [
    ("sameChrom=No", "Different chromosome"),
    ("sameTranscript=No,dist=genomic", "Different transcript"),
    ("sameTranscript=Yes,sameExon=Yes,dist=mRNA", "Same exon (mRNA distance)"),
    ("sameTranscript=Yes,sameExon=No,dist=mRNA", "Different exon (mRNA distance)"),
    ("sameTranscript=Yes,nonExonic=Yes,dist=genomic", "Non-exonic (genomic distance)"),
    ("unknownChromosome,dist=genomic", "Unknown chromosome"),
    ("readPairOverlap", "Read pair overlap"),
]


def _centres(bins, step: int) -> list[tuple[float, int]]:
    return [(r["lo"] + step / 2, r["pairs"]) for r in bins]


def inner_distance_summary(classes: dict[str, int], bins, step: int) -> str:
    lines = [f"Total read pairs: {sum(classes.values())}", *(f"{name}: {classes.get(c, 0)}" for c, name in DISTANCE_CLASSES)]
    total = sum(n for _, n in _centres(bins, step))
    if total:
        lines.append(f"Mean inner distance: {sum(x * n for x, n in _centres(bins, step)) / total:.2f}")
    return "\n".join(lines) + "\n"


def inner_distance_mean(bins, step: int, sample: str) -> str:
    """Mean, median and sample deviation of the bins' centres, each as often as its bin has pairs."""
    held = sorted(x for x in _centres(bins, step) if x[1])
    n = sum(c for _, c in held)
    if not n:
        return table(["Name", "Mean", "Median", "sd"], [])

    def at(place: int) -> float:
        for x, c in held:
            place -= c
            if place < 0:
                return x
        return math.nan

    mean = sum(x * c for x, c in held) / n
    sd = math.sqrt(sum(c * (x - mean) ** 2 for x, c in held) / (n - 1)) if n > 1 else math.nan
    return table(["Name", "Mean", "Median", "sd"], [[sample, number15(mean), number15((at((n - 1) // 2) + at(n // 2)) / 2), number15(sd)]])


def inner_distance_script(bins, step: int, prefix: str) -> str:
    # The plotting commands.
    centres, counts = zip(*_centres(bins, step), strict=True) if bins else ((), ())
    return f"""out_file = '{prefix}'
pdf('{prefix}.inner_distance_plot.pdf')
fragsize=rep({_vector(map(shortest, centres))},times={_vector(counts)})
frag_sd = sd(fragsize)
frag_mean = mean(fragsize)
frag_median = median(fragsize)
write(x=c("Name","Mean","Median","sd"), sep="\t", file=stdout(),ncolumns=4)
write(c(out_file,frag_mean,frag_median,frag_sd),sep="\t", file=stdout(),ncolumns=4)
hist(fragsize,probability=T,breaks={len(counts)},xlab="mRNA insert size (bp)",main=paste(c("Mean=",frag_mean,";","SD=",frag_sd),collapse=""),border="blue")
lines(density(fragsize,bw={2 * step}),col='red')
dev.off()
"""


def tin_summary(row, file: str) -> str:
    return table(["Bam_file", "TIN(mean)", "TIN(median)", "TIN(stdev)"], [[file, *(shortest(row[k] or 0.0) for k in ("mean", "median", "sd"))]])


def tin(rows) -> str:
    return table(["geneID", "chrom", "tx_start", "tx_end", "TIN"], ([r["tx_id"], r["chrom"], r["s"], r["e"], repr(r["tin"]) if r["tin"] or not r["passed"] else "0"] for r in rows))


def complexity(curve) -> str:
    show = lambda x: "-" if math.isnan(x) else f"{x:.1f}"
    return table(["TOTAL_READS", "EXPECTED_DISTINCT", "LOWER_0.95CI", "UPPER_0.95CI"], [["0", "0", "0", "0"], *[[show(x) for x in row] for row in curve]])


def coverage_profile(rows) -> str:
    return table(["#Transcript position", "Transcript coverage profile"], ([float(r["bin"]), float(r["depth"])] for r in rows))


def trimmed(x: float) -> str:
    """Two decimals without zeros at the end, one at least; NaN as it is."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    whole, _, part = f"{x:.2f}".partition(".")
    return f"{whole}.{part.rstrip('0') or '0'}"


#: Names of the protocols in the gene-body report.
PROTOCOLS = {"forward": "strand-specific-forward", "reverse": "strand-specific-reverse", "unstranded": "non-strand-specific"}


def gene_body_report(alignments: str, annotation: str, protocol: str, paired: bool, counters, origin, votes, bias, events: int, motifs) -> str:
    """Six sections; counters, origin, votes and bias are rows, motifs have motif and percent."""
    many = lambda n: f"{n:,}"
    aligned = [f"reads aligned (left/right) = {many(counters['left'])} / {many(counters['right'])}", f"read pairs aligned  = {many(counters['proper'] // 2)}"] if paired else [f"reads aligned  = {many(counters['reads'])}"]
    aligned += [f"{name} = {many(n)}" for name, n in (("total alignments", counters["primary"] + counters["secondary"]), ("secondary alignments", counters["secondary"]), ("non-unique alignments", counters["non_unique"]), ("aligned to genes ", origin["exonic"]), ("ambiguous alignments", origin["ambiguous"]), ("no feature assigned", origin["no_feature"]), ("not aligned", counters["not_aligned"]))]
    voted = votes["forward"] + votes["reverse"]
    if protocol == "unstranded" and voted:
        aligned.append(f"SSP estimation (fwd/rev) = {votes['forward'] / voted:.2f} / {votes['reverse'] / voted:.2f}")
    whole = origin["exonic"] + origin["intronic"] + origin["intergenic"]
    shares = [f"{name} = {many(origin[key])} ({trimmed(100 * origin[key] / whole)}%)" for name, key in (("exonic", "exonic"), ("intronic", "intronic"), ("intergenic", "intergenic"), ("overlapping exon", "overlapping_exon"))] if whole else []
    shares = [x.replace("exonic = ", "exonic =  ", 1) if x.startswith("exonic") else x for x in shares]
    sections = {
        "Input": [f"bam file = {alignments}", f"gff file = {annotation}", "counting algorithm = uniquely-mapped-reads", f"protocol = {PROTOCOLS[protocol]}", "5'-3' bias region size = 100", "5'-3' bias number of top transcripts = 1000"],
        "Reads alignment": aligned,
        "Reads genomic origin": shares,
        "Transcript coverage profile": [f"{name} bias = {trimmed(math.nan if x is None else x)}" for name, x in (("5'", bias["five"]), ("3'", bias["three"]), ("5'-3'", bias["five_three"]))],
    }
    out = ["RNA-Seq QC report", "-" * 35, ""]
    for name, lines in sections.items():
        out += [f">>>>>>> {name}", "", *(f"    {x}" for x in lines), "", ""]
    out += [">>>>>>> Junction analysis", "", f"    reads at junctions = {many(events)}", "", *(f"    {r['motif']} : {trimmed(r['percent'])}%" for r in motifs)]
    return "\n".join(out) + "\n"


# The published tools whose results the analyses give, with the analyses that ask for them.
CITATIONS = [
    ({"dupradar"}, "dupRadar", "Sayols S, Scherzinger D, Klein H. dupRadar: a Bioconductor package for the assessment of PCR artifacts in RNA-Seq data. *BMC Bioinformatics*. 2016;17(1):428.", "10.1186/s12859-016-1276-2"),
    ({"featurecounts"}, "featureCounts", "Liao Y, Smyth GK, Shi W. featureCounts: an efficient general purpose program for assigning sequence reads to genomic features. *Bioinformatics*. 2014;30(7):923-930.", "10.1093/bioinformatics/btt656"),
    ({"bam_stat", "infer_experiment", "read_duplication", "read_distribution", "junction_annotation", "junction_saturation", "inner_distance", "tin"}, "RSeQC", "Wang L, Wang S, Li W. RSeQC: quality control of RNA-seq experiments. *Bioinformatics*. 2012;28(16):2184-2185.", "10.1093/bioinformatics/bts356"),
    ({"preseq"}, "Preseq", "Daley T, Smith AD. Predicting the molecular complexity of sequencing libraries. *Nature Methods*. 2013;10(4):325-327.", "10.1038/nmeth.2375"),
    ({"flagstat", "idxstats", "stats"}, "Samtools", "Danecek P, Bonfield JK, Liddle J, et al. Twelve years of Samtools and BCFtools. *GigaScience*. 2021;10(2):giab008.", "10.1093/gigascience/giab008"),
    ({"qualimap"}, "Qualimap", "Garcia-Alcalde F, Okonechnikov K, Carbonell J, et al. Qualimap: evaluating next-generation sequencing alignment data. *Bioinformatics*. 2012;28(20):2678-2679.", "10.1093/bioinformatics/bts503"),
]


def citations(analyses: Iterable[str]) -> str:
    """The tools to cite for the analyses that were run."""
    run = set(analyses)
    return "# Citations\n\n" + "".join(f"## {name}\n\n> {reference}\n\n- DOI: [{doi}](https://doi.org/{doi})\n\n" for asked, name, reference, doi in CITATIONS if asked & run)


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
