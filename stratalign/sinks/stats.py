"""The statistics report: 21 sections, each from one small relation."""

from __future__ import annotations

from stratalign.functions.numeric import percentile_p

_PLOTS = "Use `plot-bamstats -p <outdir> <file>` to generate plots"
BASES = ["A", "C", "G", "T", "N", "other"]


def _summary(c: dict) -> list[str]:
    """c: counters by name.  Fixed values: the names, order and remarks of the report's lines."""
    mean = lambda a, b: c[a] / c[b] if c[b] else 0.0
    whole = lambda x: int(x + 0.5)
    average, spread = c["insert_mean"], c["insert_sd"]
    lines = [
        ("raw total sequences", c["primary_reads"], "excluding supplementary and secondary reads"),
        ("filtered sequences", c["qc_failed"], ""),
        ("sequences", max(0, c["primary_reads"] - c["qc_failed"]), ""),
        ("is sorted", 1, "sorted by coordinate"),
        ("1st fragments", c["first_fragments"], ""),
        ("last fragments", c["last_fragments"], ""),
        ("reads mapped", c["primary_mapped"], ""),
        ("reads mapped and paired", c["mapped_and_paired"], "paired-end technology bit set + both mates mapped"),
        ("reads unmapped", c["unmapped"], ""),
        ("reads properly paired", c["properly_paired"], "proper-pair bit set"),
        ("reads paired", c["paired"], "paired-end technology bit set"),
        ("reads duplicated", c["primary_duplicates"], "PCR or optical duplicate bit set"),
        ("reads MQ0", c["mapq0"], "mapped and MQ=0"),
        ("reads QC failed", c["qc_failed"], ""),
        ("non-primary alignments", c["secondary"] + c["supplementary"], ""),
        ("supplementary alignments", c["supplementary"], ""),
        ("total length", c["total"], "ignores clipping"),
        ("total first fragment length", c["first_total"], "ignores clipping"),
        ("total last fragment length", c["last_total"], "ignores clipping"),
        ("bases mapped", c["mapped"], "ignores clipping"),
        ("bases mapped (cigar)", c["bases_aligned"], "more accurate"),
        ("bases trimmed", 0, ""),
        ("bases duplicated", c["duplicated"], ""),
        ("mismatches", c["mismatches"], "from NM fields"),
        ("error rate", f"{mean('mismatches', 'bases_aligned'):.6e}", "mismatches / bases mapped (cigar)"),
        ("average length", whole(mean("total", "primary_reads")), ""),
        ("average first fragment length", whole(mean("first_total", "first_fragments")), ""),
        ("average last fragment length", whole(mean("last_total", "last_fragments")), ""),
        ("maximum length", c["longest"], ""),
        ("maximum first fragment length", c["longest_first"], ""),
        ("maximum last fragment length", c["longest_last"], ""),
        ("average quality", f"{mean('quality_sum', 'quality_bases'):.1f}", ""),
        ("insert size average", f"{average:.1f}", ""),
        ("insert size standard deviation", f"{spread:.1f}", ""),
        ("inward oriented pairs", c["inward"] // 2, ""),
        ("outward oriented pairs", c["outward"] // 2, ""),
        ("pairs with other orientation", c["other"] // 2, ""),
        ("pairs on different chromosomes", c["mate_other_chrom_mapq5"], ""),
        ("percentage of properly paired reads (%)", f"{100 * mean('properly_paired', 'primary_reads'):.1f}", ""),
    ]
    return [f"SN\t{name}:\t{value}" + (f"\t# {remark}" if remark else "") for name, value, remark in lines]


def insert_moments(sizes: list[tuple[int, int]]) -> tuple[float, float]:
    """Mean and population deviation of the main bulk: sizes in order up to the one that takes it over 99 percent; size
    0 counts in the mean alone."""
    total, held, weighed, last = sum(n for _, n in sizes), 0, 0, -1
    for size, n in sorted(sizes):
        last, held, weighed = (size if n else last), held + n, weighed + size * n
        if total and held / total > 0.99:
            break
    if not held:
        return 0.0, 0.0
    mean = weighed / held
    return mean, (sum(n * (size - mean) ** 2 for size, n in sizes if 0 < size <= last) / held) ** 0.5


def _inserts(rows) -> list[str]:
    counts = {r["size"]: (r["total"], r["inward"], r["outward"], r["other"]) for r in rows if r["size"] > 0}
    total, held, limit = sum(n[0] for n in counts.values()) / 2, 0.0, 0
    for size in sorted(counts):
        held, limit = held + counts[size][0] / 2, size + 1
        if held / total > 0.99:
            break
    return ["\t".join(map(str, ("IS", size, *(n // 2 for n in counts.get(size, (0, 0, 0, 0)))))) for size in range(limit)]


def _qualities(tag: str, name: str, rows) -> list[str]:
    """rows: cycle (from 0), quality, n."""
    counts, cycles = {(r["cycle"], r["quality"]): r["n"] for r in rows}, max((r["cycle"] for r in rows), default=-1) + 1
    most = min(63, max((q for (_, q), n in counts.items() if n), default=0) + 1)
    head = [f"# {tag}, {name} quality. Columns correspond to qualities and rows to cycles. First column is the cycle number.", f"# Columns correspond to qualities 0, 1, 2, ..., {most}", f"# {_PLOTS}"]
    return head + ["\t".join(map(str, (tag, c + 1, *(counts.get((c, q), 0) for q in range(most + 1))))) for c in range(cycles)]


def _gc_content(tag: str, name: str, rows) -> list[str]:
    """rows: bin and reads where the step function changes; a line for each plateau of the 200 bins, at its middle."""
    heights, value = {r["bin"]: r["reads"] for r in rows}, 0
    plateaus: list[tuple[int, int]] = []  # first bin, height
    for at in range(200):
        value = heights.get(at, value) if at < 199 else 0
        if not plateaus or plateaus[-1][1] != value:
            plateaus.append((at, value))
    ends = [first for first, _ in plateaus[1:]] + ([199] if value else [])
    return [f"# {tag}, GC content of {name}. {_PLOTS}", *(f"{tag}\t{(first + end) * 50 / 199:.2f}\t{height}" for (first, height), end in zip(plateaus, ends, strict=False))]


def _shares(tag: str, remark: str, rows, bases: list[str], empty: bool) -> list[str]:
    """rows: cycle, base, n; percentages of A, C, G and T together."""
    counts: dict[int, dict[str, int]] = {}
    for r in rows:
        at = counts.setdefault(r["cycle"], dict.fromkeys(BASES, 0))
        at[r["base"]] += r["n"]
    out = [remark]
    for cycle in range(max(counts, default=-1) + 1):
        each = counts.get(cycle, dict.fromkeys(BASES, 0))
        total = sum(each[b] for b in BASES[:4])
        if total or empty:
            out.append("\t".join([tag, str(cycle + 1), *(f"{100 * each[b] / total if total else 0:.2f}" for b in bases)]))
    return out


def gc_depth_lines(bins: list[tuple[float, int]], read_length: float, span: int = 20_000) -> list[str]:
    """bins in scan order: sum of the reads' GC shares, and depth.  As the usual tool has it, the last bin keeps its sum as
    it is, and an empty bin stands before all and takes the place of the last one in order."""
    if not bins:
        return []
    named = [(float(int(100 * gc / depth + 0.5)) if k < len(bins) - 1 else gc, depth) for k, (gc, depth) in enumerate(bins)]
    ordered = [(0.0, 0), *sorted(named)][: len(bins)]
    out = ["# GC-depth. Use `grep ^GCD | cut -f 2-` to extract this part. The columns are: GC%, unique sequence percentiles, 10th, 25th, 50th, 75th and 90th depth percentile"]
    at = 0
    while at < len(ordered):
        first, gc = at, ordered[at][0]
        while at < len(ordered) and abs(ordered[at][0] - gc) < 0.1:
            at += 1
        depths = [float(d) for _, d in ordered[first:at]]
        out.append("\t".join(["GCD", f"{gc:.1f}", f"{(at + 1) * 100 / (len(bins) + 1):.3f}", *(f"{percentile_p(depths, p) * read_length / span:.3f}" for p in (10, 25, 50, 75, 90))]))
    return out


def _coverage(rows) -> list[str]:
    out, over = [f"# COV, Coverage distribution. {_PLOTS}"], 0
    for r in sorted(rows, key=lambda r: r["depth"]):
        if r["depth"] > 1000:
            over += r["positions"]
        elif r["positions"]:
            out.append(f"COV\t[{r['depth']}-{r['depth']}]\t{r['depth']}\t{r['positions']}")
    return out + ([f"COV\t[1000<]\t1000\t{over}"] if over else [])


# Complements of the bases.
_COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def report(d: dict) -> str:
    """d: checksums, counters, cycles (fragment, cycle, reverse, base, quality, n), gc_first, gc_last, sizes, lengths, mapq,
    indels, indel_cycles, depth, gc_depth (in scan order)."""
    c, cycles = d["counters"], d["cycles"]
    side = {which: [r for r in cycles if r["fragment"] == which] for which in ("first", "last")}
    turned = [{"cycle": r["cycle"], "base": _COMPLEMENT[r["base"]] if r["reverse"] else r["base"], "n": r["n"]} for r in cycles if r["base"] in _COMPLEMENT]

    def summed(rows, key: str):
        out: dict[tuple, int] = {}
        for r in rows:
            out[r["cycle"], r[key]] = out.get((r["cycle"], r[key]), 0) + r["n"]
        return [{"cycle": a, key: b, "n": n} for (a, b), n in out.items()]

    per_cycle = lambda name: f"ACGT content per cycle{name}. {_PLOTS}"
    lines = ["# This file was produced by samtools stats and stratalign", "# The command line was: stratalign (samtools stats compatible output)"]
    lines += ["# CHK, Pair of checksum values for read names, sequences and qualities, calculated using a CRC32 algorithm."]
    lines += ["CHK\t" + "\t".join(f"{x or 0:08x}" for x in d["checksums"]), *_summary(c)]
    lines += _qualities("FFQ", "first fragment", summed(side["first"], "quality")) + _qualities("LFQ", "last fragment", summed(side["last"], "quality"))
    lines += _gc_content("GCF", "first fragments", d["gc_first"]) + _gc_content("GCL", "last fragments", d["gc_last"])
    lines += _shares("GCC", f"# GCC, {per_cycle('')}", cycles, BASES, False)
    lines += _shares("GCT", "# ACGT content per cycle, read-oriented (display complement of bases of reverse reads). Use `grep ^GCT | cut -f 2-` to extract this part.", turned, BASES[:4], True)
    for tag, totals, which in (("FBC", "FTC", "first"), ("LBC", "LTC", "last")):
        lines += _shares(tag, f"# {tag}, {per_cycle(f' for {which} fragments')}", side[which], BASES, False)
        lines += [f"# {totals}, total base counters. {_PLOTS}", "\t".join(map(str, (totals, *(sum(r["n"] for r in side[which] if r["base"] == b) for b in BASES[:5]))))]
    lines += [f"# IS, insert size. {_PLOTS}", *_inserts(d["sizes"])]
    for tag, name in (("RL", "reads"), ("FRL", "first"), ("LRL", "last")):
        lines += [f"# {tag}, read length. {_PLOTS}", *(f"{tag}\t{r['len']}\t{r[name]}" for r in sorted(d["lengths"], key=lambda r: r["len"]) if r[name])]
    lines += [f"# MAPQ, mapping quality. {_PLOTS}", *(f"MAPQ\t{r['mapq']}\t{r['reads']}" for r in sorted(d["mapq"], key=lambda r: r["mapq"]))]
    kinds: dict[int, dict[str, int]] = {}
    for r in d["indels"]:
        kinds.setdefault(r["len"], {"I": 0, "D": 0})[r["kind"]] += r["n"]
    lines += [f"# ID, indel size. {_PLOTS}", *(f"ID\t{n}\t{kinds[n]['I']}\t{kinds[n]['D']}" for n in sorted(kinds))]
    order = ("insertions_first", "insertions_last", "deletions_first", "deletions_last")
    lines += [f"# IC, indels per cycle. {_PLOTS}", *("\t".join(map(str, ("IC", r["cycle"], *(r[k] for k in order)))) for r in sorted(d["indel_cycles"], key=lambda r: r["cycle"]) if any(r[k] for k in order))]
    lines += _coverage(d["depth"]) + gc_depth_lines(d["gc_depth"], c["total"] / c["primary_reads"] if c["primary_reads"] else 0.0)
    return "\n".join(lines) + "\n"
