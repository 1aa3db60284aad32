"""Runs the analyses of one or several files and writes their reports."""

from __future__ import annotations

import json
import os
import sys
import time
import traceback
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark.sql import SparkSession

from stratalign.functions import flags as fl
from stratalign.plans import coverage as cv, pairs as pr
from stratalign.plans.session import Params, QcSession
from stratalign.sinks import stats, text


def stem(path: str) -> str:
    return os.path.basename(path).rsplit(".", 1)[0]


def reports(q: QcSession, name: str) -> dict[str, dict[str, object]]:
    """analysis -> {file: function that renders it}; nothing runs before its function is called, and what several files
    share is computed once."""
    p = q.params

    @cache
    def matrix():
        return q.dup_matrix().collect()

    @cache
    def fitted() -> tuple[float, float]:
        return q.fit()

    def curve() -> str:
        rpk = [r["rpk"] for r in matrix() if r["rpk"] > 0]
        return text.dup_curve_mqc(*fitted(), min(rpk, default=None), max(rpk, default=None))

    def tags() -> str:
        reads = q.reads.filter(fl.usable())
        return text.read_distribution(q.read_distribution().collect(), reads.count(), q.blocks(reads).count())

    @cache
    def status() -> dict[str, int]:
        return {r["status"]: r["reads"] for r in q.read_summary().collect()}

    @cache
    def biotypes():
        return q.biotype_counts().collect()

    @cache
    def biotype_status() -> dict[str, int]:
        return {r["status"]: r["reads"] for r in q.biotype_summary().collect()}

    @cache
    def duplication() -> tuple[list, list]:
        return q.position_duplication().collect(), q.sequence_duplication().collect()

    @cache
    def junctions():
        return q.junctions().collect()

    @cache
    def junction_classes() -> dict[str, tuple[int, int]]:
        kinds = [(r["class"], r["reads"]) for r in junctions()]
        return {c: (sum(n for k, n in kinds if k == c), sum(k == c for k, _ in kinds)) for c, _ in text.JUNCTION_CLASSES}

    @cache
    def saturation():
        return q.junction_saturation().collect()

    @cache
    def distances():
        return q.inner_distance().collect()

    @cache
    def distance_bins():
        return pr.distance_histogram(q.inner_distance().filter("dist is not null"), p.inner_low, p.inner_high, p.inner_step).orderBy("lo").collect()

    def distance_classes() -> dict[str, int]:
        return dict(Counter(r["class"] for r in distances()))

    def strands() -> str:
        return text.strandedness(cv.strandedness_verdict(q.strandedness()).na.fill(0.0).first(), q.layout())

    def gene_body() -> str:
        events = q.junction_event_classes().first()["events"]
        return text.gene_body_report(q.path, q.gtf_path, p.protocol, p.paired, q.gene_body_counters().first(), q.read_origin().first(), q.strand_votes().first(), q.prime_bias().first(), events, q.junction_motifs().collect())

    return {
        "dupradar": {
            f"{name}_dupMatrix.txt": lambda: text.dup_matrix(matrix()),
            f"{name}_intercept_slope.txt": lambda: text.intercept_slope(*fitted(), name),
            f"{name}_dup_intercept_mqc.txt": lambda: text.intercept_mqc(fitted()[0], name),
            f"{name}_duprateExpDensCurve_mqc.txt": curve,
        },
        "featurecounts": {
            f"{name}.featureCounts.tsv": lambda: text.gene_counts(q.read_counts().collect(), name),
            f"{name}.featureCounts.tsv.summary": lambda: text.count_summary(status(), os.path.basename(q.path)),
            f"{name}.featureCounts.biotype.tsv.summary": lambda: text.count_summary(biotype_status(), os.path.basename(q.path)),
            f"{name}.biotype_counts.tsv": lambda: text.biotype_counts(biotypes()),
            f"{name}.biotype_counts_mqc.tsv": lambda: text.biotype_counts_mqc(biotypes()),
            f"{name}.biotype_counts_rrna_mqc.tsv": lambda: text.rrna_mqc(biotypes(), biotype_status().get("assigned", 0), name),
        },
        "bam_stat": {f"{name}.bam_stat.txt": lambda: text.bam_stat(q.bam_stat().first())},
        "flagstat": {f"{name}.flagstat": lambda: text.flagstat(q.flagstat().first())},
        "idxstats": {f"{name}.idxstats": lambda: text.idxstats(q.idxstats().collect())},
        "stats": {f"{name}.stats": lambda: stats_report(q)},
        "infer_experiment": {f"{name}.infer_experiment.txt": strands},
        "read_duplication": {
            f"{name}.pos.DupRate.xls": lambda: text.duplication_table(duplication()[0], "positions"),
            f"{name}.seq.DupRate.xls": lambda: text.duplication_table(duplication()[1], "sequences"),
            f"{name}.DupRate_plot.r": lambda: text.duplication_script(*duplication(), name),
        },
        "read_distribution": {f"{name}.read_distribution.txt": tags},
        "junction_annotation": {
            f"{name}.junction.xls": lambda: text.junctions(junctions()),
            f"{name}.junction.bed": lambda: text.junction_bed(junctions()),
            f"{name}.junction.Interact.bed": lambda: text.junction_interact(junctions()),
            f"{name}.junction_plot.r": lambda: text.junction_script(junction_classes(), q.short_introns(), name),
            f"{name}.junction_annotation.log": lambda: text.junction_log(junction_classes(), q.short_introns(), os.path.basename(q.gtf_path)),
        },
        "junction_saturation": {
            f"{name}.junctionSaturation_plot.r": lambda: text.saturation_script(saturation(), name),
            f"{name}.junctionSaturation_summary.txt": lambda: text.saturation_summary(saturation()),
        },
        "inner_distance": {
            f"{name}.inner_distance.txt": lambda: text.inner_distance(distances()),
            f"{name}.inner_distance_freq.txt": lambda: text.inner_distance_histogram(distance_bins(), p.inner_step),
            f"{name}.inner_distance_plot.r": lambda: text.inner_distance_script(distance_bins(), p.inner_step, name),
            f"{name}.inner_distance_summary.txt": lambda: text.inner_distance_summary(distance_classes(), distance_bins(), p.inner_step),
            f"{name}.inner_distance_mean.txt": lambda: text.inner_distance_mean(distance_bins(), p.inner_step, name),
        },
        "tin": {f"{name}.tin.xls": lambda: text.tin(q.tin().collect()), f"{name}.summary.txt": lambda: text.tin_summary(q.tin_summary().first(), os.path.basename(q.path))},
        "qualimap": {"rnaseq_qc_results.txt": gene_body} | {f"coverage_profile_along_genes_({tier}).txt": (lambda tier=tier: text.coverage_profile(q.coverage_profile(tier).collect())) for tier in ("total", "high", "low")},
        "preseq": {f"{name}.lc_extrap.txt": lambda: text.complexity(q.complexity_curve())},
    }


def stats_report(q: QcSession) -> str:
    """The statistics report; every section comes from a relation whose size the read length or the genome bounds."""
    sizes = q.template_sizes().collect()
    mean, sd = stats.insert_moments([(r["size"], r["total"]) for r in sizes if r["size"] > 0])
    counters = {"unmapped": q.bam_stat().first()["unmapped"], "insert_mean": mean, "insert_sd": sd, **{k: sum(r[k] for r in sizes) for k in ("inward", "outward", "other")}}
    for part in (q.flagstat(), q.length_sums(), q.report_counters()):
        counters |= {k: v or 0 for k, v in part.first().asDict().items()}
    return stats.report(
        {
            "checksums": tuple(q.checksums().first()),
            "counters": counters,
            "cycles": q.cycle_matrices().collect(),
            "gc_first": q.gc_steps().collect(),
            "gc_last": q.gc_steps(last=True).collect(),
            "sizes": sizes,
            "lengths": q.read_lengths().collect(),
            "mapq": q.mapq_histogram().collect(),
            "indels": q.indels().collect(),
            "indel_cycles": q.indel_cycles().collect(),
            "depth": q.depth_histogram().collect(),
            "gc_depth": [(r["gc"], r["depth"]) for r in q.gc_depth().orderBy("tid", "start").collect()],
        }
    )


def run_file(spark: SparkSession, path: str, gtf: str, params: Params, outdir: str, skip: list[str], flat: bool) -> dict:
    started, q, name = time.monotonic(), QcSession(spark, path, gtf, params), stem(path)
    q.validate()
    written, wanted = [], {tool: files for tool, files in reports(q, name).items() if tool not in skip}
    for tool, files in wanted.items():
        folder = outdir if flat else os.path.join(outdir, tool)
        os.makedirs(folder, exist_ok=True)
        for file, render in files.items():
            try:
                content = render()
            except ValueError as error:  # a sample too small for one analysis does not end the others
                print(f"{name}: {tool}: {error}", file=sys.stderr)
                continue
            with open(os.path.join(folder, file), "w", encoding="utf-8") as out:
                out.write(content)
            written.append({"tool": tool, "path": os.path.join(folder, file)})
    summary = {"sample": name, "input": path, "status": "ok", "counting": q.counting_summary()}
    if "dupradar" in wanted:
        summary["dupradar"] = q.duplication_summary() | dict(zip(("intercept", "slope"), _fit(q), strict=True))
    if "infer_experiment" in wanted:
        found = cv.strandedness_suggestion(cv.strandedness_verdict(q.strandedness()).na.fill(0.0).first(), params.protocol)
        if found:
            summary["suggested_protocol"] = found
            print(f"{name}: the reads look {found}, but the protocol is given as {params.protocol}", file=sys.stderr)
    q.reads.unpersist()
    return summary | {"time": text.utc_now(), "runtime_seconds": round(time.monotonic() - started, 3), "outputs": written}


def _fit(q: QcSession) -> tuple[float | None, float | None]:
    try:
        return q.fit()
    except ValueError:  # too few genes for a curve
        return None, None


def run(spark: SparkSession, inputs: list[str], gtf: str, params: Params, outdir: str = ".", skip: list[str] = (), flat: bool = False) -> list[dict]:
    """A summary per input; one that fails does not stop the others."""
    names = [stem(p) for p in inputs]
    if len(set(names)) < len(names):
        raise ValueError("inputs with equal names: " + ", ".join(sorted({n for n in names if names.count(n) > 1})))

    os.makedirs(outdir, exist_ok=True)

    def one(path: str) -> dict:
        try:
            return run_file(spark, path, gtf, params, outdir, list(skip), flat)
        except Exception as error:
            traceback.print_exc()
            return {"sample": stem(path), "input": path, "time": text.utc_now(), "outputs": [], "status": f"failed: {error}"}

    with ThreadPoolExecutor(max_workers=min(4, len(inputs))) as pool:
        results = list(pool.map(one, inputs))
    with open(os.path.join(outdir, "CITATIONS.md"), "w", encoding="utf-8") as out:
        out.write(text.citations({o["tool"] for r in results for o in r["outputs"]}))
    return results


def main(argv: list[str] | None = None) -> int:
    from stratalign.sources import config

    args = config.parser().parse_args(argv)
    spark = SparkSession.builder.appName("stratalign").getOrCreate()
    results = run(spark, args.inputs, args.gtf, config.params(args), args.outdir, args.skip, args.flat_output)
    if args.json_summary:
        content = json.dumps(results, indent=2)
        if args.json_summary == "-":
            print(content)
        else:
            with open(args.json_summary, "w", encoding="utf-8") as out:
                out.write(content)
    return int(any(r["status"] != "ok" for r in results))


if __name__ == "__main__":
    sys.exit(main())
