"""Known results on the small single-end sample, and SAM = BAM."""

import gzip
import math
import struct
import zlib

import numpy as np
import pytest

from stratalign.plans import run
from stratalign.plans.session import Params, QcSession
from stratalign.sinks import stats, text
from stratalign.sources import bam, gtf, sam

from . import samples

MATRIX = {  # id: len, all multi, filt multi, rate multi, dups multi, rpk multi, rpkm multi, all, filt, rate, dups, rpk, rpkm
    "GENE_HIGH": (1803, 200, 160, 0.2, 40, 110.926234054354, 229660.940071126, 200, 160, 0.2, 40, 110.926234054354, 229660.940071126),
    "GENE_MED": (1102, 50, 40, 0.2, 10, 45.3720508166969, 93937.9934093104, 50, 40, 0.2, 10, 45.3720508166969, 93937.9934093104),
    "GENE_LOW": (501, 10, 5, 0.5, 5, 19.9600798403194, 41325.2170607026, 10, 5, 0.5, 5, 19.9600798403194, 41325.2170607026),
    "GENE_VLOW": (301, 3, 1, 0.666666666666667, 2, 9.96677740863787, 20635.1499143641, 3, 1, 0.666666666666667, 2, 9.96677740863787, 20635.1499143641),
    "GENE_ZERO": (401, 0, 0, math.nan, 0, 0, 0, 0, 0, math.nan, 0, 0, 0),
    "GENE_MED2": (1002, 90, 75, 0.166666666666667, 15, 89.8203592814371, 185963.476773162, 80, 65, 0.1875, 15, 79.8403193612774, 165300.86824281),
    "GENE_OVERLAP": (801, 30, 25, 0.166666666666667, 5, 37.4531835205992, 77542.823024015, 30, 25, 0.166666666666667, 5, 37.4531835205992, 77542.823024015),
    "GENE_SMALL": (101, 100, 40, 0.6, 60, 990.09900990099, 2049894.43043683, 100, 40, 0.6, 60, 990.09900990099, 2049894.43043683),
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sample")
    rows = samples.records()
    (folder / "a.gtf").write_text(samples.gtf_text())
    (folder / "a.sam").write_text(samples.sam_text(rows))
    (folder / "a.bam").write_bytes(samples.bam_bytes(rows))
    (folder / "nodup.sam").write_text(samples.sam_text([r | {"flag": r["flag"] & ~1024} for r in rows]))
    return folder


@pytest.fixture(scope="module")
def session(spark, files):
    return QcSession(spark, str(files / "a.sam"), str(files / "a.gtf"))


def test_duplication_matrix(session):
    rows = session.dup_matrix().collect()
    assert [r["gene_id"] for r in rows] == list(MATRIX)
    for r in rows:
        got = [r[c] for c in ("length", "all_multi", "filt_multi", "dup_rate_multi", "dups_per_id_multi", "rpk_multi", "rpkm_multi", "all_unique", "filt_unique", "dup_rate", "dups_per_id", "rpk", "rpkm")]
        assert got == pytest.approx(MATRIX[r["gene_id"]], rel=1e-6, nan_ok=True)


def test_fit(session):
    assert session.fit() == pytest.approx((0.597277876400675, 0.967140186993884), rel=1e-6)


def test_counters(session):
    stat = session.bam_stat().first()
    assert (stat["total"], stat["duplicates"], stat["unmapped"], stat["unique"], stat["forward"], stat["spliced"]) == (488, 137, 5, 346, 346, 0)
    assert stat["total"] == sum(stat[c] for c in ("qc_failed", "duplicates", "non_primary", "unmapped", "non_unique", "unique"))
    flags = session.flagstat().first()
    assert (flags["total"], flags["duplicates"], flags["mapped"], flags["paired"]) == (488, 137, 483, 0)
    assert [(r["name"], r["length"], r["mapped"], r["unmapped"]) for r in session.idxstats().collect()] == [("chr1", 20000, 263, 0), ("chr2", 20000, 220, 0), (None, 0, 0, 5)]
    sums = session.length_sums().first()
    assert (sums["total"], sums["mapped"], sums["duplicated"]) == (24400, 24150, 6850)


def test_read_counts(session):
    assert [r["reads"] for r in session.read_counts().collect()] == [200, 50, 10, 3, 0, 80, 30, 100]
    assert {r["status"]: r["reads"] for r in session.read_summary().collect()} == {"assigned": 473, "multimapping": 10, "unmapped": 5}


def test_other_analyses(session):
    assert [tuple(r) for r in session.sequence_duplication().collect()] == [(483, 1)]
    assert sum(r["times"] * r["positions"] for r in session.position_duplication().collect()) == 483
    assert sum(r["depth"] * r["positions"] for r in session.depth_histogram().collect()) == 24150
    classes = {r["key"]: r["reads"] for r in session.strandedness().collect()}
    assert classes == {"++": 315, "+-": 31}
    regions = {r["region"]: (r["bases"], r["tags"]) for r in session.read_distribution().collect()}
    assert regions["CDS"] == (6012, 346)
    assert session.junctions().count() == 0
    assert session.inner_distance().count() == 0
    assert session.mapq_histogram().first()["reads"] == 346
    assert sum(r["j"] * r["n_j"] for r in session.fragment_histogram().collect()) == 483
    assert session.tin().count() == 8


def test_bam_equals_sam(spark, files):
    columns = ["qname", "flag", "chrom", "pos", "mapq", "cigar", "tid", "seq", "qual", "nh"]
    text = [tuple(r) for r in sam.read_sam(spark, str(files / "a.sam")).select(*columns).collect()]
    for split in (1 << 20, 3000, 900):
        rows = bam.read_bam(spark, str(files / "a.bam"), split).orderBy("file_order.start", "file_order.row").select(*columns).collect()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, text))


def test_missing_duplicate_marks(spark, files):
    broken = QcSession(spark, str(files / "nodup.sam"), str(files / "a.gtf"))
    with pytest.raises(ValueError, match="duplicate"):
        broken.validate()
    QcSession(spark, str(files / "nodup.sam"), str(files / "a.gtf"), Params(skip_dup_check=True)).validate()


def test_cram_is_refused(spark, tmp_path):
    (tmp_path / "x.cram").write_bytes(b"CRAM\x03\0")
    with pytest.raises(ValueError, match="CRAM"):
        sam.read_alignments(spark, str(tmp_path / "x.cram"))


def test_gtf_errors_and_probe(spark, tmp_path, files):
    (tmp_path / "bad.gtf").write_text('chr1\tx\texon\t10\t5\t.\t+\t.\tgene_id "A";\n')
    with pytest.raises(Exception, match="bad GTF interval"):
        gtf.read_gtf(spark, str(tmp_path / "bad.gtf")).collect()
    assert gtf.biotype_attribute(spark, str(files / "a.gtf")) is None
    assert gtf.has_attribute(spark, str(files / "a.gtf"), "gene_name")


def test_thick_ranges(spark, tmp_path):
    def line(tx, feature, s, e, strand):
        return f'chr1\tx\t{feature}\t{s}\t{e}\t.\t{strand}\t.\tgene_id "{tx}"; transcript_id "{tx}";\n'

    text = line("p", "exon", 1000, 4000, "+") + line("p", "CDS", 1200, 3500, "+") + line("p", "start_codon", 1200, 1202, "+") + line("p", "stop_codon", 3501, 3503, "+")
    text += line("m", "exon", 1000, 4000, "-") + line("m", "CDS", 1500, 3800, "-") + line("m", "stop_codon", 1497, 1499, "-") + line("m", "start_codon", 3798, 3800, "-")
    text += line("n", "exon", 1000, 4000, "-") + line("n", "stop_codon", 1497, 1499, "-")
    (tmp_path / "t.gtf").write_text(text)
    got = {r["tx_id"]: (r["cds_start"], r["cds_end"]) for r in gtf.transcripts(gtf.read_gtf(spark, str(tmp_path / "t.gtf"))).collect()}
    assert got == {"p": (1199, 3503), "m": (1496, 3800), "n": (None, None)}


def test_qualities_of_zero(spark, tmp_path):
    """The character ! is the value 0 and counts as one."""
    line = "r\t0\tchr1\t101\t60\t5M\t*\t0\t0\tACGTN\t!!I!#\n"
    (tmp_path / "q.sam").write_text(samples.HEADER + line)
    rows = sam.read_sam(spark, str(tmp_path / "q.sam"))
    assert bytes(rows.first()["qual"]) == bytes([0, 0, 40, 0, 2])
    q = QcSession(spark, str(tmp_path / "q.sam"), str(tmp_path / "none.gtf"))
    found = {(r["cycle"], r["base"]): r["quality"] for r in q.cycle_matrices().collect()}
    assert found == {(0, "A"): 0, (1, "C"): 0, (2, "G"): 40, (3, "T"): 0, (4, "N"): 2}
    counters = q.report_counters().first()
    assert (counters["quality_sum"], counters["quality_bases"], counters["bases_aligned"]) == (42, 5, 5)
    assert q.checksums().first()["qualities"] == zlib.crc32(bytes([0, 0, 40, 0, 2]))


def test_gtf_goes_by_content(spark, tmp_path, files):
    plain = (files / "a.gtf").read_bytes()
    (tmp_path / "plain.gtf.gz").write_bytes(plain)
    (tmp_path / "zipped.gtf").write_bytes(gzip.compress(plain))
    (tmp_path / "zipped.gtf.gz").write_bytes(gzip.compress(plain))
    expected = sorted(map(str, gtf.read_gtf(spark, str(files / "a.gtf")).drop("row").collect()))
    for name in ("plain.gtf.gz", "zipped.gtf", "zipped.gtf.gz"):
        assert sorted(map(str, gtf.read_gtf(spark, str(tmp_path / name)).drop("row").collect())) == expected


def test_every_report(spark, files, tmp_path):
    """All files of a run, and what they say."""
    (summary,) = run.run(spark, [str(files / "a.sam")], str(files / "a.gtf"), Params(complexity_max=2000, complexity_step=500, complexity_bootstraps=5), str(tmp_path), flat=True)
    assert summary["status"] == "ok"
    out = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert len(out) == 39 and len(summary["outputs"]) == 38
    assert [x for x in out["CITATIONS.md"].splitlines() if x.startswith("## ")] == ["## dupRadar", "## featureCounts", "## RSeQC", "## Preseq", "## Samtools", "## Qualimap"]
    assert {k: summary["counting"][k] for k in ("total_reads", "mapped_reads", "fragments", "assigned", "no_features", "ambiguous", "duplicates", "multimappers")} == {"total_reads": 488, "mapped_reads": 483, "fragments": 483, "assigned": 483, "no_features": 0, "ambiguous": 0, "duplicates": 137, "multimappers": 10}
    assert (summary["dupradar"]["total_genes"], summary["dupradar"]["genes_with_reads"], summary["dupradar"]["genes_with_duplication"]) == (8, 7, 8)
    assert summary["suggested_protocol"] == "forward"
    assert out["a_intercept_slope.txt"].startswith("a - dupRadar Int (duprate at low read counts): 0.5972778764")
    assert out["a_dup_intercept_mqc.txt"].splitlines()[-2:] == ["Sample\tdupRadar_intercept", "a\t" + out["a_intercept_slope.txt"].split(": ")[1].split("\n")[0]]
    curve = [list(map(float, x.split("\t"))) for x in out["a_duprateExpDensCurve_mqc.txt"].splitlines() if not x.startswith("#")]
    assert len(curve) == 101 and curve[0][0] == pytest.approx(9.96677740863787) and curve[-1][0] == pytest.approx(990.09900990099)
    a, b = math.log(0.597277876400675), math.log(0.967140186993884)
    assert all(y == pytest.approx(100 / (1 + math.exp(-(a + b * math.log10(x)))), rel=1e-5) for x, y in curve)
    assert out["a.featureCounts.tsv.summary"].splitlines()[:3] == ["Status\ta.sam", "Assigned\t473", "Unassigned_Unmapped\t5"]
    assert out["a.flagstat"].splitlines()[4:6] == ["137 + 0 duplicates", "137 + 0 primary duplicates"]
    assert out["a.infer_experiment.txt"].splitlines()[2] == "This is SingleEnd Data"
    assert out["a.junction_annotation.log"].splitlines()[4:6] == ["Total splicing  Events:\t0", "Known Splicing Events:\t0"]
    assert out["a.junctionSaturation_summary.txt"].splitlines()[-1] == "100\t0\t0\t0"
    assert out["a.inner_distance_mean.txt"].startswith("Name\tMean\tMedian\tsd")
    assert out["a.inner_distance_summary.txt"].startswith("Total read pairs: 0\nDifferent chromosome: 0\n")
    assert out["a.summary.txt"].splitlines()[0] == "Bam_file\tTIN(mean)\tTIN(median)\tTIN(stdev)"
    assert out["a.DupRate_plot.r"].count("\n") == 14 and "seq_uniqRead=c(1)" in out["a.DupRate_plot.r"]
    assert out["a.biotype_counts.tsv"].splitlines()[0] == "Biotype\tCount"
    body = out["rnaseq_qc_results.txt"]
    assert "    reads aligned  = 483\n" in body and "    non-unique alignments = 10\n" in body and "    aligned to genes  = 473\n" in body
    assert "    exonic =  473 (100.0%)\n" in body and "    overlapping exon = 0 (0.0%)\n" in body and "    reads at junctions = 0\n" in body
    stats = out["a.stats"].splitlines()
    named = {x.split("\t")[1]: x.split("\t")[2] for x in stats if x.startswith("SN")}
    assert (named["raw total sequences:"], named["reads mapped:"], named["reads duplicated:"], named["total length:"], named["bases mapped (cigar):"], named["average quality:"], named["error rate:"]) == ("488", "483", "137", "24400", "24150", "40.0", "0.000000e+00")
    tags = list(dict.fromkeys(x.split("\t")[0] for x in stats if not x.startswith("#")))
    assert tags == ["CHK", "SN", "FFQ", "GCF", "GCC", "GCT", "FBC", "FTC", "LTC", "RL", "FRL", "MAPQ", "COV", "GCD"]
    assert "FTC\t24400\t0\t0\t0\t0" in stats and "RL\t50\t488" in stats and "MAPQ\t255\t346" in stats
    assert [x for x in stats if x.startswith("GCF")] == ["GCF\t1.01\t488"] or [x for x in stats if x.startswith("GCF")][0].endswith("\t488")


def test_statistics_formats():
    assert stats.insert_moments([(100, 50), (200, 50), (5000, 1)]) == pytest.approx((150, 50))
    lines = stats.gc_depth_lines([(0.5 * 10, 10), (0.5 * 20, 20), (0.4 * 30, 30), (0.7, 1)], 100.0)
    assert [x.split("\t")[1] for x in lines[1:]] == ["0.0", "0.7", "40.0", "50.0"]
    assert text.shortest(5.0) == "5" and text.shortest(1e-7) == "0.0000001" and text.shortest(0.1) == "0.1"
    bins = [{"lo": -5, "pairs": 1}, {"lo": 0, "pairs": 3}, {"lo": 5, "pairs": 2}]
    assert text.inner_distance_mean(bins, 5, "s").splitlines()[1].split("\t")[:3] == ["s", "3.33333333333333", "2.5"]
    log = text.junction_log({"annotated": (7, 2), "partial_novel": (1, 1)}, 3, "x.gtf")
    assert "Total splicing  Events:\t11\n" in log and "Total splicing  Junctions:\t3\n" in log
    script = text.junction_script({"annotated": (7, 2), "partial_novel": (1, 2)}, 2, "p")
    assert "events=c(10,0,70)" in script and "junction=c(50,0,50)" in script


def test_decoded_records():
    """Names, bases, qualities, CIGARs and tags of records of every length, one after another."""
    letters, kinds = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
    rows = [("a", 0, 5, 3, "ACGTN", [(5, "M")], b"NHC\x02HIc\x01"), ("longer/name", 1, 0, 1027, "A", [(2, "S"), (1, "M"), (70, "N")], b"XXZtext NHC\0NMi\x07\0\0\0"), ("none", -1, -1, 4, "", [], b""), ("b" * 40, 0, 9, 16, "ACGTACGTACG", [(11, "=")], b"XBBc\x02\0\0\0\x01\x02NHS\x2c\x01")]
    data, at = b"", []
    for name, tid, pos, flag, seq, ops, tags in rows:
        codes = [letters.index(x) for x in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(name) + 1, 7, 0, len(ops), flag, len(seq), -1, -1, -12) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | kinds.index(k)) for n, k in ops) + packed + bytes(range(len(seq))) + tags
        at.append(len(data))
        data += struct.pack("<i", len(body)) + body
    columns = [c.to_pylist() for c in bam.decode(data, np.array(at), ["chr1", "chr2"])]
    for k, (name, tid, pos, flag, seq, ops, _) in enumerate(rows):
        chrom = ["chr1", "chr2"][tid] if tid >= 0 else None
        expected = [name, flag, tid, chrom, pos, 7, "".join(f"{n}{x}" for n, x in ops) or "*", -1, None, -1, -12, seq or None, bytes(range(len(seq))) if seq else None]
        assert [c[k] for c in columns[:13]] == expected
    assert columns[13:] == [[2, None, None, 300], [1, None, None, None], [None, 7, None, None]]
