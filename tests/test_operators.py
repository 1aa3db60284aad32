"""Single operators against worked examples and naive versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalign.functions import cigar as cg
from stratalign.operators import intervals as iv, sequences as sq
from stratalign.plans import complexity as cx, coverage as cv, pairs as pr
from stratalign.sinks import text


def frame(spark, rows, ddl="chrom string, s long, e long"):
    return spark.createDataFrame(rows, ddl)


def pairs_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize(
    ("cigar", "pos", "walk", "expected"),
    [
        ("50M500N50M", 100, cg.INTRONS, [(150, 650)]),
        ("10M500N20M300N10M", 100, cg.INTRONS, [(110, 610), (630, 930)]),
        ("10M5D10M500N10M", 100, cg.INTRONS, [(125, 625)]),
        ("5S50M500N50M", 100, cg.INTRONS, [(150, 650)]),
        ("10M500N20M", 1000, cg.POSITION_KEY, [(1000, 1010), (1510, 1530)]),
        ("5S50M500N20M3D30M", 100, cg.ALIGNED, [(100, 150), (650, 670), (673, 703)]),
        ("5S10M", 100, cg.EXONS, [(105, 115)]),
        ("10M5I10M", 100, cg.GENE_BODY, [(100, 110), (115, 125)]),
        ("10=10X", 100, cg.EXONS, []),
        ("*", 100, cg.ALIGNED, []),
    ],
)
def test_cigar_walks(spark, cigar, pos, walk, expected):
    row = spark.range(1).select(cg.blocks(cg.parse(F.lit(cigar)), F.lit(pos), walk).alias("x")).first()
    assert [(b["s"], b["e"]) for b in row["x"]] == expected


def test_merge_and_subtract(spark):
    a = frame(spark, [("c", 10, 20), ("c", 15, 25), ("c", 30, 40)])
    assert pairs_of(iv.merge(a), "s", "e") == [(10, 25), (30, 40)]
    assert pairs_of(iv.subtract(frame(spark, [("c", 10, 50)]), frame(spark, [("c", 20, 30)])), "s", "e") == [(10, 20), (30, 50)]
    assert pairs_of(iv.merge(frame(spark, [("c", 1, 5), ("c", 5, 9)])), "s", "e") == [(1, 9)]
    assert iv.merge(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("p", "inside"), [(10, False), (11, True), (19, True), (20, False)])
def test_strict_stab(spark, p, inside):
    points = spark.createDataFrame([("c", p)], "chrom string, p long")
    assert (iv.stab_join(points, frame(spark, [("c", 10, 20)]), ["chrom"], strict=True).count() == 1) is inside


@pytest.mark.parametrize(("query", "bases"), [((150, 350), 100), ((200, 300), 0)])
def test_exonic_bases(spark, query, bases):
    found = iv.bases_within(spark.createDataFrame([("q", "c", *query)], "row string, chrom string, s long, e long"), frame(spark, [("c", 100, 200), ("c", 300, 400)]), ["chrom"], "row").collect()
    assert (found[0]["bases"] if found else 0) == bases


@pytest.mark.parametrize("closed", [False, True])
def test_joins_equal_nested_loops(spark, closed):
    random.seed(3)
    draw = lambda n, width: [("ab"[random.randrange(2)], s := random.randrange(3000), s + random.randint(1, width)) for _ in range(n)]  # noqa: E731, F841
    left, right = draw(120, 300), draw(120, 900)
    got = pairs_of(iv.overlap_join(frame(spark, left), frame(spark, right), ["chrom"], size=128, closed=closed), "chrom", "s", "e", "r_s", "r_e")
    meets = (lambda a, b: a[1] <= b[2] and b[1] <= a[2]) if closed else (lambda a, b: a[1] < b[2] and b[1] < a[2])
    assert got == sorted((a[0], a[1], a[2], b[1], b[2]) for a in left for b in right if a[0] == b[0] and meets(a, b))


def test_spread_rows_are_not_broadcast_unmeasured(spark):
    genes = frame(spark, [("a", 40 * i, 40 * i + 100) for i in range(20)]).withColumn("gene_id", F.col("s"))
    blocks = frame(spark, [("a", 10 * i, 10 * i + 30) for i in range(60)])
    slots = cv.slot_depth(cv.sampling_grid(genes, 10, 30), blocks, ["chrom"], "gene_id")
    met = slots._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in met and "strategy=broadcast" not in met
    expected = {(40 * g, k, sum(10 * i <= 40 * g + 10 * k < 10 * i + 30 for i in range(60))) for g in range(20) for k in range(10)}
    assert {tuple(r) for r in slots.collect()} == expected


@pytest.mark.parametrize("few", [0, 100_000])
def test_joins_by_either_way_agree(spark, monkeypatch, few):
    monkeypatch.setattr(iv, "FEW", few)
    left = [(c, s, s + n) for c in "ab" for s in range(0, 600, 7) for n in (1, 90)]
    right = [(c, s, s + n) for c in "ab" for s in range(3, 600, 31) for n in (5, 200)]
    found = iv.overlap_join(frame(spark, left), frame(spark, right), ["chrom"])
    assert ("strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()) == (few == 0)
    expected = sorted((c, a, z, s, e) for c, a, z in left for d, s, e in right if c == d and a < e and s < z)
    assert sorted(tuple(r) for r in found.select("chrom", "s", "e", "r_s", "r_e").collect()) == expected


@pytest.mark.parametrize("tile", [None, 64])
def test_depth_equals_counting(spark, tile):
    random.seed(5)
    rows = [("c", s := random.randrange(500), s + random.randint(1, 120)) for _ in range(60)]
    depth = np.zeros(700, int)
    for _, s, e in rows:
        depth[s:e] += 1
    got = {r["depth"]: r["positions"] for r in iv.depth_histogram(frame(spark, rows), tile=tile).collect()}
    assert got == {int(d): int(n) for d, n in zip(*np.unique(depth[depth > 0], return_counts=True), strict=True)}


def test_distance_histogram(spark):
    rows = spark.createDataFrame([(d,) for d in (-5, -3, 0, 2, 7, 12)], "dist long")
    assert [r["pairs"] for r in pr.distance_histogram(rows, -10, 15, 5).orderBy("lo").collect()] == [1, 2, 1, 1, 1]


@pytest.mark.parametrize(("depths", "tin"), [([10] * 10, 100), ([10] * 5 + [0] * 5, 50), ([10, 0, 0, 0, 0], 20), ([0] * 4, 0)])
def test_integrity(spark, depths, tin):
    slots = spark.createDataFrame([("t", k, d) for k, d in enumerate(depths)], "tx string, slot int, depth long")
    assert cv.integrity(slots, "tx").first()["tin"] == pytest.approx(tin)


def test_integrity_of_short_transcripts(spark):
    """A boundary that stands in the grid twice counts once in the coverage and twice in the number of slots."""
    slots = spark.createDataFrame([("t", k, 5 if k < 5 else 1) for k in range(10)], "tx string, slot int, depth long")
    sizes = spark.createDataFrame([("t", 12)], "tx string, slots int")
    assert cv.integrity(slots, "tx", sizes).first()["tin"] == pytest.approx(65.38, abs=0.01)


@pytest.mark.parametrize(("exons", "n", "size"), [([(100, 110)], 5, 6), ([(100, 105), (200, 205)], 10, 12), ([(100, 103)], 100, 5)])
def test_integrity_grid(spark, exons, n, size):
    df = spark.createDataFrame([([{"s": s, "e": e} for s, e in exons],)], "x array<struct<s:bigint,e:bigint>>")
    grid = df.select(cv.exonic_grid(F.col("x"), n).alias("g")).first()["g"]
    assert len(grid) == size
    if exons == [(100, 110)]:
        assert grid == [101, 103, 105, 107, 109, 110]


def test_coverage_profile(spark):
    depth = spark.createDataFrame([("t", 0, 150, 1)], "tx string, s long, e long, depth long")
    lengths = spark.createDataFrame([("t", 150)], "tx string, length long")
    rows = cv.coverage_profile(depth, lengths, "tx").collect()
    assert len(rows) == 75
    assert {r["depth"] for r in rows} == {2}


def test_saturation_and_ranks(spark):
    rows = spark.createDataFrame([(k, k % 7) for k in range(100)], "id long, j long")
    got = {r["pct"]: r["n"] for r in sq.saturation(rows, ["j"], (F.col("id"),), [1, 5, 100]).collect()}
    assert got == {1: 1, 5: 5, 100: 7}
    assert sorted(r["rn"] for r in sq.ranked(rows, (F.col("id"),)).collect()) == list(range(1, 101))


def test_complexity_numbers():
    assert cx.power_series([(1, 100), (2, 50), (3, 25)], 3) == [100, -50, 25]
    assert float(cx.evaluate(np.array([100, 0.5]), 1.0, 2)) == pytest.approx(66.667, rel=1e-4)
    series = [3.0, -1.0, 0.5, -0.1]
    fraction = cx.continued_fraction(series)
    t = 1e-3
    assert float(cx.evaluate(fraction, t, 4)) == pytest.approx(sum(c * t**k for k, c in enumerate(series)), rel=1e-9)
    histogram = [(1, 23425), (2, 443), (3, 69), (4, 28), (5, 14), (6, 5), (8, 3), (9, 2), (10, 1), (18, 1)]
    assert sum(j * n for j, n in histogram) == 24800
    assert cx.first_gap(histogram) == 7
    assert cx.estimate(histogram, bootstraps=0) == []
    assert 11700 < cx.interpolate(histogram, 24800, 23991, 12000) < 11800
    curve = cx.estimate(histogram, step=1e6, maximum=3e6, bootstraps=20, seed=1)
    assert 350_000 < curve[0][1] < 900_000
    assert curve[0][2] <= curve[0][1] <= curve[0][3]
    with pytest.raises(ValueError, match="few"):
        cx.estimate([(1, 3)])


def test_number_format():
    assert [text.number15(x) for x in (0.2, 110.926234054354, math.nan, 0, 1e-20, 123456789.0)] == ["0.2", "110.926234054354", "NA", "0", "1e-20", "123456789"]


def test_stream_counters(spark, tmp_path):
    from stratalign.plans import statistics as st
    from stratalign.streaming import incremental

    rows = spark.createDataFrame([(1024, 40, False), (4, 0, False), (16, 60, True), (0, 10, False)], "flag int, mapq int, spliced boolean")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.stream_counters(stream, str(tmp_path / "out")).awaitTermination(120)
    assert incremental.counters(spark, str(tmp_path / "out")).first().asDict() == st.bam_stat(rows).first().asDict()


def test_equal_stems_are_refused(spark):
    from stratalign.plans import run

    with pytest.raises(ValueError, match="equal names"):
        run.run(spark, ["a/x.sam", "b/x.bam"], "g.gtf", run.Params())
