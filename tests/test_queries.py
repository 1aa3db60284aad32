"""Registered queries against their SQL, where the tables are at hand."""

import functools
import math
import os

import pytest
from pyspark.sql import DataFrame, functions as F

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
NAMES = ["dup_matrix", "read_status", "biotype_status", "bam_stat", "coverage_hist", "region_subtract", "junction_saturation", "pair_gene_vote", "inner_distance", "tin_score", "prime_bias"]

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(TABLES):
        db.execute(f"create view {file[:-8]} as select * from '{TABLES}/{file}'")
    df = entry.queries()[name](spark, TABLES)
    found = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


#: Orders beyond 2^22, so far that places, mates and the order of junctions stay what they are.
FAR = 40 * 1_000_003
BY_READ = ["dup_matrix", "dup_matrix_stats", "biotype_counts", "biotype_status", "dup_curve", "expr_hist", "fit_intercept_slope", "fragment_origin", "fragment_origin_stranded", "fragment_origin_totals", "fragment_strand_votes", "gene_enclosure", "intron_touch", "junction_saturation", "read_distribution", "read_origin", "rpk_quantile_bins", "rpkm_threshold", "stranded_hits", "strandedness"]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("far")
    spark.read.parquet(f"{TABLES}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + FAR).write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{TABLES}/part.parquet").write.parquet(f"{folder}/part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", BY_READ)
def test_large_order_keys(spark, far, name):
    here, there = ([tuple(plain(v) for v in r) for r in entry.queries()[name](spark, d).collect()] for d in (TABLES, far))
    assert sorted(here, key=repr) == sorted(there, key=repr)


def test_large_part_keys_tell_reads_apart(spark, tmp_path):
    row = spark.read.parquet(f"{TABLES}/lineitem.parquet").filter("l_tax < 0.065").limit(1)
    keys = [row.withColumns({"l_orderkey": F.lit(a).cast("long"), "l_partkey": F.lit(b).cast("long"), "l_suppkey": F.lit(c).cast("long")}) for a, b, c in ((1, 1 << 18, 5), (2, 0, 5), (1, 7, 1 << 14), (1, 8, 0))]
    functools.reduce(DataFrame.unionByName, keys).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{TABLES}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    assert entry.queries()["fragment_status"](spark, str(tmp_path)).first()["fragments"] == 4


def test_read_numbers_of_any_size(spark, far):
    near, wide = (entry.queries()["cigar_blocks"](spark, d) for d in (TABLES, far))
    assert dict(near.dtypes)["rid"] == "bigint" and dict(wide.dtypes)["rid"] == "decimal(38,0)"
    shifted = {(r.rid + FAR * 2**41, r.s, r.e) for r in near.collect()}
    assert {(int(r.rid), r.s, r.e) for r in wide.collect()} == shifted


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Twice the tables, the copy's keys shifted as at 60 times sf0.1: orders from 2^23, parts from 2^20, suppliers from 2^15."""
    folder = tmp_path_factory.mktemp("wide")
    for name, shifts in (("lineitem", {"l_orderkey": 1 << 23, "l_partkey": 1 << 20, "l_suppkey": 1 << 15}), ("part", {"p_partkey": 1 << 20})):
        df = spark.read.parquet(f"{TABLES}/{name}.parquet")
        df.unionByName(df.withColumns({k: F.col(k) + v for k, v in shifts.items()})).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in BY_READ if n in entry.oracle_sql()])
def test_wide_keys_equal_sql(spark, wide, name):
    """The SQL's number of a read with room for any key, else as it is."""
    duckdb = pytest.importorskip("duckdb")
    from stratalign.plans.harness import _RID

    db = duckdb.connect()
    for table in ("lineitem", "part"):
        db.execute(f"create view {table} as select * from '{wide}/{table}.parquet/*.parquet'")
    sql = entry.oracle_sql()[name]
    assert _RID in sql
    df, found = entry.queries()[name](spark, wide), db.execute(sql.replace(_RID, "((((qname::hugeint * 2097152 + pk) * 65536 + sk) * 8 + ln) * 64 + len - 20)"))
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(plain(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
