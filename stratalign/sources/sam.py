"""SAM text as DataFrames.  Positions become 0-based; a missing value is null, a missing reference tid -1."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from stratalign.functions import cigar as cg
from stratalign.sources.probe import first_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What every alignment source gives.
ALIGNMENTS_DDL = (
    "file_order struct<file:string,start:bigint,row:bigint>, qname string, flag int, tid int, chrom string, pos bigint, mapq int, cigar string, "
    "mtid int, mate_chrom string, mpos bigint, tlen bigint, seq string, qual binary, nh int, hi int, nm int"
)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """tid, name, length of the @SQ lines in their order; headers are bounded, so one window orders them."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@SQ")).withColumn("row", F.monotonically_increasing_id())
    named = lines.select("row", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    rows = [(k, r["name"], r["length"]) for k, r in enumerate(named.orderBy("row").collect())]
    return spark.createDataFrame(rows, "tid int, name string, length long")


def _tag(name: str) -> Column:
    return F.try_element_at(F.regexp_extract_all("value", F.lit(rf"\t{name}:[iIcCsS]:(-?\d+)"), F.lit(1)), F.lit(1)).cast("int")


#: Quality characters are 33 above their values.  Spark's own translate deletes what would become the value 0.
_SHIFT = bytes(max(0, b - 33) for b in range(256))


@F.pandas_udf(BinaryType())
def _values(quals: pd.Series) -> pd.Series:
    return quals.map(lambda q: None if q is None else q.encode().translate(_SHIFT))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM file, with the parsed CIGAR in ops."""
    header = read_header(spark, path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.filter(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("row", F.monotonically_increasing_id())
    part = F.split("value", "\t")
    star = lambda k: F.when(part[k] != "*", part[k])
    mate = F.when(part[6] == "=", part[2]).when(part[6] != "*", part[6])
    rows = lines.select(
        F.struct("file", "start", "row").alias("file_order"),
        part[0].alias("qname"),
        part[1].cast("int").alias("flag"),
        star(2).alias("chrom"),
        (part[3].cast("long") - 1).alias("pos"),
        part[4].cast("int").alias("mapq"),
        part[5].alias("cigar"),
        mate.alias("mate_chrom"),
        (part[7].cast("long") - 1).alias("mpos"),
        part[8].cast("long").alias("tlen"),
        star(9).alias("seq"),
        star(10).alias("quals"),
        _tag("NH").alias("nh"),
        _tag("HI").alias("hi"),
        _tag("NM").alias("nm"),
    )
    names = {r["name"]: r["tid"] for r in header.collect()}
    number = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,int>")
    rows = rows.withColumns({"tid": F.coalesce(F.try_element_at(number, "chrom"), F.lit(-1)), "mtid": F.coalesce(F.try_element_at(number, "mate_chrom"), F.lit(-1)), "qual": _values("quals")})
    columns = [f.split()[0] for f in ALIGNMENTS_DDL.replace("struct<file:string,start:bigint,row:bigint>", "x").split(", ")]
    return rows.select(*columns).withColumn("ops", cg.parse(F.col("cigar")))


def with_lengths(alignments: DataFrame) -> DataFrame:
    """Adds len, upper-case chrom_u, and blocks by the standard rule."""
    length = F.coalesce(F.length("seq"), cg.query_aligned_length(F.col("ops")))
    return alignments.withColumns({"len": length.cast("long"), "chrom_u": F.upper("chrom"), "blocks": cg.blocks(F.col("ops"), F.col("pos")), "spliced": cg.is_spliced(F.col("ops"))})


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """SAM or BAM, by the file's first bytes; CRAM has no reader here and is refused."""
    from .bam import read_bam

    head = first_bytes(spark, path, 4)
    if head == b"CRAM":
        raise ValueError(f"{path}: CRAM needs a reference-based decoder, which is not part of this library; convert it to BAM")
    return read_bam(spark, path) if head[:2] == b"\x1f\x8b" else read_sam(spark, path)
