"""CIGAR strings as arrays of (len, op), and one walk over them with sets of operations as parameters.

The analyses walk the same string by five rules that differ in which operations
give a block and which advance the reference; each rule is a named pair of sets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Walk:
    emit: str
    advance: str


#: Blocks on aligned bases; deletions and introns advance.
ALIGNED = Walk("M=X", "M=XDN")
#: Exon rule: M alone gives a block; soft clips advance, = and X do not.
EXONS = Walk("M", "MDNS")
#: Introns: N alone, advancing over M, D and N.
INTRONS = Walk("N", "MDN")
#: Position key of duplicates.
POSITION_KEY = Walk("M=X", "M=XDNS")
#: Gene-body rule: insertions and soft clips advance too.
GENE_BODY = Walk("M", "M=XDNIS")


def parse(cigar: Column) -> Column:
    """array<struct<len,op>> of a CIGAR string; '*' gives an empty array."""
    cigar = F.coalesce(cigar, F.lit(""))
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(lens, ops, lambda n, op: F.struct(n.cast("long").alias("len"), op.alias("op")))


def _among(op: Column, ops: str) -> Column:
    return op.isin(*list(ops))


def blocks(ops: Column, pos: Column, walk: Walk = ALIGNED) -> Column:
    """array<struct<s,e>>, half-open, of the operations that the walk emits."""
    kind = "array<struct<s:bigint,e:bigint>>"
    start = F.struct(pos.cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["len"]
        block = F.array(F.struct(acc["at"].alias("s"), end.alias("e")))
        return F.struct(F.when(_among(x["op"], walk.advance), end).otherwise(acc["at"]).alias("at"), F.when(_among(x["op"], walk.emit), F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def length_of(ops: Column, kinds: str) -> Column:
    """Sum of the lengths of some operations."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda acc, x: acc + F.when(_among(x["op"], kinds), x["len"]).otherwise(F.lit(0)))


def query_aligned_length(ops: Column) -> Column:
    return length_of(ops, "MI=X")


def intron_bases(ops: Column) -> Column:
    return length_of(ops, "N")


def reference_end(ops: Column, pos: Column) -> Column:
    return pos + length_of(ops, "MDN=X")


def is_spliced(ops: Column) -> Column:
    return F.exists(ops, lambda x: x["op"] == "N")


def indels(ops: Column) -> Column:
    """array<struct<op,len,cycle>> of insertions and deletions, with the read cycle before each."""
    kind = "array<struct<op:string,len:bigint,cycle:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("cycle"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["cycle"].alias("cycle")))
        moved = F.when(_among(x["op"], "MIS=X"), acc["cycle"] + x["len"]).otherwise(acc["cycle"])
        return F.struct(moved.alias("cycle"), F.when(_among(x["op"], "ID"), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def junction_sites(ops: Column, pos: Column) -> Column:
    """array<struct<seq_pos,s,e>>: introns with the query offset at which they lie."""
    kind = "array<struct<seq_pos:bigint,s:bigint,e:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("seq"), pos.cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct(acc["seq"].alias("seq_pos"), acc["at"].alias("s"), (acc["at"] + x["len"]).alias("e")))
        return F.struct(
            F.when(_among(x["op"], "MIS=X"), acc["seq"] + x["len"]).otherwise(acc["seq"]).alias("seq"),
            F.when(_among(x["op"], "MDN=X"), acc["at"] + x["len"]).otherwise(acc["at"]).alias("at"),
            F.when(x["op"] == "N", F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["out"])
