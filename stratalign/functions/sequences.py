"""Functions of sequences and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def reverse_complement(seq: Column) -> Column:
    """Bases from the other strand; letters other than A, C, G and T stay."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def java_hash(name: Column) -> Column:
    """The hash code of a Java string of ASCII characters, as an unsigned number: s[0] * 31**(n - 1) + ... modulo 2**32."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda x, y: (x * 31 + y) % (1 << 32))


def java_bucket(name: Column, buckets: int) -> Column:
    """Where a Java hash table of so many buckets (a power of two) holds the name: its iteration order."""
    code = java_hash(name)
    return code.bitwiseXOR(F.shiftright(code, 16)) % buckets
