"""What kind of file a path names, by its first bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

GZIP = b"\x1f\x8b"


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The first n bytes of the first file that the path names; no more than those are read, from any file system that
    Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(where)
    if found is None or not len(found):
        raise FileNotFoundError(path)
    stream = system.open(found[0].getPath())
    try:
        read = [stream.read() for _ in range(n)]
    finally:
        stream.close()
    return bytes(b for b in read if b >= 0)
