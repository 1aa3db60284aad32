"""Tables kept in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost
executor then costs the tasks that it ran, never what came before them.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI; a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="stratalign-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


#: Folders that end with this process.
_OWN: set[str] = set()


def session_root(spark: SparkSession) -> str:
    """This application's folder below the shared one; it is removed when the driver's process ends."""
    path = f"{shared_root(spark)}/stratalign-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    return path


def _remove(jvm, configuration, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        where.getFileSystem(configuration).delete(where, True)
    except Exception as error:  # the process is ending: what is left is said, and does no harm
        print(f"{path} was not removed: {error}", file=sys.stderr)


def release(spark: SparkSession) -> None:
    """Let the executors delete the shuffle files of finished steps, which they keep until the driver's unused objects
    are collected; a driver whose heap has room would keep those of all steps.  What the driver's two processes
    have freed goes back to the system: their allocators would keep it, beside a heap that may still grow."""
    gc.collect()
    spark._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
    _trim_jvm(spark)


def _trim_jvm(spark: SparkSession) -> str | None:
    """jcmd's System.trim_native_heap in the driver's JVM, and what it says; None where a JVM has no such command."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    types, given = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        types[k] = kind(name)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        # By the interface's method: py4j finds none on the server's own class for arguments that are null.
        return kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return None


class Scratch:
    """Named tables below one fresh folder of the session's."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{session_root(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        release(self.spark)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            _remove(self.spark._jvm, self.spark._jsc.hadoopConfiguration(), f"{self.path}/{name}")

    def keep_only(self, *names: str) -> None:
        """Remove all other tables, when the results that are left are written."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.drop(*(s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName() not in names))


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened until df has no such column in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str):
    """The column of this name, whatever characters are in it."""
    return df["`" + name.replace("`", "``") + "`"]


def keep_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed; others may have any name and type."""
    quoted = {new: "`" + old.replace("`", "``") + "`" for new, old in columns.items()}
    return df.select(*(df[old].alias(new) for new, old in quoted.items()))
