"""The registry without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
queries, oracles = entry.queries(), entry.oracle_sql()
assert queries and not [n for n in queries if n.startswith("op") or n == "pipeline"], sorted(queries)
assert set(oracles) <= set(queries)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", queries["bam_stat"](spark, "/root/testdata/sf0.001").count())
"""


def test_registry_without_corpus_operators(tmp_path):
    """With their folders gone, with or without the pipeline's file, the rest imports and runs."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and "rows" in done.stdout, done.stderr
        if (copy / "corpus_pipeline.py").exists():
            (copy / "corpus_pipeline.py").unlink()
