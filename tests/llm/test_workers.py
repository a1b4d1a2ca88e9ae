"""Queries whose workers can't import the package: everything they need must travel with the job."""

import os
import subprocess
import sys

from ..conftest import ROOT, SF001

SCRIPT = f"""
import os, sys
sys.path.insert(0, {ROOT!r})  # of the driver only: workers run elsewhere and don't get it
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()

def lost(_):
    try:
        import panelspark
    except ModuleNotFoundError:
        return [True]
    return [False]

assert spark.sparkContext.parallelize([1], 1).mapPartitions(lost).collect() == [True], "the workers found the package"
from panelspark.llm import queries
for name in ("op1_token_counts", "op5_decontamination", "op8_language_id", "op11_embedding_whitening", "op12_spelling_variants"):
    assert queries.QUERIES[name](spark, {SF001!r}).count() > 0
print("ALL RAN")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ALL RAN" in out.stdout, out.stderr[-3000:]
