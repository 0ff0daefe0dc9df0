"""Workers get all code of this package with the jobs: queries run where only the driver can import it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

DIR = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[2]
CODE = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
from stormspan.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
for name in ("op2_substring_dedup", "op3_suffix_dedup", "op4_neighbours", "op6_quality"):
    print(name, queries.queries()[name](spark, {DIR!r}).count() > 0)
"""


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, f"file://{tmp_path}/shared"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("True") == 4
