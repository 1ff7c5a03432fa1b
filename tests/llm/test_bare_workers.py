"""Python workers that cannot import the package still run what it sends them."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import importlib, os, sys
os.environ["PYTHONPATH"] = ""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def importable(batches):
    import importlib.util
    import pandas as pd
    for _ in batches:
        yield pd.DataFrame({"found": [importlib.util.find_spec("cellgrid") is not None]})

assert not any(r.found for r in spark.range(4).mapInPandas(importable, "found boolean").collect())
sys.path.insert(0, REPO)
import __spark_entry__ as entry
print("ROWS", entry.queries()[NAME](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("name", ["op1_toxicity", "op9_bpe_round_trip", "pipeline"])
def test_workers_without_the_package(name, tmp_path):
    code = SCRIPT.replace("REPO", repr(REPO)).replace("NAME", repr(name))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in said.stdout, said.stderr[-3000:]
