"""The package reaches workers that were started elsewhere."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_point", sys.argv[1])
entry_point = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry_point)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", entry_point.queries()["index_points"](spark, sys.argv[2]).count())
"""


def test_udfs_run_from_another_folder(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, os.path.join(REPO, "__spark_entry__.py"), sf],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "ROWS" in run.stdout, run.stderr[-2000:]
