"""Executors need no copy of the package: every query runs where workers can't import it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
try:
    spark.range(1).mapInPandas(lambda b: (__import__("scholarflow") and x for x in b), "id long").collect()
    print("VISIBLE")
except Exception:
    pass
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        print("DONE", name, len(query(spark, {sf!r}).collect()), flush=True)
"""


def test_queries_run_where_workers_lack_the_package(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), sf=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    done = [line.split()[1] for line in run.stdout.splitlines() if line.startswith("DONE")]
    assert "VISIBLE" not in run.stdout
    assert run.returncode == 0, run.stderr[-3000:]
    assert {f"op{k}" for k in range(1, 14)} <= {n.split("_")[0] for n in done} and "pipeline" in done
