"""Queries run on workers that cannot import the repository: functions and models travel with the job."""

import os
import subprocess
import sys

from tests.conftest import DATA

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from marginalia.llm import queries
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {shared!r}).getOrCreate())

def importable(_):
    import importlib.util
    yield importlib.util.find_spec("marginalia") is not None

assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
for name, query in queries.QUERIES.items():
    if name.split("_")[0] in ("op3", "op4", "op5", "op6", "op8", "op10", "op11", "op12", "op13"):
        assert query(spark, {data!r}).count() > 0, name
print("all ran")
"""


def test_workers_need_no_install(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = SCRIPT.format(repo=repo, shared=str(tmp_path / "shared"), data=DATA)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]
