"""Partitions are detached, attached and dropped as folders; all others stay as they are, byte for byte."""

import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from marginalia.operators.partitions import DROPPING, apply_expired

ROWS = "table_name string, partition string, action string"


def _bytes(folder):
    return {str(f.relative_to(folder)): hashlib.sha256(f.read_bytes()).hexdigest() for f in sorted(folder.rglob("*.parquet"))}


@pytest.fixture()
def store(spark, tmp_path):
    root, out = tmp_path / "root", tmp_path / "out"
    names = F.concat(F.lit("2024_0"), (F.col("id") % 5 + 1).cast("string"))
    spark.range(50).select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("table_name"), names.alias("partition")).write.partitionBy(
        "table_name", "partition").parquet(str(root))

    def run(*rows):
        done = apply_expired(spark, spark.createDataFrame(list(rows), ROWS), str(root), str(out))
        return {(r.table_name, r.partition): (r.outcome, r.error) for r in done.collect()}
    return root, out, run


def test_detach_attach_and_again(spark, store):
    root, out, run = store
    before = _bytes(root)
    assert run(("a", "2024_01", "detach"), ("b", "2024_02", "detach"), ("a", "2024_01", "detach")) == {
        ("a", "2024_01"): ("done", None), ("b", "2024_02"): ("done", None)}
    moved = {k for k in before if k.startswith(("table_name=a/partition=2024_01/", "table_name=b/partition=2024_02/"))}
    assert _bytes(root) == {k: v for k, v in before.items() if k not in moved}
    assert _bytes(out) == {k: before[k] for k in moved}
    assert spark.read.parquet(str(root)).count() == 40 and spark.read.parquet(str(out)).count() == 10
    assert run(("a", "2024_01", "detach")) == {("a", "2024_01"): ("absent", None)}
    assert run(("a", "2024_01", "attach"), ("b", "2024_02", "attach")) == {("a", "2024_01"): ("done", None), ("b", "2024_02"): ("done", None)}
    assert _bytes(root) == before


def test_one_failure_stops_no_other(store):
    root, out, run = store
    here, there = (f / "table_name=a" / "partition=2024_01" for f in (root, out))
    shutil.copytree(here, there)  # detached once, and written anew since
    both = _bytes(here), _bytes(there)
    got = run(("a", "2024_01", "detach"), ("a", "2024_02", "detach"), ("a", "../b", "drop"), (None, "2024_01", "drop"),
              ("b", "2024_03", "burn"), ("b", "2024_09", "drop"))
    assert {k: v[0] for k, v in got.items()} == {
        ("a", "2024_01"): "failed", ("a", "2024_02"): "done", ("a", "../b"): "failed", (None, "2024_01"): "failed",
        ("b", "2024_03"): "failed", ("b", "2024_09"): "absent"}
    assert "there already" in got["a", "2024_01"][1] and (_bytes(here), _bytes(there)) == both


def test_drop_goes_on_after_a_stop(store):
    root, out, run = store
    before = _bytes(root)
    half = out / DROPPING / "table_name=a" / "partition=2024_04"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"left over")
    assert run(("a", "2024_04", "drop")) == {("a", "2024_04"): ("done", None)}
    assert _bytes(root) == {k: v for k, v in before.items() if "table_name=a/partition=2024_04/" not in k} and _bytes(out) == {}
    assert run(("a", "2024_04", "drop")) == {("a", "2024_04"): ("absent", None)}


def test_nothing_listed(store):
    root, _, run = store
    before = _bytes(root)
    assert run() == {} and _bytes(root) == before
