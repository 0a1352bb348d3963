"""Partitions leave a table: detached into a folder of their own, attached again, or dropped.

A table's partitions are the folders ``table_name=<table>/partition=<partition>`` below a root, as Spark writes and
discovers them. Each change is one rename or one delete in the store that the path names; only the list of
partitions, as long as tables times months, passes through the driver. Stores without a rename copy instead.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from marginalia.session import hadoop_path

OUTCOME = "table_name string, partition string, action string, outcome string, error string"
NAME = re.compile(r"[\w\-]+")
DROPPING = "_dropping"  # names with an underscore are no data to Spark


def _folder(root: str, table: str, partition: str) -> str:
    for name in (table, partition):
        if not (name and NAME.fullmatch(name)):
            raise ValueError(f"not a plain name: {name!r}")
    return f"{root.rstrip('/')}/table_name={table}/partition={partition}"


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if there is none. An existing target is an error, never merged or replaced."""
    store, old = hadoop_path(spark, source)
    _, new = hadoop_path(spark, target)
    if not store.exists(old):
        return False
    if store.exists(new):
        raise FileExistsError(f"there already: {target}")
    store.mkdirs(new.getParent())
    if not store.rename(old, new):
        raise OSError(f"not renamed: {source}")
    return True


def _drop(spark: SparkSession, source: str, parked: str) -> bool:
    """Take a folder out of the table, then delete it; what an earlier drop left half deleted goes too."""
    store, rest = hadoop_path(spark, parked)
    left = store.exists(rest) and not store.delete(rest, True)
    if left:
        raise OSError(f"not deleted: {parked}")
    if not _move(spark, source, parked):
        return False
    if not store.delete(rest, True):
        raise OSError(f"not deleted: {parked}")
    return True


def apply_expired(spark: SparkSession, expired: DataFrame, root: str, detached: str) -> DataFrame:
    """Carry out what ``expired_partitions`` lists: table_name, partition, action (``detach``, ``drop``, ``attach``).

    Gives each with its outcome: ``done``, ``absent`` (nothing there, as when run a second time) or ``failed`` with
    the error. A failure stops no other partition; the next run tries again. A detached partition lies under the same
    names below ``detached``, from where ``attach`` brings it back; a drop renames the folder first, so that readers
    never see half of it. Partitions that are not listed are not touched. A name that is NULL, empty or not made of
    letters, digits, ``_`` and ``-`` fails; a partition listed twice is treated once.
    """
    outcomes = []
    for row in expired.select("table_name", "partition", "action").distinct().toLocalIterator():
        try:
            inside = _folder(root, row.table_name, row.partition)
            outside = _folder(detached, row.table_name, row.partition)
            if row.action == "detach":
                there = _move(spark, inside, outside)
            elif row.action == "attach":
                there = _move(spark, outside, inside)
            elif row.action == "drop":
                there = _drop(spark, inside, _folder(f"{detached.rstrip('/')}/{DROPPING}", row.table_name, row.partition))
            else:
                raise ValueError(f"no such action: {row.action!r}")
            outcomes.append((*row, "done" if there else "absent", None))
        except (OSError, ValueError, Py4JJavaError) as problem:
            outcomes.append((*row, "failed", str(problem).splitlines()[0]))
    return spark.createDataFrame(outcomes, OUTCOME)
