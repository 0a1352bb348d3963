"""Raw document bytes by object key, and the check that keys stay inside their tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = r"tenant-([^/]+)/kb/([^/]+)/([^/]+)$"


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """Every object below ``root`` whose key is ``tenant-{tenant}/kb/{kb}/{doc}``.

    One object is one row; objects are bounded by the intake size cap, and a reader that does not use
    ``content`` never loads it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    keyed = files.filter(F.col("path").rlike(KEY))
    return keyed.select(
        F.regexp_extract("path", KEY, 1).alias("tenant_id"), F.regexp_extract("path", KEY, 2).alias("kb_id"),
        F.regexp_extract("path", KEY, 3).alias("doc_id"), "content", "length",
    )


def foreign_keys(objects: DataFrame) -> DataFrame:
    """Rows whose object key does not start with the prefix of the tenant that owns the row."""
    prefix = F.concat(F.lit("tenant-"), F.col("tenant_id"), F.lit("/"))
    return objects.filter(~F.coalesce(F.startswith(F.col("storage_key"), prefix), F.lit(False)))
