"""Delimited and JSON record sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_records(spark: SparkSession, path: str, *, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header; every column stays text, nothing is inferred."""
    return spark.read.csv(path, header=True, inferSchema=False, encoding=encoding)


def json_records(spark: SparkSession, path: str, schema: str, record_path: str) -> DataFrame:
    """One block per element of the array at ``record_path``: doc_id, record_no, text (the record as JSON)."""
    docs = spark.read.schema(schema).json(path)
    return docs.select("doc_id", F.posexplode(F.col(record_path)).alias("record_no", "record")).select(
        "doc_id", "record_no", F.to_json("record").alias("text")
    )
