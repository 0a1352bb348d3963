"""Table scans and the row views every read goes through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import is_directory


# Tables whose rows are costly to work on (texts, vectors).
HEAVY = ("documents", "pages", "conversations", "embeddings")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the store. A heavy one that arrives in fewer splits than there are cores is spread out;
    at scale it has far more splits than cores and is left where it is."""
    rows = spark.read.parquet(f"{base}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in HEAVY and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def stream_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The same table as a file stream; its schema is read from the files that are there."""
    reader = spark.readStream.schema(table(spark, base, name).schema)
    path = f"{base}/{name}.parquet"
    if is_directory(spark, path):
        return reader.parquet(path)
    # a file stream watches a folder, so a table that is one file is picked out of its folder by name
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)


def tenant_view(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant. A missing tenant is an error, never "all rows"."""
    if tenant is None or tenant == "":
        raise ValueError("a tenant is required for this read")
    return df.filter(F.col(column) == F.lit(tenant))


def live_view(df: DataFrame, *, including_deleted: bool = False) -> DataFrame:
    """Rows that are not soft-deleted; ``including_deleted`` is the explicit way around it."""
    return df if including_deleted else df.filter(F.col("deleted_at").isNull())


def shared_view(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """A tenant's own rows plus the system rows that belong to no tenant."""
    if not tenant:
        raise ValueError("a tenant is required for this read")
    return df.filter((F.col(column) == F.lit(tenant)) | F.col(column).isNull())


def newer_than(df: DataFrame, watermark: Column | None, column: str = "updated_at") -> DataFrame:
    """Incremental pull: rows strictly newer than the stored watermark (all rows if there is none)."""
    return df if watermark is None else df.filter(F.col(column) > watermark)


def next_watermark(df: DataFrame, keys: list[str], column: str = "updated_at") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(column).alias("watermark"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Compare two snapshots of a source: ``new`` / ``changed`` / ``deleted`` / ``same`` per key."""
    before = old.select(*key, F.col(digest).alias("_before"), F.lit(True).alias("_old"))
    after = new.select(*key, F.col(digest).alias("_after"), F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("_before").eqNullSafe(F.col("_after")), "same")
        .otherwise("changed")
    )
    return before.join(after, key, "full_outer").select(*key, change.alias("change"))
