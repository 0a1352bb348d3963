"""Writes: append-only ledgers, keyed upserts, replace-by-key, versioned artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTEFACT_VERSION = 1
BLOCK_TYPES = ("paragraph", "heading", "table", "code", "caption")
ARTEFACT = T.StructType([
    T.StructField("format_version", T.IntegerType()),
    T.StructField("doc_meta", T.StructType([T.StructField("block_count", T.LongType())])),
    T.StructField("blocks", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("order", T.LongType()), T.StructField("page", T.LongType()),
        T.StructField("heading_path", T.ArrayType(T.StringType())),
    ]))),
])


def append_by_month(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append ledger rows to a table partitioned by UTC month (``yyyy_MM``)."""
    df.withColumn("month", F.date_format(ts, "yyyy_MM")).write.mode("append").partitionBy("month").parquet(path)


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """Merge ``changes`` into ``current``, last write wins; NULL keys are equal to each other.

    One aggregation keeps the newest row of every key, combined map-side, so a key written a million
    times sends one row per map task. ``order`` ranks the changes among themselves.
    """
    rest = [c for c in current.columns if c not in key]
    rank = order if order is not None else F.lit(0)
    old = current.select(*current.columns, F.lit(0).alias("_new"), F.lit(None).cast("string").alias("_rank"))
    new = changes.select(*current.columns, F.lit(1).alias("_new"), rank.alias("_rank"))
    old = old.withColumn("_rank", F.lit(None).cast(new.schema["_rank"].dataType))
    kept = F.max_by(F.struct(*rest), F.struct("_new", "_rank")).alias("_row")
    return old.unionByName(new).groupBy(*key).agg(kept).select(*key, "_row.*").select(*current.columns)


def replace_for_keys(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Drop every row of the keys present in ``fresh`` and add ``fresh``; a rerun changes nothing."""
    touched = fresh.select(*keys).distinct()
    return current.join(touched, keys, "left_anti").unionByName(fresh)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def artefacts(blocks: DataFrame) -> DataFrame:
    """One JSON text per cleaned document, with the format version it was written in."""
    entry = F.struct(
        F.col("block_order").cast("long").alias("order"), "type", "text", F.col("page").cast("long").alias("page"),
        F.col("heading_path"),
    )
    ordered = F.array_sort(F.collect_list(entry))
    shaped = F.transform(
        ordered, lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["order"].alias("order"),
                                    b["page"].alias("page"), b["heading_path"].alias("heading_path"))
    )
    return blocks.groupBy("doc_id").agg(shaped.alias("blocks")).select(
        "doc_id",
        F.to_json(F.struct(
            F.lit(ARTEFACT_VERSION).alias("format_version"),
            F.struct(F.size("blocks").cast("long").alias("block_count")).alias("doc_meta"), "blocks",
        )).alias("artefact"),
    )


def read_artefacts(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the usable artefacts, and the documents whose artefact must be computed again."""
    parsed = stored.select("doc_id", F.from_json("artefact", ARTEFACT).alias("a"))
    sound = F.forall(
        F.col("a.blocks"),
        lambda b: b["type"].isin(*BLOCK_TYPES) & b["text"].isNotNull() & b["order"].isNotNull(),
    )
    usable = (F.col("a.format_version") == ARTEFACT_VERSION) & F.col("a.blocks").isNotNull() & sound
    marked = parsed.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    blocks = marked.filter("_ok").select("doc_id", F.explode("a.blocks").alias("b")).select(
        "doc_id", F.col("b.order").alias("block_order"), "b.type", "b.text", "b.page", "b.heading_path"
    )
    return blocks, marked.filter("not _ok").select("doc_id")
