"""Document versions: re-ingest, the active chunk set, purges, re-embed cut-over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reingest_documents(documents: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """All documents; the named ones start their next version: ``uploaded``, no error."""
    hit = F.col("_hit").isNotNull()
    marked = documents.join(ids.select("doc_id").distinct().withColumn("_hit", F.lit(True)), "doc_id", "left")
    changed = {
        "doc_version": F.when(hit, F.col("doc_version") + 1).otherwise(F.col("doc_version")),
        "status": F.when(hit, F.lit("uploaded")).otherwise(F.col("status")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    if "error" in documents.columns:
        changed["error"] = F.when(~hit, F.col("error"))
    return marked.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns])


def supersede_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """All chunks; every chunk of the named documents is marked superseded."""
    marked = chunks.join(ids.select("doc_id").distinct().withColumn("_hit", F.lit(True)), "doc_id", "left")
    return marked.withColumn("superseded", F.col("superseded") | F.col("_hit").isNotNull()).select(*chunks.columns)


def active_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of each document's current version that are not superseded."""
    current = documents.select(F.col("doc_id").alias("_doc_id"), F.col("doc_version").alias("_version"))
    # no equality of versions: chunks that lie by document already are not shuffled again
    same = (F.col("doc_id") == F.col("_doc_id")) & F.col("doc_version").between(F.col("_version"), F.col("_version"))
    return chunks.filter(~F.col("superseded")).join(current, same, "left_semi")


def purgeable_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Superseded chunks of ``ready`` documents; elsewhere the old version is still the only whole one."""
    ready = documents.filter(F.col("status") == "ready").select("doc_id")
    return chunks.filter("superseded").join(ready, "doc_id", "left_semi")


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_anti")


def reembed_coverage(chunks: DataFrame, documents: DataFrame, vectors: DataFrame, model: str, version: int) -> DataFrame:
    """Share of a knowledge base's active chunks that have a vector of the new version; switch at 100 %."""
    fresh = vectors.filter((F.col("model") == model) & (F.col("embedding_version") == version))
    have = fresh.select("chunk_id").distinct().withColumn("_have", F.lit(1))
    rows = active_chunks(chunks, documents).join(have, "chunk_id", "left")
    return rows.groupBy("tenant_id", "kb_id").agg(
        F.count("*").alias("chunks"), F.count("_have").alias("embedded")
    ).select("*", (F.col("embedded") / F.col("chunks")).alias("coverage"),
             (F.col("embedded") == F.col("chunks")).alias("ready_to_switch"))


def purgeable_documents(documents: DataFrame, kbs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Documents soft-deleted, or inside a knowledge base soft-deleted, longer ago than the grace time."""
    limit = now - F.make_dt_interval(F.lit(days))
    gone = kbs.select("kb_id", F.col("deleted_at").alias("_kb_deleted"))
    return documents.join(gone, "kb_id", "left").filter(
        (F.col("deleted_at") < limit) | (F.col("_kb_deleted") < limit)
    ).select(*documents.columns)
