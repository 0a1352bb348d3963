"""Exact duplicates by an extendible-hash index kept in shared files.

The index has one entry per different text. Its directory maps the leading bits of a key to a bucket; it is
doubled until no bucket is overfull, and only overfull buckets are split. Buckets are stored in key order,
ranges of them written by one owner task each. Texts with the same key are chained: they were told apart by
all their bytes, never by the key alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import materialise, scratch_path

#: Entries of a bucket, at most, unless they all have one key.
CAPACITY = 4096
#: Buckets written by one owner task.
OWNED = 16


def normal(text: Column) -> Column:
    """Runs of blanks become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for each slot in use of a directory of the returned depth.

    A bucket is the shortest prefix with at most ``capacity`` different keys below it, and its number the
    first slot below it. The directory starts a few doublings beyond an even spread and is doubled again
    while a bucket overflows.
    """
    keys = entries.select("key").distinct()
    depth = min(63, max(0, math.ceil(math.log2(max(1, entries.count()) / capacity))) + 3)
    while True:
        slots = materialise(keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n")), "hash-slots")
        if depth == 63 or slots.filter(F.col("n") > capacity).isEmpty():
            break
        depth = min(63, depth + 2)
    prefixes = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    prefixes = prefixes.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {depth} - depth)"))
    fitting = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("n")).filter(
        (F.col("n") <= capacity) | (F.col("depth") == depth))
    buckets = (
        prefixes.drop("n").join(fitting.select("depth", "prefix"), ["depth", "prefix"])
        .groupBy("slot").agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftrightunsigned(slot, {depth} - depth), {depth} - depth)"))
    )
    return materialise(buckets.select("slot", "bucket", "depth"), "hash-directory"), depth


def build_index(docs: DataFrame, path: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Write the index of the texts of ``docs`` to the folder ``path`` and return it.

    bucket, key, chain (1, 2, ... among the texts of one key), text_sha256, keep_id (the least doc_id that
    has the text), group_size.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("text"))
    same_bytes = texts.groupBy(F.xxhash64("text").alias("key"), "text").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = materialise(
        same_bytes.select("key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"),
        "hash-entries")
    slots, depth = directory(entries, capacity)
    owners = max(1, math.ceil(slots.select("bucket").distinct().count() / OWNED))
    chain = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    placed = (
        entries.join(slots.select("slot", "bucket"), _slot(F.col("key"), depth) == F.col("slot"))
        .repartitionByRange(owners, "bucket")
        .withColumn("chain", F.row_number().over(chain))
        .sortWithinPartitions("bucket", "key", "chain")
    )
    columns = placed.select("bucket", "key", "chain", "text_sha256", "keep_id", "group_size")
    columns.write.parquet(path)
    return docs.sparkSession.read.schema(columns.schema).parquet(path)


def exact_duplicates(docs: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of space, tab, line feed, vertical tab, form feed and
    carriage return becomes one space; null counts as empty. Of equal texts the least doc_id stays.
    ``text_sha256`` is of the normalised text in UTF-8. ``group_size`` counts rows, repeated ones too, and
    rows that share the id that stays are all ``kept``. Null ids are passed over for ``keep_id``; a group
    without any id has none, and all its rows are kept. Other columns are ignored; an empty table gives an
    empty result.

    Copies are merged before the shuffle, so a text that a third of all rows have costs a row per task.
    """
    index = build_index(docs, scratch_path(docs.sparkSession, "hash-index"), capacity=capacity)
    text = normal(F.col("text"))
    looked_up = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_key"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    entry = index.select("key", F.col("text_sha256").alias("_sha256"), "keep_id", "group_size")
    found = looked_up.join(entry, (F.col("_key") == F.col("key")) & (F.col("text_sha256") == F.col("_sha256")))
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id is not distinct from min(doc_id) over same as kept, sha256(norm) as text_sha256
from t window same as (partition by norm)
"""
