"""Ordered computations that must not put one key's rows into one task.

A running sum over ``key`` alone would sort a hot key in a single task. Here the rows of a key are cut
into order-preserving buckets (a minute, an id range); bucket totals are summed map-side first, the
short bucket list is accumulated, and only the inside of a bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _join_same(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the keys of ``rows`` stay."""
    named = totals.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in totals.columns])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(named, same).drop(*[f"_k_{k}" for k in keys])


def running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows up to and including this one.

    ``bucket`` must never decrease along ``order`` within a key.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    upto = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_before"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    same.append(F.col("_bucket").eqNullSafe(F.col("_k_bucket")))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(offsets, same)
    total = F.col("_before") + F.sum("_value").over(inside)
    return joined.withColumn(out, total).select(*df.columns, out)


def running_count(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """Row numbers per key from 1, without sorting a key's rows in one task."""
    return running_sum(df, keys, bucket, order, F.lit(1), out).withColumn(out, F.col(out).cast("int"))


def previous_by_bucket(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, out: str
) -> DataFrame:
    """``lag(value)`` over the key: inside the bucket, or the last value of the bucket before it."""
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value).withColumn("_o", F.struct(*order))
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by("_value", "_o").alias("_last"))
    chain = W.partitionBy(*keys).orderBy("_bucket")
    edges = last.withColumn("_carry", F.lag("_last").over(chain)).drop("_last")
    inside = W.partitionBy(*keys, "_bucket").orderBy("_o")
    joined = _join_same(rows, edges, [*keys, "_bucket"])
    first = F.row_number().over(inside) == 1
    return joined.withColumn(
        out, F.when(first, F.col("_carry")).otherwise(F.lag("_value").over(inside))
    ).select(*df.columns, out)


def last_n_before(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, n: int, out: str
) -> DataFrame:
    """Add ``out``: the ``n`` values before this row within the key, oldest first.

    Inside a bucket a short window frame collects them; what is missing comes from the last ``n`` values
    of the buckets before it, of which each bucket keeps no more than ``n``.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value).withColumn("_o", F.struct(*order))
    newest = W.partitionBy(*keys, "_bucket").orderBy(F.col("_o").desc())
    tails = rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    tails = tails.groupBy(*keys, "_bucket").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "_value"))), lambda s: s["_value"]).alias("_tail")
    )
    chain = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(-n, -1)
    carried = tails.withColumn("_carry", F.flatten(F.collect_list("_tail").over(chain))).drop("_tail")
    inside = W.partitionBy(*keys, "_bucket").orderBy("_o").rowsBetween(-n, -1)
    joined = _join_same(rows, carried, [*keys, "_bucket"]).withColumn("_near", F.collect_list("_value").over(inside))
    both = F.concat("_carry", "_near")
    kept = F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n))
    return joined.withColumn(out, kept).select(*df.columns, out)
