"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, array: Column, name: str, pos: str = "_pos") -> DataFrame:
    """One row per element of a computed array: ``keep``, the place from 0, the element.

    The outer form stops the optimizer from testing the array's size in a filter of its own, which would
    evaluate an expensive array twice. Elements must not be NULL.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(name).isNotNull())
