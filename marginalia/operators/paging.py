"""Keyset pages over (timestamp, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_LIMIT = 20
MAX_LIMIT = 100


def page(
    df: DataFrame, ts: str, key: str, *, after: tuple[object, object] | None = None,
    limit: int = DEFAULT_LIMIT, ascending: bool = False,
) -> DataFrame:
    """One page in (ts, id) order, plus ``position`` and the next page's key on the last row.

    ``after`` is the (ts, id) of the last row already seen; the comparison is strict. One row more
    than the page is read, so the next key is set only if more rows exist. The numbering runs over at
    most ``MAX_LIMIT + 1`` rows.
    """
    size = max(1, min(limit, MAX_LIMIT))
    rows = df
    if after is not None:
        at, ident = F.lit(after[0]).cast(df.schema[ts].dataType), F.lit(after[1])
        beyond = F.col(ts) > at if ascending else F.col(ts) < at
        tie = F.col(key) > ident if ascending else F.col(key) < ident
        rows = rows.filter(beyond | ((F.col(ts) == at) & tie))
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in (ts, key)]
    numbered = rows.orderBy(*order).limit(size + 1).withColumn("position", F.row_number().over(W.orderBy(*order)))
    following = F.lead(key).over(W.orderBy("position"))
    last = (F.col("position") == size) & following.isNotNull()
    return numbered.withColumn("next_ts", F.when(last, F.col(ts))).withColumn(
        "next_id", F.when(last, F.col(key))
    ).filter(F.col("position") <= size)
