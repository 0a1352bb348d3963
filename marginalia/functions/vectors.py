"""Vector expressions: the deterministic hash embedding, norms, half precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import let


def hash_embedding(text: Column, dims: int) -> Column:
    """A repeatable unit vector for a text, from SHA-256 counter blocks of 32 bytes each.

    Equal texts get equal vectors, so an exact match ranks first; no model is called.
    """
    digest = F.unhex(F.sha2(text, 256))
    blocks = (dims + 31) // 32
    hexed = F.concat(
        *[F.sha2(F.concat(digest, F.unhex(F.lit(f"{n:08x}"))), 256) for n in range(blocks)]
    )
    raw = let(
        hexed,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5,
        ),
    )
    return let(raw, unit)


def unit(vector: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    return let(
        F.when(norm(vector) == 0, F.lit(1.0)).otherwise(norm(vector)),
        lambda n: F.transform(vector, lambda x: x / n),
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half_precision(vectors: pd.Series) -> pd.Series:
    """Round to 16-bit floats and back; Spark has no half type, so a batch's values are rounded together."""
    known = vectors.notna()
    held = vectors[known]
    if len(held):
        rounded = np.concatenate(held.to_list()).astype("float16").astype("float32")
        ends = np.cumsum(held.map(len).to_numpy())[:-1]
        vectors = vectors.copy()
        vectors[known] = pd.Series(np.split(rounded, ends), index=held.index)
    return vectors
