"""Vectors as short codes: one codebook for each part of a vector, fitted by bounded k-means.

Each round asks for the nearest entry of every part. A part carries a lower bound on its distance to all
entries but its own, and the round in which the bound was found. Codebooks of all rounds are kept, so a later
round lowers the bound by how far an entry really lies from where it lay then (the norm of the summed moves),
not by the sum of its moves. Only where the own entry is not closer than that, all entries are compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers beyond this are set to it, so that all sums of squares fit 64 bits.
LIMIT = 1 << 24

_STATE = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.LongType()),
    T.StructField("whole", T.ArrayType(T.IntegerType())),
    T.StructField("nearest", T.ArrayType(T.ShortType())),
    T.StructField("bound", T.ArrayType(T.DoubleType())), T.StructField("stamp", T.ArrayType(T.ShortType())),
    T.StructField("error", T.LongType()),
    T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType())),
])


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of (rows, width) integers to (entries, width) integers."""
    gap = parts[:, None, :] - book[None, :, :]
    return np.einsum("rew,rew->re", gap, gap)


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, a lower bound on the distance to every other entry)."""
    far = distances(parts, book)
    at = far.argmin(axis=1)
    rows = np.arange(len(parts))
    own = far[rows, at]
    if len(book) == 1:
        return at, own, np.full(len(parts), np.inf)
    far[rows, at] = np.iinfo(np.int64).max
    return at, own, np.sqrt(far.min(axis=1).astype(np.float64))


def greatest_moves(then: np.ndarray, now: np.ndarray) -> np.ndarray:
    """For each entry, how far the others have come at most between two codebooks."""
    gap = (now - then).astype(np.float64)
    moved = np.sqrt((gap * gap).sum(axis=1))
    first = int(moved.argmax())
    others = np.delete(moved, first)
    most = np.full(len(moved), moved[first])
    most[first] = others.max() if len(others) else 0.0
    return most


def assign_part(
    parts: np.ndarray, history: list[np.ndarray], state: tuple[np.ndarray, np.ndarray, np.ndarray] | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """One round for one part of many vectors: (nearest, bound, stamp, squared distance, rows compared with all).

    ``history`` holds the part's codebooks of all rounds, the present one last; ``state`` is what the round
    before returned, or None in the first.
    """
    book, now = history[-1], len(history) - 1
    if state is None:
        at, own, bound = nearest_entries(parts, book)
        return at, bound, np.full(len(parts), now), own, len(parts)
    at, bound, stamp = (np.array(x) for x in state)
    gap = parts - book[at]
    own = (gap * gap).sum(axis=1)
    left = np.empty(len(parts))
    for then in np.unique(stamp):
        rows = stamp == then
        left[rows] = bound[rows] - greatest_moves(history[then], book)[at[rows]]
    # floats only ever err by less than this margin, and ties are compared again
    open_rows = np.flatnonzero(~(np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-6 < left))
    if len(open_rows):
        at[open_rows], own[open_rows], bound[open_rows] = nearest_entries(parts[open_rows], book)
        stamp[open_rows] = now
    return at, bound, stamp, own, len(open_rows)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()).cast(kind))


def _whole_numbers(width: int, scale: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), width).astype(np.float64)
            ints = np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _rows(ints, pa.int32())], names=["vec_id", "label", "whole"])

    return whole


def _round(history: list[np.ndarray], parts: int):
    """history: codebooks (parts, entries, width) of all rounds; the last one is assigned to."""
    entries, width = history[-1].shape[1:]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        seen = False
        for batch in batches:
            n, seen = batch.num_rows, True
            if n == 0:
                continue
            whole = _matrix(batch.column(2), parts * width).astype(np.int64).reshape(n, parts, width)
            before = None
            if len(history) > 1:
                before = [_matrix(batch.column(k), parts) for k in (3, 4, 5)]
            at, bound, stamp = np.empty((n, parts), np.int64), np.empty((n, parts)), np.empty((n, parts), np.int64)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                books = [book[p] for book in history]
                for i in range(0, n, 2048):  # the comparison with all entries holds rows x entries x width numbers
                    rows = slice(i, i + 2048)
                    state = None if before is None else tuple(x[rows, p].astype(k) for x, k in zip(before, (np.int64, np.float64, np.int64)))
                    at[rows, p], bound[rows, p], stamp[rows, p], own, _ = assign_part(whole[rows, p], books, state)
                    error[rows] += own
                np.add.at(sums[p], at[:, p], whole[:, p])
                counts[p] += np.bincount(at[:, p], minlength=entries)
            nothing = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), _rows(at, pa.int16()), _rows(bound, pa.float64()),
                 _rows(stamp, pa.int16()), pa.array(error), nothing, nothing], names=_STATE.names)
        if seen:
            empty = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.list_(k)) for k in (
                pa.int32(), pa.int16(), pa.float64(), pa.int16())], pa.nulls(1, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*empty, _rows(sums.reshape(1, -1), pa.int64()), _rows(counts.reshape(1, -1), pa.int64())], names=_STATE.names)

    return assign


def _summed(state: DataFrame, column: str, size: int) -> np.ndarray:
    """The tasks' sums, added up place by place; as many numbers as all codebooks hold."""
    each = state.filter("sums is not null").select(F.posexplode(column).alias("at", "x"))
    total = np.zeros(size, np.int64)
    for row in each.groupBy("at").agg(F.sum("x").alias("x")).collect():
        total[row["at"]] = row["x"]
    return total


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) without vectors that are null or hold null or non-finite components."""
    v = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("embedding").isNotNull() & ~bad)


def fit_codes(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, nearest, error) of every usable vector, and the codebooks (parts, entries, width).

    Components become floor(scale * x). Codebooks start from the ``entries`` smallest (vec_id, vector), null ids
    last; fewer vectors make fewer entries. Ties go to the lower entry; an entry without parts stays as it is.
    Vectors whose length cannot be cut into equal parts, or is not that of the smallest vec_id among those that
    can, are left out like null ones. Repeated rows each count. Integers beyond ``LIMIT`` are set to it. Without
    usable vectors the result has no rows and codebooks of no entries. Other columns are ignored.
    """
    spark = vectors.sparkSession
    cut = usable(vectors).filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = cut.orderBy(*order).select(F.size("embedding").alias("n")).limit(1).collect()
    if not first:
        none = spark.createDataFrame([], T.StructType([f for f in _STATE if f.name in ("vec_id", "label", "nearest", "error")]))
        return none, np.zeros((parts, 0, 0), np.int64)
    size = first[0]["n"]
    same = cut.filter(F.size("embedding") == size)
    whole = materialise(
        same.mapInArrow(_whole_numbers(size, scale), T.StructType(_STATE.fields[:3])), "codes-whole")
    start = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
    book = np.array([r["whole"] for r in start], np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    history, state = [book], whole
    for r in range(rounds + 1):
        state = materialise(
            state.filter("whole is not null").mapInArrow(_round(list(history), parts), _STATE), f"codes-round-{r}")
        if r < rounds:
            sums = _summed(state, "sums", book.size).reshape(book.shape)
            counts = _summed(state, "counts", book.shape[0] * book.shape[1]).reshape(book.shape[:2])
            book = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], book)
            history.append(book)
    return state.filter("whole is not null").select("vec_id", "label", "nearest", "error"), book


def decode(nearest: np.ndarray, book: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vectors (rows, parts * width) that codes (rows, parts) stand for."""
    return np.concatenate([book[p][nearest[:, p]] for p in range(len(book))], axis=1) / scale


def written(book: np.ndarray) -> str:
    """All components of all entries, by part, entry and place, comma-joined."""
    return ",".join(map(str, book.ravel().tolist()))


def code_table(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector; see ``fit_codes`` for its cases.

    ``label_error`` adds up the errors of all vectors of the same label; vectors without label are together.
    """
    found, book = fit_codes(vectors, **settings)
    digits = F.array_join(F.transform("nearest", lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))), "")
    by_label = found.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return (
        found.withColumn("code", digits).join(by_label, F.col("label").eqNullSafe(F.col("_label")))
        .select("vec_id", "code", "error", "label_error",
                F.sha2(F.lit(written(book)).cast("binary"), 256).alias("codebooks_sha256"))
    )


def _oracle() -> str:
    width = "(len(v) // 16)"
    steps = [f"""
        with kept as (
            select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        part as (
            select vec_id, label, p, v[p * {width} + 1 : (p + 1) * {width}] as x from kept, (select unnest(range(16)) as p)
        ),
        book0 as (
            select p, e, x from part join (
                select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 64) using (vec_id)
        )"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
        near{r} as (
            select vec_id, label, p, any_value(a.x) as x,
                   min(struct_pack(d := list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) as m
            from part a join book{r} b using (p) group by vec_id, label, p
        )""")
        if r < ROUNDS:
            steps.append(f"""
        mean{r} as (
            select p, m.e as e, i, sum(x[i + 1]) as s, count(*) as c
            from near{r}, (select unnest(range(64)) as i) where i < len(x) group by p, m.e, i
        ),
        book{r + 1} as (
            select p, e, coalesce(n.x, b.x) as x from book{r} b left join (
                select p, e, list(cast((s - ((s % c) + c) % c) // c as bigint) order by i) as x from mean{r} group by p, e
            ) n using (p, e)
        )""")
    steps.append(f"""
        found as (
            select vec_id, label, string_agg(printf('%02x', m.e), '' order by p) as code, cast(sum(m.d) as bigint) as error
            from near{ROUNDS} group by vec_id, label
        ),
        digest as (
            select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book{ROUNDS}
        )
        select vec_id, code, error,
               cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from found, digest""")
    return ",".join(steps[:-1]) + "," + steps[-1]


ORACLE = _oracle()
