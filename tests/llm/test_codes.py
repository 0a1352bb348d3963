"""Vector codes against a plain k-means, and the bounds against comparing with every entry."""

import hashlib
import math

import numpy as np
import pytest

from marginalia.llm import codes
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds, scale):
    """{row: (code, error, label_error, digest)}; rows: (vec_id, embedding, label), equal lengths."""
    kept = [(i, [math.floor(scale * x) for x in e], lab) for i, e, lab in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    w = len(kept[0][1]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    book = [[r[1][p * w : (p + 1) * w] for r in order[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w : (p + 1) * w], e)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        held = {}
        for _, v, _ in kept:
            for p in range(parts):
                held.setdefault((p, nearest(v, p)[1]), []).append(v[p * w : (p + 1) * w])
        book = [[[math.floor(sum(c) / len(c)) for c in zip(*held[p, k])] if (p, k) in held else e
                 for k, e in enumerate(book[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    found = [(i, [nearest(v, p) for p in range(parts)], lab) for i, v, lab in kept]
    total = {}
    for _, near, lab in found:
        total[lab] = total.get(lab, 0) + sum(d for d, _ in near)
    return sorted(((i, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near), total[lab], digest)
                   for i, near, lab in found), key=repr)


def got(df, **settings):
    return sorted((tuple(r) for r in codes.code_table(df, **settings).collect()), key=repr)


def test_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got(df) == brute(rows, 16, 64, 2, 256)


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_rounds_and_ties(spark, rounds):
    """Coarse values make many ties; more rounds than the query has make bounds of several ages."""
    rng = np.random.default_rng(rounds)
    rows = [(int(rng.integers(0, 150)), [float(x) for x in rng.integers(-3, 4, 8) / 4], int(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df, parts=4, entries=7, rounds=rounds, scale=8) == brute(rows, 4, 7, rounds, 8)


def test_bounds_spare_comparisons_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (20, 4))
    parts = centres[rng.integers(0, 20, 4000)] + rng.integers(-60, 60, (4000, 4))
    history, state, spared = [centres + rng.integers(-300, 300, centres.shape)], None, 0
    for _ in range(6):
        at, bound, stamp, own, compared = codes.assign_part(parts, history, state)
        far = codes.distances(parts, history[-1])
        assert (at == far.argmin(axis=1)).all() and (own == far.min(axis=1)).all()
        far[np.arange(len(parts)), at] = np.iinfo(np.int64).max
        moved = np.array([codes.greatest_moves(history[s], history[-1])[a] for s, a in zip(stamp, at)])
        assert (bound - moved <= np.sqrt(far.min(axis=1)) + 1e-6).all()
        spared += len(parts) - compared
        state = (at, bound, stamp)
        history.append(np.stack([parts[at == k].mean(axis=0).astype(np.int64) if (at == k).any() else history[-1][k] for k in range(20)]))
    assert spared > 3 * len(parts)


def test_net_moves_are_never_more_than_summed_moves():
    """An entry that moves there and back has moved by nothing."""
    there, back = np.array([[0, 0], [9, 0]]), np.array([[5, 0], [9, 0]])
    assert codes.greatest_moves(there, back)[1] == 5
    assert codes.greatest_moves(there, there).max() == 0


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (3, [0.5, -0.5, 1.0, 0.25], 1), (1, None, 1), (2, [0.5, None, 1.0, 0.25], 1), (4, [inf, 0.0, 0.0, 0.0], None),
        (5, [nan, 0.0, 0.0, 0.0], None), (6, [-0.001, 0.0, 0.0, 0.0], None), (6, [-0.001, 0.0, 0.0, 0.0], None),
        (None, [1.0, 1.0, 1.0, 1.0], None), (7, [0.0, 0.0, 0.0, 1.0], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = brute(rows, 2, 4, 2, 256)
    assert got(df, parts=2, entries=4) == expected
    clash = df.selectExpr("*", "1 as whole", "'x' as code", "2 as error", "3 as sums")
    assert got(clash, parts=2, entries=4) == expected
    other = df.union(spark.createDataFrame([(8, [1.0, 2.0], 1), (0, [1.0], 1), (9, [], 1)], SCHEMA))
    assert got(other, parts=2, entries=4) == expected
    assert got(df.limit(0)) == []
    huge = spark.createDataFrame([(1, [3e38, -3e38], 1), (2, [0.0, 0.0], 1)], SCHEMA)
    assert [r[2] for r in got(huge, parts=2, entries=1, rounds=0)] == [0, 2 * codes.LIMIT**2]


def test_decoded_vectors_are_close(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found, book = codes.fit_codes(df)
    rows = {r.vec_id: (r.nearest, r.error) for r in found.collect()}
    for r in df.limit(50).collect():
        near, error = rows[r.vec_id]
        back = codes.decode(np.array([near]), book)[0] * 256
        assert error == ((np.floor(np.array(r.embedding, np.float64) * 256) - back) ** 2).sum()
