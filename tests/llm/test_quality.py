"""Quality: held-out accuracy, the solver against its optimality conditions, odd rows."""

import numpy as np
import pyarrow as pa

from marginalia.llm import quality, queries


def test_held_out(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    got = queries.op3_support_vectors(spark, base).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 40
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_indicators():
    def of(text):
        return set(next(quality.features(pa.array([text]))).tolist())

    assert of(None) == of("") == of(" \n") == set()
    assert of("one") and of("one") != of("One!")
    assert of("the cat") & of("CAT the") >= of("the")
    assert len([f for f in of("a b c d e") if f >= quality.HALF]) == 4
    assert of("a a") - of("a b")
    both = list(quality.features(pa.array(["x y", "x y", "y"])))
    assert (both[0] == both[1]).all() and set(both[2]) < set(both[0])


def test_solver_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(120)]
    labels = np.array([float(3 in r or 7 in r) for r in rows])
    scale = rng.normal(1, 0.2, 40)
    cost = np.full(120, 2.0)
    weights, bias = quality.dual_coordinate_descent(rows, labels, scale, cost, rounds=2000)
    x = np.zeros((120, 40))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    sign = 2 * labels - 1

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + 2.0 * np.maximum(0, 1 - sign * (x @ w + b)).sum()

    best = loss(weights, bias)
    for _ in range(300):
        assert best <= loss(weights + rng.normal(0, 0.02, 40), bias + rng.normal(0, 0.02)) + 2e-2


def test_odd_rows(spark):
    rows = [(1, "good words here", 1), (2, "bad !! words !!", 0), (2, "bad !! words !!", 0), (3, None, 1), (4, "", 0),
            (None, "x", 1), (5, "z", None), (6, "w" * 2_500_000, 1), (7, "fine prose " * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").selectExpr("*", "1 as label", "2 as features")
    model = quality.train(df, df.select("doc_id", "quality"), sample_rows=10**6)
    got = quality.quality_scores(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (3, 4)}
    assert len(empty) == 1
    one = quality.train(df, df.filter("quality = 1").select("doc_id", "quality"))
    assert all(r.score > 0.99 for r in quality.quality_scores(df, one).collect())
    none = quality.train(df, df.limit(0).select("doc_id", "quality"))
    assert {r.score for r in quality.quality_scores(df, none).collect()} == {0.5}
    assert quality.quality_scores(df.limit(0), model).collect() == []
