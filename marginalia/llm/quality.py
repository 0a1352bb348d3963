"""Text quality by Naive Bayes support vectors.

Indicators of n-grams, each scaled by the log ratio of its frequencies in good and in bad texts, feed a linear
model with hinge loss, fitted by dual coordinate descent. The n-grams are the words and runs of one to four
word shapes; a shape tells how a word begins and ends and whether it repeats the word before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import words as W
from marginalia.session import materialise

#: Indicators: the first half for words, the second for runs of shapes.
HALF = 1 << 15
SHAPES = 4
#: Labels of each class that the model is fitted on, about, and the most indicators of one of their documents.
SAMPLE_ROWS, SAMPLE_FEATURES = 6000, 20_000

_FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.IntegerType())),
])


class Model(NamedTuple):
    weights: np.ndarray  # of the scaled indicators, times their scale
    squares: np.ndarray  # of the scales
    bias: float
    slope: float
    offset: float


def _kinds() -> np.ndarray:
    """The kind of each byte: capital, small letter, digit, beyond ASCII, or the sign itself."""
    kinds = np.arange(256, dtype=np.uint64)
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:] = 1, 2, 3, 4
    return kinds


_KIND = _kinds()


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The indicators present in each text, ascending."""
    data, at = W.buffers(texts)
    present = np.zeros(2 * HALF, dtype=bool)
    for part in W.words(texts, W.BLANK_SEPARATED):
        bases = np.repeat(at[part.first : part.first + len(part.offsets) - 1], np.diff(part.offsets))
        starts, ends = part.starts + bases, part.ends + bases
        second, before_last = np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts)
        repeats = np.zeros(len(starts), dtype=np.uint64)
        repeats[1:] = part.hashes[1:] == part.hashes[:-1]
        firsts = part.offsets[:-1]
        repeats[firsts[firsts < len(repeats)]] = 0
        shape = repeats
        for edge in (starts, second, before_last, ends - 1):
            shape = shape * np.uint64(257) + _KIND[data[edge]]
        shape = W.mix(shape)
        runs, run = [], np.zeros(len(shape), dtype=np.uint64)
        for n in range(1, SHAPES + 1):
            run = W.mix(run[: len(shape) - n + 1] * W.BASE + shape[n - 1 :]) if n <= len(shape) else shape[:0]
            runs.append((run >> np.uint64(49)).astype(np.int32) + HALF)
        word = (part.hashes >> np.uint64(49)).astype(np.int32)
        for a, b in zip(part.offsets[:-1], part.offsets[1:]):
            present[word[a:b]] = True
            for n, found in enumerate(runs, start=1):
                present[found[a : max(a, b - n + 1)]] = True
            own = np.flatnonzero(present)
            present[own] = False
            yield own


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(features(batch.column(2)))
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=_FEATURES.names)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the share of each indicator among good texts over that among bad ones, each counted once more."""
    both = np.ones((2, 2 * HALF))
    for found, label in zip(rows, labels):
        both[int(label), found] += 1
    shares = np.log(both / both.sum(axis=1, keepdims=True))
    return shares[1] - shares[0]


def dual_coordinate_descent(
    rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 7
) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise |w|^2 / 2 + sum of cost * hinge loss; rows are scaled to length 1.

    One dual variable at a time is set to its optimum between 0 and its cost, in a shuffled order.
    """
    norms = np.array([max(np.sqrt((scale[r] ** 2).sum()), 1e-12) for r in rows])
    values = [scale[r] / n for r, n in zip(rows, norms)]
    squares = np.array([(v**2).sum() + 1 for v in values])
    sign, weights, bias, dual = 2.0 * labels - 1, np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    shuffle = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in shuffle.permutation(len(rows)):
            slope = sign[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - slope / squares[i], 0.0), cost[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve that fits labels to margins best; the slope is positive."""
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        gradient = x @ (importance * (p - labels)) + np.array([1e-2, 0]) * theta
        curve = (x * (importance * p * (1 - p))) @ x.T + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(curve, gradient)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def _margins(rows, weights: np.ndarray, squares: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[r].sum() / max(np.sqrt(squares[r].sum()), 1e-12) + bias if len(r) else bias for r in rows])


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_features: int = SAMPLE_FEATURES) -> Model:
    """Learn from the texts of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    Rows without doc_id or label are passed over; a null text is empty. The model is fitted on about
    ``sample_rows`` labels of each class, chosen by a hash of their ids, and the documents that have them; the
    sample's ids are what is broadcast. Documents of more than ``sample_features`` indicators are left out.
    Every fifth document sets the curve from margins to probabilities, in the classes' shares among all
    labels. With one class only the score is its share, with no labels 0.5.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    marked = marked.filter(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    shares = {r.label: r["count"] for r in marked.filter("doc_id is not null").groupBy("label").count().collect()}
    if len(shares) < 2:
        level = 30.0 if 1 in shares else -30.0 if 0 in shares else 0.0
        return Model(np.zeros(2 * HALF), np.zeros(2 * HALF), 0.0, 1.0, level)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    wanted = F.when(F.col("label") == 1, sample_rows / shares[1]).otherwise(sample_rows / shares[0])
    chosen = F.broadcast(marked.filter(chance < wanted))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sampled = texts.join(chosen, "doc_id").select("doc_id", "label", "text").mapInArrow(_featured, _FEATURES)
    sample = materialise(sampled.filter(F.size("features") <= sample_features), "quality-sample").orderBy("doc_id").toArrow()
    rows = [np.asarray(r.values) for r in sample["features"].combine_chunks()] if sample.num_rows else []
    label = sample["label"].to_numpy().astype(float)
    scale = log_count_ratios(rows, label)
    n = np.array([max(1, (label == k).sum()) for k in (0, 1)])
    cost = 4.0 * len(label) / (2 * n[label.astype(int)])
    checked = np.arange(len(rows)) % 5 == 4
    weights, bias = dual_coordinate_descent(
        [r for r, c in zip(rows, checked) if not c], label[~checked], scale, cost[~checked])
    weights, squares = weights * scale, scale**2
    importance = np.array([shares[0], shares[1]])[label.astype(int)] / n[label.astype(int)]
    margins = _margins([r for r, c in zip(rows, checked) if c], weights, squares, bias)
    scaled = importance[checked] / max(importance[checked].mean(), 1e-12) if checked.any() else importance[checked]
    slope, offset = calibrate(margins, label[checked], scaled)
    return Model(weights, squares, float(bias), slope, offset)


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            margins = _margins(features(batch.column(1)), model.weights, model.squares, model.bias)
            scores = 1 / (1 + np.exp(-np.clip(model.slope * margins + model.offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher for better texts).

    Whole texts count. A null text is scored like an empty one, which has no indicators; repeated rows each
    give a row; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # a plain tuple needs no class where it is read
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(_score(shared), "doc_id long, score double")
