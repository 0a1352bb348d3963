"""Inference kept batch by batch, with models that fail, stop and come back."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.operators import inference as I

CHUNKS = "chunk_id long, doc_id long, doc_version int, seq int, content string, model string, batch int"


def _rows(doc, n, text="text"):
    return [(doc * 1000 + i, doc, 1, i, f"{text} {doc} {i}", "mine", 5) for i in range(n)]


def _model(log, refuse=None, rows=lambda n: n):
    """Vectors (length, 1); every call leaves a file with its number of texts and its first text."""
    def make():
        def predict(texts):
            import uuid

            with open(os.path.join(log, uuid.uuid4().hex), "w") as out:
                out.write(f"{len(texts)}:{texts[0]}")
            if refuse and any(refuse in t for t in texts):
                raise RuntimeError("busy")
            return np.array([[len(t), 1.0] for t in texts][: rows(len(texts))], dtype="float32").reshape(-1, 2)
        return predict
    return make


@pytest.fixture()
def log(tmp_path):
    made = []

    def fresh():
        made.append(tmp_path / f"calls{len(made)}")
        made[-1].mkdir()
        return str(made[-1])
    return fresh


def _calls(folder):
    return sorted((int(n), t) for n, t in ((open(os.path.join(folder, f)).read().split(":", 1)) for f in os.listdir(folder)))


def test_a_failing_batch_costs_only_itself(spark, tmp_path, log):
    """Ten batches of 64, the fifth fails: nine are kept, and the next run calls the model once."""
    chunks, home, first, second = spark.createDataFrame(_rows(1, 640), CHUNKS), str(tmp_path / "v"), log(), log()
    got = I.embed_missing(chunks, _model(first, refuse="text 1 300"), home, model="m", version=1)
    assert got.count() == 576 and {n for n, _ in _calls(first)} == {64} and len(_calls(first)) == 10
    failed = I.failed_batches(spark, home).collect()
    assert [(r.batch, r.run, r.chunks, r.error) for r in failed] == [("1:1:4", 0, 64, "RuntimeError: busy")]
    got = I.embed_missing(chunks, _model(second), home, model="m", version=1)
    assert _calls(second) == [(64, "text 1 256")]
    assert {r.chunk_id: (r.vector[0], r.run) for r in got.collect()} == {
        r[0]: (len(r[4]), int(256 <= r[3] < 320)) for r in _rows(1, 640)}
    assert I.failed_batches(spark, home).count() == 0
    third = log()
    assert I.embed_missing(chunks, _model(third), home, model="m", version=1).count() == 640 and not _calls(third)


def test_batches_keep_their_names_when_some_chunks_have_vectors(spark, tmp_path, log):
    """New chunks of a batch are called alone; another version or model is computed anew."""
    home, one, two, three = str(tmp_path / "v"), log(), log(), log()
    rows = _rows(1, 130) + _rows(2, 3)
    I.embed_missing(spark.createDataFrame(rows[:100], CHUNKS), _model(one), home, model="m", version=1)
    got = I.embed_missing(spark.createDataFrame(rows, CHUNKS), _model(two), home, model="m", version=1)
    assert _calls(one) == [(36, "text 1 64"), (64, "text 1 0")]
    assert _calls(two) == [(2, "text 1 128"), (3, "text 2 0"), (28, "text 1 100")]
    assert got.count() == 133 and got.filter("batch = '1:1:1'").count() == 64
    assert I.embed_missing(spark.createDataFrame(rows, CHUNKS), _model(three), home, model="m", version=2).count() == 133
    assert sum(n for n, _ in _calls(three)) == 133


def test_a_job_that_dies_keeps_the_waves_before(spark, tmp_path, log):
    """The worker is killed in one wave; what earlier waves wrote is not computed again."""
    chunks, home, first, second = spark.createDataFrame(_rows(1, 640), CHUNKS), str(tmp_path / "v"), log(), log()
    wave_of = {r.batch: r.w for r in I.batch_names(chunks.drop("batch")).select("batch", F.pmod(F.xxhash64("batch"), F.lit(4)).alias("w")).distinct().collect()}
    last = max(wave_of.values())
    fatal = next(b for b, w in wave_of.items() if w == last)
    text = f"text 1 {int(fatal.rsplit(':', 1)[1]) * 64}"

    def dying():
        predict = _model(first)()

        def run(texts):
            if text in list(texts):
                raise KeyboardInterrupt  # no error of the model: the task ends
            return predict(texts)
        return run

    with pytest.raises(PySparkException):
        I.embed_missing(chunks, dying, home, model="m", version=1, waves=4)
    before = [b for b, w in wave_of.items() if w < last]
    assert I.stored_vectors(spark, home).count() == 64 * len(before) > 0
    assert I.embed_missing(chunks, _model(second), home, model="m", version=1, waves=4).count() == 640
    assert len(_calls(second)) == 10 - len(before)


def test_odd_rows(spark, tmp_path, log):
    """NULL in any column, empty and very long texts, repeated rows, a wrong number of vectors, no rows at all."""
    home, calls = str(tmp_path / "v"), log()
    rows = [(1, None, None, None, None, "x", 1), (2, 5, 1, 0, "", "x", 1), (3, 5, 1, 1, "y" * 3_000_000, "x", 1),
            (3, 5, 1, 1, "y" * 3_000_000, "x", 1), (None, 5, 1, 2, "no id", "x", 1), (4, 6, None, 0, "z", None, None)]
    got = I.embed_missing(spark.createDataFrame(rows, CHUNKS), _model(calls), home, model="m", version=1)
    assert sorted((r.chunk_id, r.vector[0]) for r in got.collect()) == [(1, 0.0), (2, 0.0), (3, 3_000_000.0), (4, 1.0)]
    short = str(tmp_path / "short")
    assert I.embed_missing(spark.createDataFrame(_rows(1, 3), CHUNKS), _model(calls, rows=lambda n: n - 1), short, model="m", version=1).count() == 0
    assert I.failed_batches(spark, short).first().error == "ValueError: (2, 2) vectors for 3 texts"
    none = spark.createDataFrame([], CHUNKS)
    assert I.embed_missing(none, _model(calls), str(tmp_path / "none"), model="m", version=1).count() == 0
    assert I.stored_vectors(spark, str(tmp_path / "never")).count() == 0


def test_only_texts_asked_for_are_computed():
    """Texts meet a row without text that asks for them in their own task, so no join shuffles texts."""
    import pyarrow as pa

    rows = [("1", "b", None), ("1", "b", "x"), ("1", "b", "x"), ("2", "b", "yy"), ("3", "b", None), ("3", "b", None), ("3", "b", "zzz"),
            ("1", "c", "x"), ("4", "c", None), ("4", "c", "")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("chunk_id", "batch", "_text"), r)) for r in rows[at:at + 3]],
                                          pa.schema([(n, pa.string()) for n in ("chunk_id", "batch", "_text")])) for at in range(0, 10, 3)]
    calls = []

    def make():
        def predict(texts):
            calls.append(list(texts))
            return np.array([[len(t)] for t in texts], dtype="float32")
        return predict

    got = [r for b in I._infer(make, 64)(iter(batches)) for r in b.to_pylist()]
    assert calls == [["x", "zzz"], [""]]
    assert [(r["chunk_id"], r["batch"], r["vector"]) for r in got] == [("1", "b", [1.0]), ("3", "b", [3.0]), ("4", "c", [0.0])]


def test_active_chunks_stay_where_they_lie(spark):
    """Chunks that lie by document already are not shuffled once more for their versions."""
    from marginalia.operators.versions import active_chunks

    documents = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (None, 1), (3, None)], "doc_id long, doc_version int")
    chunks = spark.createDataFrame([(i, d, v, i % 5 == 4) for i, (d, v) in enumerate(
        [(1, 1), (1, 2), (2, 1), (2, 2), (1, 2), (None, 1), (3, 1), (3, None)])], "chunk_id long, doc_id long, doc_version int, superseded boolean")
    assert sorted(r.chunk_id for r in active_chunks(chunks, documents).collect()) == [1, 2]
    lying = chunks.hint("merge").join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    plan = active_chunks(lying, documents.hint("merge"))._jdf.queryExecution().sparkPlan().toString()
    assert "doc_version" not in plan.split("SortMergeJoin")[1].split("LeftSemi")[0]
