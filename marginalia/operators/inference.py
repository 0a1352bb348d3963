"""Inference whose batches are kept one by one: what fails or is stopped costs its own batch, a rerun only what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.embed import BATCH, pending_chunks
from marginalia.session import exists

STORED = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("embedding_version", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("error", T.StringType()), T.StructField("run", T.IntegerType()), T.StructField("wave", T.IntegerType()),
])


def batch_names(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """``batch``: document, version and ``seq`` by ``size``. It names the same chunks however many are still missing."""
    number = F.floor(F.col("seq") / size).cast("string")
    version = F.coalesce(F.col("doc_version").cast("string"), F.lit(""))
    return chunks.withColumn("batch", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), version, F.coalesce(number, F.lit(""))))


def stored_rows(spark: SparkSession, home: str) -> DataFrame:
    """Everything kept under ``home``: a row per chunk with its vector, or with the error of its batch."""
    if not exists(spark, home):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("basePath", home).parquet(home)


def stored_vectors(spark: SparkSession, home: str) -> DataFrame:
    return stored_rows(spark, home).filter(F.col("vector").isNotNull()).drop("error")


def failed_batches(spark: SparkSession, home: str) -> DataFrame:
    """Batches that have no vectors yet, with the last run that tried them, its error and how many chunks wait."""
    rows = stored_rows(spark, home)
    key = ["batch", "model", "embedding_version"]
    last = rows.groupBy(*key, "run").agg(F.count_if(F.col("error").isNotNull()).alias("chunks"), F.max("error").alias("error"))
    newest = last.groupBy(*key).agg(F.max_by(F.struct("run", "chunks", "error"), "run").alias("_l"))
    return newest.select(*key, "_l.*").filter("chunks > 0")


def embed_missing(
    chunks: DataFrame, make_model: Callable, home: str, *, model: str, version: int, waves: int = 1,
    size: int = BATCH, text: str = "content",
) -> DataFrame:
    """Vectors of all chunks of this model and version that could be computed: those kept before and new ones.

    ``chunks``: chunk_id, doc_id, doc_version, seq and the text. ``make_model()``, built once per task, gives a
    function from a numpy array of at most ``size`` texts to a float matrix with a row each. Only chunks without
    a vector under ``home`` are computed. A batch whose call raises, or gives another number of rows, is kept as
    an error and stops no other batch; a rerun tries it again. Batches are dealt to ``waves`` by their names and each wave is
    written on its own, so a job that is killed loses one wave at most. Batches are spread over tasks one by
    one, so a long document is no single task's. What is missing is decided on ids alone: a text is shuffled once a
    run, behind a row without text that says it is asked for. ``chunks`` is read twice a wave. A NULL text is empty. Rows with the chunk_id, document and seq of
    another are computed once; a row without chunk_id is not computed. Extra columns are ignored.
    """
    spark = chunks.sparkSession
    run = 0
    while exists(spark, f"{home}/run={run}"):
        run += 1
    ids = F.col("chunk_id").cast("string").alias("chunk_id")
    named = batch_names(chunks, size).select(ids, "batch", "seq", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for wave in range(waves):
        mine = named.filter(F.pmod(F.xxhash64("batch"), F.lit(waves)) == wave)
        mine = mine.filter(F.col("chunk_id").isNotNull())
        missing = pending_chunks(mine.select("chunk_id", "batch", "seq"), stored_vectors(spark, home), model, version)
        marked = mine.unionByName(missing.withColumn("_text", F.lit(None).cast("string")))
        found = marked.repartition("batch").sortWithinPartitions("batch", "seq", "chunk_id", "_text").mapInArrow(
            _infer(make_model, size), "chunk_id string, batch string, vector array<float>, error string")
        found.select("chunk_id", "batch", F.lit(model).alias("model"), F.lit(version).cast("int").alias("embedding_version"), "vector", "error").write.parquet(
            f"{home}/run={run}/wave={wave}")
    kept = stored_vectors(spark, home).filter((F.col("model") == model) & (F.col("embedding_version") == version))
    asked = kept.join(chunks.select(ids), "chunk_id", "left_semi")
    return asked.withColumn("chunk_id", F.col("chunk_id").cast(chunks.schema["chunk_id"].dataType))


def _infer(make_model: Callable, size: int):
    names = ["chunk_id", "batch", "vector", "error"]

    def called(predict, ids: list, batch: str, texts: list[str]) -> pa.RecordBatch:
        error, vectors = None, [None] * len(ids)
        try:
            matrix = np.asarray(predict(np.array(texts, dtype=object)), dtype="float32")
            if matrix.ndim != 2 or len(matrix) != len(ids):
                raise ValueError(f"{matrix.shape} vectors for {len(ids)} texts")
            vectors = list(matrix)
        except Exception as exc:  # kept with the batch, which the next run tries again
            error = f"{type(exc).__name__}: {exc}"
        columns = [pa.array(ids, pa.string()), pa.array([batch] * len(ids), pa.string()),
                   pa.array(vectors, pa.list_(pa.float32())), pa.array([error] * len(ids), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, ids, texts, current, last, asked = None, [], [], None, None, None
        for rows in batches:
            for chunk_id, batch, content in zip(*(rows.column(c).to_pylist() for c in ("chunk_id", "batch", "_text"))):
                if content is None:  # sorted before the texts it asks for
                    asked = (batch, chunk_id)
                if content is None or asked != (batch, chunk_id):
                    continue
                if ids and (batch != current or len(ids) == size):
                    yield called(predict, ids, current, texts)
                    ids, texts = [], []
                if batch == current and chunk_id == last:
                    continue
                predict = predict or make_model()
                last = chunk_id
                current = batch
                ids.append(chunk_id)
                texts.append(content)
        if ids:
            yield called(predict, ids, current, texts)

    return infer
