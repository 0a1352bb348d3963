"""Embedding: pending chunks, batched inference, upsert, dimension check, reuse, aliases, usage rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import token_estimate
from marginalia.operators.sinks import upsert
from marginalia.operators.versions import active_chunks

BATCH = 64
EMBEDDABLE = ("chunked", "embedding", "ready")
VECTOR_KEY = ["chunk_id", "model", "embedding_version"]


def pending_chunks(active: DataFrame, vectors: DataFrame, model: str, version: int) -> DataFrame:
    """Active chunks that have no vector of this model and version yet."""
    have = vectors.filter((F.col("model") == model) & (F.col("embedding_version") == version))
    return active.join(have.select("chunk_id"), "chunk_id", "left_anti")


def embed_batches(chunks: DataFrame, make_model: Callable, *, text: str = "content") -> DataFrame:
    """Run a pluggable model over the texts, 64 per call; ``make_model()`` is built once per worker.

    The model takes a numpy array of texts and returns a float matrix, one row per text.
    """
    infer = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=BATCH)
    return chunks.withColumn("vector", infer(F.col(text)))


def embed_distinct(chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], *, text: str = "content") -> DataFrame:
    """Compute each distinct text once and give the vector to every chunk that holds it.

    Copies of one text may be a third of the corpus: the distinct step combines map-side, and the join
    back has one row per text on the right, so AQE can split a hot text on the left.
    """
    keyed = chunks.withColumn("content_key", F.sha2(text, 256))
    once = keyed.groupBy("content_key").agg(F.any_value(text).alias(text))
    vectors = embed(once).select("content_key", "vector")
    return keyed.join(vectors, "content_key")


def wrong_dimensions(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors that do not have the expected number of dimensions (a permanent failure)."""
    return vectors.select("chunk_id", F.coalesce(F.size("vector"), F.lit(0)).alias("dims")).filter(F.col("dims") != dims)


def require_dimensions(vectors: DataFrame, dims: int) -> DataFrame:
    """Strict form: the job fails on the first vector of another size."""
    ok = F.coalesce(F.size("vector") == dims, F.lit(False))
    return vectors.filter(F.assert_true(ok, "vector has the wrong number of dimensions").isNull())


def upsert_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(stored, fresh, VECTOR_KEY)


def lookup_models(kbs: DataFrame, aliases: DataFrame, default: str) -> DataFrame:
    """The name a knowledge base's vectors are stored under: the reported name, else the requested one.

    ``aliases`` (requested, reported) has one row per model name in use.
    """
    asked = F.coalesce(F.nullif(F.trim("embedding_model"), F.lit("")), F.lit(default))
    wanted = kbs.withColumn("requested", asked)
    known = aliases.select("requested", F.nullif(F.trim("reported"), F.lit("")).alias("reported"))
    return wanted.join(known, "requested", "left").withColumn("lookup_model", F.coalesce("reported", "requested"))


def embedding_runs(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str, version: int) -> DataFrame:
    """Outcome of one embedding pass per document, with the usage it has to record.

    Documents outside chunked/embedding/ready are skipped; a document without pending chunks succeeds
    and records nothing.
    """
    eligible = documents.filter(F.col("status").isin(*EMBEDDABLE))
    pending = pending_chunks(active_chunks(chunks, documents), vectors, model, version)
    spent = pending.groupBy("doc_id").agg(
        F.count("*").alias("embedded"), F.sum(token_estimate(F.col("content"))).alias("tokens")
    )
    return eligible.join(spent, "doc_id", "left").select(
        "doc_id", "tenant_id", "doc_version", F.lit("ready").alias("status"),
        F.coalesce("embedded", F.lit(0)).alias("embedded"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.when(F.col("tokens") > 0, F.concat(F.lit("embed:"), F.col("doc_id"), F.lit(":v"), F.col("doc_version"))).alias("request_id"),
    )


def word_model(dims: int) -> Callable:
    """A ``make_model`` of word counts: blank-separated words are counted at a place given by a hash of their letters.

    The vector has unit length; a text without words has the zero vector.
    """
    def make():
        import hashlib

        def place(word: bytes) -> int:
            return int(hashlib.md5(word).hexdigest()[:8], 16) % dims

        def predict(texts: np.ndarray) -> np.ndarray:
            places = [[place(word) for word in str(text).encode("utf-8").split()] for text in texts]
            matrix = np.stack([np.bincount(np.array(p, dtype=np.int64), minlength=dims) for p in places]).astype("float64")
            lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
            return (matrix / np.where(lengths == 0, 1.0, lengths)).astype("float32")

        return predict
    return make


def usage_rows(runs: DataFrame, model: Column) -> DataFrame:
    """Ledger rows of the runs that spent tokens."""
    return runs.filter(F.col("tokens") > 0).select(
        "tenant_id", F.lit("embedding").alias("category"), model.alias("model"),
        F.col("tokens").alias("prompt_tokens"), "request_id",
    )
