"""Retrieval: exact and approximate nearest chunks, merging, score gate, context selection.

Vectors are written once to the shared folder, sorted by tenant and knowledge base. A task has a block of questions,
reads the vectors of their tenants a batch at a time and keeps each question's best k of a base, so what is shuffled
grows with the questions, however many vectors there are. Nothing passes through the driver, and no pair of question
and chunk is ever a row unless it is among a task's best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.shared import SMALL_GROUPS, TopHits, gathered, read_batches, read_blocks, spread_of
from marginalia.functions.settings import clamped_float, clamped_int, settings
from marginalia.functions.skew import last_n_before
from marginalia.functions.text import strip
from marginalia.session import scratch_path

TOP_K, MAX_TOP_K = 40, 200
CONTEXT_CHUNKS, TOKEN_BUDGET = 8, 4500
BLOCK_QUESTIONS = 16_384  # questions of a task, at most
STEP_QUERIES = 1024  # of them scored together
PART_VECTORS, BATCH_VECTORS = 16_384, 4096  # vectors of a part, at least, and read at a time
SCORE_DIGITS = 12
HEAD, TRIES = 8, 16  # characters of a seam looked up first, places tried before the prefix function
BLOCK_HITS, PAIRS = 1 << 21, 1 << 16  # hits of a block that is checked, about, and compared at a time
CHECKED = "query_id long, wrong long, odd long"
HITS = "query_id long, kb_id string, chunk_id long, score double"


def normalise_queries(queries: DataFrame, column: str = "question") -> DataFrame:
    """Strip the question; a blank one is rejected."""
    return queries.withColumn("query_norm", strip(F.col(column))).filter(F.col("query_norm") != "")


def search_queries(messages: DataFrame, turns: int = 1) -> DataFrame:
    """Question plus the last ``turns`` questions before it, joined by newlines.

    The ``turns`` are counted before blank ones are left out. ``turns <= 0`` keeps the question alone.
    """
    asked = messages.filter(F.col("role") == "user").withColumn("_q", strip(F.col("content")))
    if turns <= 0:
        return asked.select("message_id", F.col("_q").alias("search_query"))
    before = last_n_before(
        asked, ["conversation_id"], F.date_trunc("hour", "created_at"),
        [F.col("created_at"), F.col("message_id")], F.col("_q"), turns, "_before",
    )
    said = F.concat(F.filter("_before", lambda q: q != ""), F.array("_q"))
    return before.select("message_id", strip(F.array_join(said, "\n")).alias("search_query"))


def rag_settings(kbs: DataFrame) -> DataFrame:
    """Retrieval parameters per knowledge base: wrong types fall back, values out of range clamp."""
    doc = settings(F.col("config"))
    at = "$.retrieval."
    return kbs.select(
        "*",
        clamped_int(doc, at + "top_k", TOP_K, 1, MAX_TOP_K).alias("top_k"),
        clamped_int(doc, at + "context_chunks", CONTEXT_CHUNKS, 1, 50).alias("context_chunks"),
        clamped_int(doc, at + "context_token_budget", TOKEN_BUDGET, 1, 100000).alias("context_token_budget"),
        clamped_float(doc, at + "min_score_ratio", 0.0, 0.0, 1.0).alias("min_score_ratio"),
        clamped_int(doc, at + "query_history_turns", 1, 0, 10).alias("query_history_turns"),
    )


def searchable(vectors: DataFrame, model: str, version: int) -> DataFrame:
    """Vectors retrieval may see: current model and version, not superseded."""
    return vectors.filter(
        (F.col("model") == model) & (F.col("embedding_version") == version) & ~F.col("superseded")
    )


def nearest_chunks(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, *, match: str = "tenant_id") -> DataFrame:
    """Exact cosine top-k per question and knowledge base, among vectors with an equal ``match`` key.

    ``queries``: query_id, vector and the match key (a question may have several). ``vectors``: chunk_id,
    kb_id, vector and the match key. Result: query_id, kb_id, chunk_id, score, rank; equal scores rank by
    chunk id. A task holds a block of questions, their best hits in one base, and a batch of vectors, whatever
    the sizes. What has no vector is neither searched nor found.
    """
    k = max(1, min(k, MAX_TOP_K))
    spark = queries.sparkSession
    known = lambda df: df.filter(F.col("match").isNotNull() & F.col("vector").isNotNull())
    asked = known(queries.select("query_id", F.col(match).cast("string").alias("match"), "vector"))
    stored = known(vectors.select("chunk_id", "kb_id", F.col(match).cast("string").alias("match"), "vector"))
    stored = stored.filter(F.col("kb_id").isNotNull())
    cores = spark.sparkContext.defaultParallelism
    blocks, parts = spread_of(queries.count(), vectors.count(), cores, BLOCK_QUESTIONS, PART_VECTORS)
    path = scratch_path(spark, "vectors")
    order = ["part", "match", "kb_id"]
    stored.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int")).repartitionByRange(
        cores, *order, "chunk_id").sortWithinPartitions(*order, "chunk_id").write.options(**SMALL_GROUPS).parquet(path)
    dealt = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.repartitionByRange(blocks * parts, "part", "match", "query_id")
    found = dealt.mapInPandas(_search(path, k, BLOCK_QUESTIONS, STEP_QUERIES, SCORE_DIGITS), HITS)
    best = W.partitionBy("query_id", "kb_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    # by question alone: what merges or counts a question's hits afterwards finds them together
    return found.repartition("query_id").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _search(path: str, k: int, block: int, step: int, digits: int):
    """Questions stay where they are; the vectors of their keys are read a batch at a time, base by base."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in gathered(batches, block):
            asked = {
                key: [(part["query_id"].to_numpy()[at:at + step], _unit(np.stack(part["vector"].to_numpy()[at:at + step])))
                      for at in range(0, len(part), step)]
                for key, part in rows.groupby("match")
            }
            here, best = None, []
            for key, kb, ids, stored in _bases(path, int(rows["part"].iloc[0]), list(asked)):
                if (key, kb) != here:
                    yield from _found(here, best, asked)
                    here, best = (key, kb), [TopHits(len(q), k, digits, -2.0) for q, _ in asked[key]]
                for (_, unit), top in zip(asked[key], best):
                    top.offer(stored @ unit.T, ids)
            yield from _found(here, best, asked)

    return search


def _bases(path: str, part: int, keys: list[str]) -> Iterator[tuple[str, str, np.ndarray, np.ndarray]]:
    """(key, base, chunk ids, unit vectors) of a part; they are stored base by base."""
    for rows in read_blocks(path, BATCH_VECTORS, "match", keys, part=part):
        for (key, kb), base in rows.groupby(["match", "kb_id"], sort=False):
            yield key, kb, base["chunk_id"].to_numpy(), _unit(np.stack(base["vector"].to_numpy()))


def _found(base: tuple[str, str] | None, best: list, asked: dict) -> Iterator[pd.DataFrame]:
    for (ids, _), top in zip(asked[base[0]] if base else (), best):
        q, chunk_ids, scores = top.best()
        yield pd.DataFrame({"query_id": ids[q], "kb_id": base[1], "chunk_id": chunk_ids, "score": scores})


def _unit(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype("float64")
    length = np.linalg.norm(wide, axis=1, keepdims=True)
    return wide / np.where(length == 0, 1.0, length)


def with_payload(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Attach name, version, content, page or heading path to the few hits."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits the approximate search found, per question."""
    found = approximate.select("query_id", "chunk_id").distinct().withColumn("_found", F.lit(1))
    joined = exact.select("query_id", "chunk_id").distinct().join(found, ["query_id", "chunk_id"], "left")
    return joined.groupBy("query_id").agg(F.count("*").alias("hits"), (F.count("_found") / F.count("*")).alias("recall"))


def check_hits(found: DataFrame, queries: DataFrame, vectors: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per question: hits whose score is not the exact cosine, hits out of order, and whether there are any.

    ``found``: as a search returns it. ``queries``: query_id, vector; ``vectors``: chunk_id, vector; rows of one id are
    compared one by one. A question's hits are one row beside its vector, and a task reads the stored vectors a batch at
    a time, so no vector is copied for a hit. Hits of unknown questions or chunks are left out, and what has no vector
    has no wrong score.
    """
    spark = found.sparkSession
    whole = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), F.col(v)).alias(v)
    path = scratch_path(spark, "check-vectors")
    vectors.filter(F.col("chunk_id").isNotNull()).select("chunk_id", whole("vector")).write.options(**SMALL_GROUPS).parquet(path)
    listed = found.filter(F.col("chunk_id").isNotNull()).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("kb_id", "rank", "chunk_id", "score"))).alias("hits"))
    starts = F.transform("hits", lambda h, i: (i == 0) | ~h["kb_id"].eqNullSafe(F.get("hits", i - 1)["kb_id"]))
    asked = listed.join(queries.select("query_id", whole("vector")), "query_id").select(
        "query_id", "vector", F.col("hits.chunk_id").alias("chunks"), F.col("hits.score").alias("scores"), starts.alias("starts"))
    return asked.mapInArrow(_compared(path, tolerance), CHECKED).groupBy("query_id").agg(
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong_scores"), F.coalesce(F.max("odd"), F.lit(0)).alias("out_of_order"),
        (F.count("*") > 0).alias("any_hits"))


def _compared(path: str, tolerance: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hits = [], 0
        for batch in batches:
            held.append(batch)
            hits += len(batch["chunks"].flatten())
            if hits >= BLOCK_HITS:
                yield _compare(pa.Table.from_batches(held), path, tolerance)
                held, hits = [], 0
        if hits:
            yield _compare(pa.Table.from_batches(held), path, tolerance)

    return compare


def _compare(rows: pa.Table, path: str, tolerance: float) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    chunks, scores, starts, vectors = (rows[name].chunk(0) for name in ("chunks", "scores", "starts", "vector"))
    question = np.repeat(np.arange(len(rows)), chunks.value_lengths().to_numpy())
    chunks, scores, starts = (x.flatten().to_numpy(zero_copy_only=False) for x in (chunks, scores, starts))
    known, asked = _units(vectors, None)
    order = np.argsort(chunks, kind="stable")
    wrong, stored = np.zeros(len(rows), np.int64), np.zeros(len(chunks), bool)
    for batch in read_batches(path, BATCH_VECTORS):
        comparable, unit = _units(batch["vector"], asked.shape[1])
        first, end = (np.searchsorted(chunks, batch["chunk_id"].to_numpy(), side, sorter=order) for side in ("left", "right"))
        many = end - first
        vector = np.repeat(np.arange(len(many)), many)
        hit = order[np.repeat(end - np.cumsum(many), many) + np.arange(len(vector))]
        stored[hit] = True
        both = comparable[vector] & known[question[hit]]
        vector, hit = vector[both], hit[both]
        for at in range(0, len(hit), PAIRS):
            some = hit[at:at + PAIRS]
            cosine = np.einsum("nd,nd->n", unit[vector[at:at + PAIRS]], asked[question[some]])
            off = ~(np.abs(cosine - scores[some]) <= tolerance)
            wrong += np.bincount(question[some[off]], minlength=len(rows))
    base, kept = np.cumsum(starts), np.flatnonzero(stored)
    odd = (base[kept[1:]] == base[kept[:-1]]) & (scores[kept[:-1]] < scores[kept[1:]])
    odd = np.bincount(question[kept[1:][odd]], minlength=len(rows))
    some = np.unique(question[kept])
    return pa.RecordBatch.from_arrays(
        [rows["query_id"].chunk(0).take(pa.array(some)), pa.array(wrong[some]), pa.array(odd[some])], ["query_id", "wrong", "odd"])


def _units(vectors: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector of ``dims`` numbers, or as many as the first, and those vectors at length one."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy()
    if dims is None:
        dims = next((size for size in sizes if size >= 0), 0)
    held = sizes == dims
    matrix = np.zeros((len(sizes), dims))
    matrix[held] = vectors.filter(pa.array(held)).flatten().to_numpy().reshape(-1, dims)
    return held, _unit(matrix)


def merge_candidates(hits: DataFrame, position: Column) -> DataFrame:
    """Several ranked groups to one list per question.

    A chunk found twice keeps its first occurrence (earlier group, then earlier rank), not its best
    score. Order: score descending, then the id as text. Hits that lie by question already, as a search leaves
    them, are not shuffled.
    """
    first = F.min_by(F.struct("kb_id", "score"), F.struct(position, F.col("rank"))).alias("_f")
    merged = hits.groupBy("query_id", "chunk_id").agg(first).select("query_id", "chunk_id", "_f.kb_id", "_f.score")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id").cast("string"))
    return merged.withColumn("merged_rank", F.row_number().over(order))


def distinct_queries(queries: DataFrame, models: DataFrame) -> DataFrame:
    """One row per (text, model) that has to be embedded, however many knowledge bases share it."""
    return queries.join(models, "tenant_id").select("query_norm", "lookup_model").distinct()


def score_gate(ranked: DataFrame, ratio: Column) -> DataFrame:
    """Keep the first candidate and those within ``ratio`` of it; off for ratio 0 or a best score <= 0."""
    best = F.first("score").over(W.partitionBy("query_id").orderBy("merged_rank"))
    rows = ranked.withColumn("_best", best).withColumn("_ratio", ratio)
    off = (F.col("_ratio") <= 0) | (F.col("_best") <= 0)
    keep = off | (F.col("merged_rank") == 1) | (F.col("score") >= F.col("_best") * F.col("_ratio"))
    return rows.filter(keep).drop("_best", "_ratio")


def select_context(
    ranked: DataFrame, *, max_chunks: int | Column = CONTEXT_CHUNKS, token_budget: int | Column = TOKEN_BUDGET,
    ratio: Column | None = None
) -> DataFrame:
    """The chunks that go into the context: gate, then at most ``max_chunks``, then the token budget.

    Each bound is a number for all questions or a column of their own settings.

    Needs a ``tokens`` column. The first chunk always goes in; the list ends at the first chunk that
    would overflow. Token counts are never negative, so that end is where the running sum passes.
    """
    gated = score_gate(ranked, F.lit(0.0) if ratio is None else ratio)
    order = W.partitionBy("query_id").orderBy("merged_rank")
    placed = gated.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max_chunks)
    used = F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("used_tokens", used).filter((F.col("position") == 1) | (F.col("used_tokens") <= token_budget))


def question_settings(queries: DataFrame, kbs: DataFrame) -> DataFrame:
    """query_id and the retrieval parameters of the first knowledge base that its tenant can search.

    ``kbs``: tenant_id, kb_id, config of the bases that are available. A tenant without one has no row.
    """
    names = ("top_k", "context_chunks", "context_token_budget", "min_score_ratio")
    first = rag_settings(kbs).groupBy("tenant_id").agg(F.min_by(F.struct(*names), "kb_id").alias("_p"))
    return queries.select("query_id", "tenant_id").join(first, "tenant_id").select("query_id", "_p.*")


def retrieve(queries: DataFrame, vectors: DataFrame, kbs: DataFrame, chunks: DataFrame, payload: list[str]) -> DataFrame:
    """The context of each question under its own settings, with what the answer needs to show of each chunk.

    ``chunks``: chunk_id, tokens and the ``payload`` columns, such as name, version, content, page, path.
    The search runs once, to the largest top_k there is.
    """
    asked = question_settings(queries, kbs)
    hits = nearest_chunks(queries, vectors, MAX_TOP_K).join(asked, "query_id").filter(F.col("rank") <= F.col("top_k"))
    ranked = merge_candidates(hits, F.col("kb_id")).join(asked, "query_id").join(chunks.select("chunk_id", "tokens"), "chunk_id")
    chosen = select_context(
        ranked, max_chunks=F.col("context_chunks"), token_budget=F.col("context_token_budget"), ratio=F.col("min_score_ratio"))
    return with_payload(chosen.select("query_id", "chunk_id", "kb_id", "score", "position", "used_tokens"), chunks, payload)


def retrieval_trace(queries: DataFrame, candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """Per question: candidates, chunks in context, tokens used, best score and spread."""
    found = candidates.groupBy("query_id").agg(
        F.count("*").alias("candidates"), F.max("score").alias("top_score"), (F.max("score") - F.min("score")).alias("spread")
    )
    used = selected.groupBy("query_id").agg(F.count("*").alias("selected"), F.max("used_tokens").alias("tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return queries.select("query_id").join(found, "query_id", "left").join(used, "query_id", "left").select(
        "query_id", zero("candidates"), zero("selected"), zero("tokens"), "top_score", "spread"
    )


def fuse(lists: list[DataFrame], *, damping: int = 60, keep: int = 24) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, chunk_id, rank)."""
    union = None
    for ranked in lists:
        part = ranked.select("query_id", "chunk_id", (1.0 / (damping + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("rrf"))
    order = W.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("chunk_id").cast("string"))
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def rerank(candidates: DataFrame, make_scorer, *, threshold: float = 0.3, keep: int = 8) -> DataFrame:
    """Score (question, content) pairs with a pluggable model; below the threshold nothing is context."""
    from pyspark.ml.functions import predict_batch_udf

    scorer = predict_batch_udf(make_scorer, return_type=T.DoubleType(), batch_size=64)
    scored = candidates.withColumn("rerank_score", scorer(F.col("question"), F.col("content")))
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.col("chunk_id").cast("string"))
    return scored.filter(F.col("rerank_score") >= threshold).withColumn(
        "position", F.row_number().over(order)
    ).filter(F.col("position") <= keep)


def border(left: str, right: str) -> int:
    """Length of the longest end of ``left`` that ``right`` begins with, in linear time.

    A few places where the first characters of ``right`` stand in ``left`` are tried one by one. If there are more,
    the prefix function of ``right`` says where to go on after a mismatch, so no character of ``left`` is read twice.
    """
    longest = min(len(left), len(right))
    left, right = left[len(left) - longest:], right[:longest]
    place = left.find(right[:HEAD])
    for _ in range(TRIES):
        if place < 0:
            return next((n for n in range(min(longest, HEAD - 1), 0, -1) if left.endswith(right[:n])), 0)
        if right.startswith(left[place:]):
            return longest - place
        place = left.find(right[:HEAD], place + 1)
    fall, k = [0] * longest, 0
    for i in range(1, longest):
        while k and right[i] != right[k]:
            k = fall[k - 1]
        k += right[i] == right[k]
        fall[i] = k
    k = 0
    for c in left:
        while k and c != right[k]:
            k = fall[k - 1]
        k += c == right[k]
    return k


@F.pandas_udf(T.IntegerType())
def _seam(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([border(a, b) if a and b else 0 for a, b in zip(left, right)], dtype="int32")


def merge_adjacent(selected: DataFrame) -> DataFrame:
    """Neighbouring chunks of a document become one passage; text repeated at the seam is left out.

    ``selected``: query_id, doc_id, seq, content. A context holds at most 50 chunks per question.
    """
    order = W.partitionBy("query_id", "doc_id").orderBy("seq")
    joined = selected.withColumn("_gap", F.coalesce(F.col("seq") - F.lag("seq").over(order), F.lit(0)) != 1)
    joined = joined.withColumn("_prev", F.when(~F.col("_gap"), F.lag("content").over(order)))
    joined = joined.withColumn("_seam", _seam("_prev", "content"))
    joined = joined.withColumn("_island", F.sum(F.col("_gap").cast("int")).over(order))
    part = F.struct("seq", F.expr("substr(content, _seam + 1)").alias("t"))
    passages = F.transform(F.array_sort(F.collect_list(part)), lambda s: s["t"])
    return joined.groupBy("query_id", "doc_id", "_island").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.array_join(passages, "").alias("passage")
    ).drop("_island")


def evaluate(golden: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Recall@k and reciprocal rank per golden question; a question without hits scores 0."""
    hits = results.filter(F.col("rank") <= k).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    joined = golden.join(hits, ["query_id", "chunk_id"], "left")
    return joined.groupBy("query_id").agg(
        (F.count("rank") / F.count("*")).alias("recall"), F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("mrr")
    )


def evaluation_summary(per_query: DataFrame, k: int) -> DataFrame:
    return per_query.agg(F.lit(k).alias("k"), F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"))


def cross_language_share(hits: DataFrame, query_lang: DataFrame, doc_lang: DataFrame) -> DataFrame:
    """Share of hits whose document is in another language than the question, per question language."""
    joined = hits.join(query_lang, "query_id").join(doc_lang, "chunk_id")
    return joined.groupBy("query_lang").agg(
        F.count("*").alias("hits"), F.avg((F.col("query_lang") != F.col("doc_lang")).cast("int")).alias("cross_share")
    )
