"""Language of a document: script evidence first, then a character n-gram model trained as a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import materialise

KANA = r"[\u3040-\u30FF]"
HANGUL = r"[\uAC00-\uD7AF]"
MIN_CONFIDENCE = 0.5
FLUSH_ROWS = 200_000  # counted trigrams a task holds before it hands them on


def _counts(keys: list[str], names: list[str]) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, times, held = [], [], [], 0
            texts = batch.column(len(keys))
            for i in range(batch.num_rows):
                points = np.frombuffer((texts[i].as_py() or "").encode("utf-32-le"), "<u4").astype(np.int64)
                if len(points) >= 3:
                    grams, n = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
                    rows.append(np.full(len(grams), i))
                    found.append(grams)
                    times.append(n)
                    held += len(grams)
                if held and (held >= FLUSH_ROWS or i == batch.num_rows - 1):
                    at = pa.array(np.concatenate(rows))
                    numbers = [pa.array(np.concatenate(part).astype(np.int64)) for part in (found, times)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], *numbers], names=names)
                    rows, found, times, held = [], [], [], 0

    return count


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, gram, n: the different overlapping character trigrams of each row's lower-cased text.

    A gram is one number, 21 bits a code point. NULL and texts of fewer than three characters have none.
    """
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    return rows.select(*keys, F.lower("text").alias("text")).mapInArrow(_counts(keys, schema.names), schema)


def train(samples: DataFrame) -> DataFrame:
    """gram, scores (log probabilities, one a language), langs (the languages in that order) from (lang, text).

    Every trigram of the samples is in the model. Add-one smoothing. Texts without a language teach nothing.
    """
    seen = counted(samples.filter(F.col("lang").isNotNull()), ["lang"])
    kept = materialise(seen.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    common = kept.select("gram").distinct()
    totals = kept.groupBy("lang").agg(F.sum("n").alias("total"))
    have = kept.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("have"))
    rows = have.withColumn("totals", totals.agg(F.sort_array(F.collect_list(F.struct("lang", "total")))).scalar()).withColumn(
        "v", common.agg(F.count("*")).scalar()
    )
    scores = F.transform(
        "totals", lambda s: F.ln((F.coalesce(F.try_element_at("have", s["lang"]), F.lit(0)) + 1) / (s["total"] + F.col("v"))))
    return materialise(rows.select("gram", scores.alias("scores"), F.col("totals.lang").alias("langs")), "language-model")


def detect(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, language, confidence.

    Blank text is ``und``, kana means ``ja``, hangul means ``ko``; otherwise the best language of the
    model, or ``und`` if its normalised probability is below one half. Texts are written once to the shared
    folder, so that what makes them is not done twice. A text's different trigrams meet the model with their
    counts, and scores are added up side by side, a column a language. Without any
    language learned all other texts are ``und``.
    """
    rows = docs.select("doc_id", "text")
    script = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "und").when(F.col("text").rlike(KANA), "ja").when(F.col("text").rlike(HANGUL), "ko")
    marked = materialise(rows.withColumn("script", script), "scripts")
    known = model.select("langs").first()
    if known is None:
        return marked.select("doc_id", F.coalesce("script", F.lit("und")).alias("language"), F.lit(None).cast("double").alias("confidence"))
    asked = counted(marked.filter("script is null"), ["doc_id"])
    sums = asked.join(model.select("gram", "scores"), "gram").groupBy("doc_id").agg(*[
        F.sum(F.get("scores", F.lit(i)) * F.col("n")).alias(f"_s{i}") for i in range(len(known.langs))])
    each = F.array(*[F.struct(F.col(f"_s{i}").alias("score"), F.lit(lang).alias("lang")) for i, lang in enumerate(known.langs)])
    best = sums.withColumn("b", F.array_max(each))
    odds = reduce(Column.__add__, [F.exp(F.col(f"_s{i}") - F.col("b.score")) for i in range(len(known.langs))])
    guessed = best.select("doc_id", F.col("b.lang").alias("lang"), (1.0 / odds).alias("confidence"))
    joined = marked.select("doc_id", "script").join(guessed, "doc_id", "left")
    sure = F.when(F.col("confidence") >= MIN_CONFIDENCE, F.col("lang")).otherwise("und")
    return joined.select("doc_id", F.coalesce("script", sure).alias("language"), F.when(F.col("script").isNull(), F.col("confidence")).alias("confidence"))
