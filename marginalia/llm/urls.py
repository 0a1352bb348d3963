"""URL filters: rules first, and a ratio of character language models for what no rule decides.

One variable-order Markov model is learned from the URLs that rules accept and one from those they reject.
Each mixes the contexts of nought to five characters by how many different characters followed them. A URL is
accepted when its log likelihood difference per character reaches a calibrated threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import words as W
from marginalia.session import materialise

ORDER = 5
#: Counts of n-grams that every worker holds, at most; more stay in tables. Steps of the threshold in a unit of the difference.
HELD_GRAMS, STEPS = 4_000_000, 10_000
_SLICE = 1 << 18

_WANTED = T.StructType([
    T.StructField("_block", T.LongType()), T.StructField("order", T.IntegerType()),
    *[T.StructField(c, T.LongType()) for c in ("gram", "context", "shorter")],
])
_COUNTS = T.StructType([
    T.StructField("accepted", T.IntegerType()), T.StructField("order", T.IntegerType()),
    T.StructField("context", T.LongType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType()),
])


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


class Model(NamedTuple):
    """Per order: sorted n-grams with their counts, sorted contexts with totals and followers; a column per class."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    floor: float
    threshold: float


class Tables(NamedTuple):
    """The same as tables in the shared folder: order, gram, n0, n1 and order, context, s0, s1, k0, k1."""

    grams: DataFrame
    contexts: DataFrame
    floor: float
    threshold: float


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule (verdict, rule) for the host, or a domain above it, and the beginning of the path, or null.

    Of equally long rules the one given first counts.
    """
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for rule in sorted(rules, key=lambda r: -len(r.host + r.path))[::-1]:
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        made = F.struct(F.lit(rule.verdict).alias("verdict"), F.lit(rule.host + rule.path).alias("rule"))
        chosen = F.when(fits, made).otherwise(chosen)
    return chosen


def _flat(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix sums of hashed characters, place of each character, which URL it belongs to); each URL is padded."""
    pad = "\0" * ORDER
    joined = pad + pad.join(urls)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(W.mix(codes.astype(np.uint64) + np.uint64(1)) * W.power("up", len(codes)), out=total[1:])
    lengths = np.array([len(u) for u in urls])
    which = np.repeat(np.arange(len(urls)), lengths)
    return total, np.arange(len(which)) + ORDER * (which + 1), which


def _hashes(total: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return W.mix((total[starts + length] - total[starts]) * W.power("down", len(total))[starts] + np.uint64(length))


def _slices(urls: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(numbers, URLs) of a slice of characters; a longer URL is read in pieces."""
    numbers, parts, size = [], [], 0
    for number, url in enumerate(urls):
        for at in range(0, len(url or ""), _SLICE // 2):
            piece = url[at : at + _SLICE // 2]
            if parts and size + len(piece) + ORDER > _SLICE:
                yield np.array(numbers), parts
                numbers, parts, size = [], [], 0
            numbers.append(number)
            parts.append(piece)
            size += len(piece) + ORDER
    if parts:
        yield np.array(numbers), parts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        accepted = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
        for numbers, parts in _slices(batch.column(1).to_pylist()):
            total, places, which = _flat(parts)
            label = accepted[numbers[which]]
            for order in range(ORDER + 1):
                rows = np.stack([label.astype(np.uint64), _hashes(total, places - order, order),
                                 _hashes(total, places - order, order + 1)])
                rows, n = np.unique(rows, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0].astype(np.int32)), pa.array(np.full(len(n), order, np.int32)),
                     pa.array(rows[1].view(np.int64)), pa.array(rows[2].view(np.int64)), pa.array(n.astype(np.int64))],
                    names=_COUNTS.names)


def _tables(counted: pa.Table) -> tuple[list, list, float]:
    label, order, context, gram, n = (counted[c].to_numpy() for c in _COUNTS.names)
    grams, contexts = [], []
    for k in range(ORDER + 1):
        of = order == k
        known, at = np.unique(gram[of].view(np.uint64), return_inverse=True)
        counts = np.zeros((len(known), 2))
        np.add.at(counts, (at, label[of]), n[of])
        grams.append((known, counts))
        known, at = np.unique(context[of].view(np.uint64), return_inverse=True)
        totals, followers = np.zeros((len(known), 2)), np.zeros((len(known), 2))
        np.add.at(totals, (at, label[of]), n[of])
        np.add.at(followers, (at, label[of]), 1)
        contexts.append((known, totals, followers))
    return grams, contexts, 1 / (len(grams[0][0]) + 1)


def _looked_up(known: np.ndarray, values: tuple, hashes: np.ndarray) -> list[np.ndarray]:
    if not len(known):
        return [np.zeros((len(hashes), 2)) for _ in values]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    seen = known[at] == hashes
    return [np.where(seen[:, None], v[at], 0.0) for v in values]


def _differences(urls: list[str | None], chances: Callable) -> np.ndarray:
    sums, lengths = np.zeros(len(urls)), np.zeros(len(urls))
    for numbers, parts in _slices(urls):
        total, places, which = _flat(parts)
        gain = np.log(chances(total, places))
        sums += np.bincount(numbers[which], weights=gain[:, 1] - gain[:, 0], minlength=len(urls))
        lengths += np.bincount(numbers[which], minlength=len(urls))
    return sums / np.maximum(lengths, 1)


def differences(model: Model, urls: list[str | None]) -> np.ndarray:
    """Log likelihood as an accepted URL less that as a rejected one, per character; 0 for no character."""
    def chances(total: np.ndarray, places: np.ndarray) -> np.ndarray:
        chance = np.full((len(places), 2), model.floor)
        for order in range(ORDER + 1):
            (count,) = _looked_up(model.grams[order][0], model.grams[order][1:], _hashes(total, places - order, order + 1))
            seen, kinds = _looked_up(model.contexts[order][0], model.contexts[order][1:], _hashes(total, places - order, order))
            mass = seen + kinds
            chance = np.where(mass > 0, (count + kinds * chance) / np.maximum(mass, 1), chance)
        return chance

    return _differences(urls, chances)


def threshold(found: list[tuple[int, int, int]]) -> float:
    """The difference that parts both best: most of the accepted at or above it and of the rejected below it.

    ``found``: (step, accepted, rejected), how many differences lie in each step of 1 / ``STEPS``; the answer is
    in the middle between two steps that have any.
    """
    steps, accepted, rejected = (np.array(c, dtype=np.float64) for c in zip(*sorted(found))) if found else (np.zeros(0),) * 3
    if not accepted.sum() or not rejected.sum():
        return 0.0
    kept = 1 - np.concatenate([[0], np.cumsum(accepted)]) / accepted.sum()
    barred = np.concatenate([[0], np.cumsum(rejected)]) / rejected.sum()
    edges = np.concatenate([[steps[0] - STEPS], (steps[:-1] + 1 + steps[1:]) / 2, [steps[-1] + 1 + STEPS]])
    return float(edges[int(np.argmax(kept + barred))] / STEPS)


def _least_count(counted: DataFrame, most: int) -> int:
    """The least count such that no more than ``most`` n-grams are as frequent."""
    sizes = sorted(((r.n, r.grams) for r in counted.groupBy("n").agg(F.count("*").alias("grams")).collect()), reverse=True)
    held, least = 0, sizes[0][0] + 1 if sizes else 1
    for n, grams in sizes:
        held += grams
        if held > most:
            break
        least = n
    return least


def train(urls: DataFrame, *, most_grams: int | None = None, held_grams: int = HELD_GRAMS) -> Model | Tables | None:
    """Learn from ``urls`` (page_id, url, accepted); None unless there are both accepted and rejected ones.

    Every URL counts, whatever its length: four fifths of them, by a hash of page_id and url, in the models, the
    others in the threshold. All n-grams are counted and known: up to ``held_grams`` counts make a model that workers
    hold, more stay in tables. Only with ``most_grams`` is a model cut, to those that are most frequent. The counts
    by which the threshold is set are kept in steps.
    """
    rows = urls.filter((F.length("url") > 0) & F.col("accepted").isNotNull())
    rows = rows.select("accepted", "url", (F.pmod(F.xxhash64("page_id", "url"), F.lit(5)) == 4).alias("checked"))
    if rows.select("accepted").distinct().count() < 2:
        return None
    counted = materialise(
        rows.filter("not checked").select("accepted", "url").mapInArrow(_count, _COUNTS)
        .groupBy("accepted", "order", "context", "gram").agg(F.sum("n").cast("long").alias("n")).select(_COUNTS.names),
        "url-counts")
    if most_grams is not None:
        counted = counted.filter(F.col("n") >= _least_count(counted, most_grams))
    model = Model(*_tables(counted.toArrow()), 0.0) if counted.count() <= held_grams else _in_tables(counted)
    checked = scored(rows.filter("checked").select("accepted", "url"), model)
    steps = checked.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")).collect()
    return model._replace(threshold=threshold([(r.step, r.accepted, r.rejected) for r in steps]))


def _in_tables(counted: DataFrame) -> Tables:
    def of(label: int, value: Column) -> Column:
        return F.sum(F.when(F.col("accepted") == label, value).otherwise(F.lit(0))).cast("double")

    n, one = F.col("n"), F.lit(1)
    grams = materialise(counted.groupBy("order", "gram").agg(of(0, n).alias("n0"), of(1, n).alias("n1")), "url-grams")
    contexts = materialise(counted.groupBy("order", "context").agg(
        of(0, n).alias("s0"), of(1, n).alias("s1"), of(0, one).alias("k0"), of(1, one).alias("k1")), "url-contexts")
    return Tables(grams, contexts, 1 / (grams.filter("`order` = 0").count() + 1), 0.0)


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of a block; the URLs of a block are a slice of characters, or one longer URL."""
    number, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        numbers = []
        for url in batch.column("url").to_pylist():
            size = len(url or "") + ORDER
            if held and held + size > _SLICE:
                number, held = number + 1, 0
            held += size
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "_block"])


def _want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different n-grams of each block, with their context and the n-gram without the first character."""
    for batch in batches:
        of = batch.column(0).to_numpy()
        for numbers, parts in _slices(batch.column(1).to_pylist()):
            total, places, which = _flat(parts)
            block = of[numbers[which]]
            for order in range(ORDER + 1):
                gram = _hashes(total, places - order, order + 1).view(np.int64)
                _, first = np.unique(np.stack([block, gram]), axis=1, return_index=True)
                at = places[first]
                context, shorter = _hashes(total, at - order, order), _hashes(total, at - order + 1, order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[first]), pa.array(np.full(len(first), order, np.int32)), pa.array(gram[first]),
                     pa.array(context.view(np.int64)), pa.array(shorter.view(np.int64))], names=_WANTED.names)


def _chances(wanted: DataFrame, model: Tables) -> DataFrame:
    """gram, p0, p1 of the longest n-grams that are wanted, from those of each order before."""
    each = materialise(wanted.groupBy("order", "gram").agg(
        F.min("context").alias("context"), F.min("shorter").alias("shorter")), "url-wanted")
    known = None
    for order in range(ORDER + 1):
        of = F.col("order") == order
        rows = each.filter(of).drop("order").join(model.grams.filter(of).drop("order"), "gram", "left").join(
            model.contexts.filter(of).drop("order"), "context", "left")
        if known is None:
            rows = rows.withColumn("p0", F.lit(model.floor)).withColumn("p1", F.lit(model.floor))
        else:
            rows = rows.join(known.withColumnRenamed("gram", "shorter"), "shorter", "left")
        mixed = []
        for label in "01":
            count, seen, kinds = (F.coalesce(F.col(c + label), F.lit(0.0)) for c in "nsk")
            p, mass = F.col("p" + label), seen + kinds
            mixed.append(F.when(mass > 0, (count + kinds * p) / F.greatest(mass, F.lit(1.0))).otherwise(p).alias("p" + label))
        known = materialise(rows.select("gram", *mixed), f"url-chances-{order}")
    return known


def _score_block(rows: pa.Table, found: pa.Table) -> pa.Table:
    gram, chance = found["gram"].to_numpy(), np.stack([found["p0"].to_numpy(), found["p1"].to_numpy()], axis=1)
    order = np.argsort(gram)
    gram, chance = gram[order], chance[order]
    score = _differences(rows["url"].to_pylist(), lambda total, places: chance[
        np.searchsorted(gram, _hashes(total, places - ORDER, ORDER + 1).view(np.int64))])
    return rows.drop_columns(["_block"]).append_column("score", pa.array(score, pa.float64()))


def _scored_by_tables(rows: DataFrame, model: Tables, schema: T.StructType) -> DataFrame:
    """No task holds the model: the chances of the n-grams that a block of URLs has are joined and sent to it."""
    number = T.StructField("_block", T.LongType())
    blocks = materialise(rows.mapInArrow(_in_blocks, T.StructType([*rows.schema.fields, number])), "url-blocks")
    wanted = materialise(blocks.select("_block", "url").mapInArrow(_want, _WANTED), "url-lookups")
    longest = wanted.filter(F.col("order") == ORDER).select("_block", "gram").distinct()
    found = longest.join(_chances(wanted, model), "gram").select("_block", "gram", "p0", "p1")
    return blocks.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(_score_block, schema)


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = differences(Model(*shared.value), batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return score


def scored(rows: DataFrame, model: Model | Tables) -> DataFrame:
    """The rows with the ``score`` of their ``url``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    if isinstance(model, Tables):
        return _scored_by_tables(rows, model, schema)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))  # a plain tuple needs no class where it is read
    return rows.mapInArrow(_score(shared), schema)


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...], **how) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block), score.

    A URL's longest rule decides; what no rule decides is allowed when its score reaches the threshold of the
    models learned from the others. Null URLs and those without ``://`` have an empty host and path, which no
    rule fits; a null or empty URL has score 0. Without URLs of both verdicts to learn from, all scores are 0
    and all undecided URLs are allowed. Repeated rows each give a row; other columns are ignored.
    """
    urls = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    known = urls.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn(
        "path", F.coalesce(path_of(F.col("url")), F.lit("")))
    known = known.withColumn("decided", rule_of(F.col("host"), F.col("path"), rules))
    model = train(known.select("page_id", "url", (F.col("decided.verdict") == "allow").alias("accepted")), **how)
    columns = known.select("page_id", "url", "host", "path", F.col("decided.rule").alias("rule"),
                           F.col("decided.verdict").alias("verdict"))
    judged = scored(columns, model) if model else columns.withColumn("score", F.lit(0.0))
    level = model.threshold if model else 0.0
    own = F.when(F.col("score") >= level, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
