"""Mixing sources to target weights by weighted fair queueing.

Each source's documents queue in a shuffled order, and a document's virtual finish time is the cumulative
size of its source up to and including it, divided by the source's target. In the order of finish times all
sources advance in proportion to their targets; the mix is that order, cut off at the total budget. A source
that is wanted more than once over queues again behind itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from marginalia.functions.skew import running_sum
from marginalia.session import materialise

#: Rows of a source that are put in order by one task, about.
BUCKET_ROWS = 500
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_key(seed: str) -> Column:
    """A place in the shuffled order, from the document alone."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))))


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """_source, _rank, _rows, _source_size, _target: ``share`` of all sizes, dealt by weight, no source above its limit.

    What sources cannot take is dealt again to the others by weight. The level at which that ends is the
    largest of (budget - limits of the sources before) / (weights of the others), over the sources in order
    of limit per weight.
    """
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_rows"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name))
    place = (F.col("_rank") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    limited = ranked.withColumn("_weight", weight).withColumn("_limit", F.col("_source_size") * repeats)
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    before = F.coalesce(F.sum("_limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("_weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("_source_size").over(everything) - before) / after
    leveled = limited.withColumn("_level", level).withColumn("_level", F.max("_level").over(everything))
    return leveled.select(
        "_source", "_rank", "_rows", "_source_size",
        F.least(F.col("_limit").cast("double"), F.col("_level") * F.col("_weight")).alias("_target"))


def _finish(turn: int) -> Column:
    """Virtual finish time of a document's turn (0, 1, ...); a source that gets nothing has no second turn."""
    sofar = F.col("_sofar") + turn * F.col("_source_size")
    return F.when(F.col("_target") > 0, sofar / F.col("_target")).otherwise(F.lit(1e300 if turn else 0.0))


def _range_of(finish: Column, n: int) -> Column:
    """A number that never falls as finish times rise, with about ``n`` steps up to 1 and between powers of 2."""
    return F.when(finish < 1, F.floor(finish * n)).otherwise(n + F.floor(n * F.log2(finish))).cast("long")


def _bucket() -> Column:
    """A stretch of the source's shuffled order with about BUCKET_ROWS rows, however many the source has."""
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    return F.floor(place * F.ceil(F.col("_rows") / BUCKET_ROWS) / (1 << 32))


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds _sofar, _rank, _source_size, _target to rows of _source, _size, _key."""
    named = sources.withColumnRenamed("_source", "_s")
    known = rows.join(named, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    return running_sum(known, ["_source"], _bucket(), [F.col("_key"), F.col("_size")], F.col("_size"), "_sofar")


def _cut(placed: DataFrame, repeats: int, budget: float, ranges: int) -> Row | None:
    """The last place of the global order that the budget covers; None if it covers nothing."""
    turns = F.explode(F.array(*[
        F.struct(F.lit(t).alias("turn"), _finish(t).alias("finish")) for t in range(repeats)])).alias("t")
    queue = placed.select("_size", "_rank", "_key", turns).select(
        F.col("t.finish").alias("finish"), "_rank", "_key", "_size", F.col("t.turn").alias("turn"),
        _range_of(F.col("t.finish"), ranges).alias("range"))
    totals = queue.groupBy("range").agg(F.sum("_size").alias("n"))
    upto = totals.select("range", "n", F.sum("n").over(Window.orderBy("range")).alias("total"))
    over = upto.filter(F.col("total") > budget).orderBy("range").first()
    place = F.struct("finish", "_rank", "_key", "_size", "turn")
    if over is None:
        return queue.agg(F.max(place).alias("p")).first().p
    inside = queue.filter(F.col("range") == over.range)
    order = Window.orderBy("finish", "_rank", "_key", "_size", "turn").rowsBetween(Window.unboundedPreceding, 0)
    fitting = inside.withColumn("total", F.sum("_size").over(order) + (over.total - over.n)).filter(F.col("total") <= budget)
    last = fitting.agg(F.max(place).alias("p")).first().p
    return last or queue.filter(F.col("range") < over.range).agg(F.max(place).alias("p")).first().p


def _turns_taken(cut: Row | None, repeats: int) -> Column:
    """How many of a document's turns stand at or before the cut."""
    if cut is None:
        return F.lit(0).cast("long")
    last = F.struct(F.lit(cut.finish).alias("finish"), F.lit(cut._rank).alias("_rank"), F.lit(cut._key).alias("_key"),
                    F.lit(cut._size).alias("_size"), F.lit(cut.turn).alias("turn"))
    taken = F.lit(0).cast("long")
    for t in range(repeats):
        here = F.struct(_finish(t).alias("finish"), "_rank", "_key", "_size", F.lit(t).alias("turn"))
        taken = taken + (here <= last).cast("long")
    return taken


def _scheduled(docs: DataFrame, weights: tuple[int, ...], share: float, repeats: int, seed: str, whole: bool) -> DataFrame:
    sized = [
        F.col("source").cast("string").alias("_source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        shuffle_key(seed).alias("_key"),
    ]
    doc_id = F.col("doc_id").cast("long").alias("_doc_id")
    rows = materialise(docs.select(doc_id, *sized), "mix-rows")
    sources = materialise(targets(rows, weights, share, repeats), "mix-sources")
    measured = rows.agg(F.count("*").alias("n"), F.sum("_size").alias("size")).first()
    placed = materialise(_placed(rows, sources), "mix-placed")
    cut = _cut(placed, repeats, share * (measured.size or 0), max(1, math.ceil(measured.n / BUCKET_ROWS)))
    if whole:
        placed = _placed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *sized), sources)
    return placed.withColumn("_turns", _turns_taken(cut, repeats))


def mix_shares(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2,
               seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, turns.

    Sizes count blank-separated words; a null text has none. Sources in the order of their names, null last,
    have the ``weights`` in turn, and the mix takes ``share`` of all sizes, no source more than ``repeats``
    times over. ``target`` is its source's share, ``taken`` the words that the mix takes of the document.

    Documents are taken whole, ``turns`` times. Finish times that tie are ordered by source, then by shuffled
    order, so reruns agree; rows alike in all of doc_id, text and source are interchangeable. Null ids are
    ids like others. An empty table gives an empty result; other columns are ignored.
    """
    placed = _scheduled(docs, weights, share, repeats, seed, whole=False)
    return placed.select(
        F.col("_doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_turns")).alias("taken"), F.col("_turns").alias("turns"))


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2,
          seed: str = "mix") -> DataFrame:
    """The mix itself: each document, with all its columns, as often as it is taken."""
    placed = _scheduled(docs, weights, share, repeats, seed, whole=True)
    taken = placed.filter("_turns > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_turns").cast("int"))))
    return taken.select([F.col("_row").getField(c).alias(c) for c in docs.columns])


#: The same in one global order.
ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5(concat_ws(':', 'mix', cast(doc_id as varchar), md5(text))) as k
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as r
  from d group by source
), w as (
  select *, case (r - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from s
), v as (
  select *, (1.5 * cast(sum(source_size) over () as double)
             - cast(coalesce(sum(2 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as double))
            / cast(sum(weight) over (o rows between current row and unbounded following) as double) as lv
  from w window o as (order by cast(2 * source_size as double) / weight, r)
), t as (
  select *, least(cast(2 * source_size as double), max(lv) over () * weight) as target from v
), c as (
  select row_number() over () as rid, d.doc_id, d.size, d.k, t.source_size, t.target, t.r,
         sum(d.size) over (partition by d.source order by d.k, d.size rows unbounded preceding) as sofar
  from d join t on d.source is not distinct from t.source
), q as (
  select c.*, e, case when target > 0 then cast(sofar + e * source_size as double) / target
                      when e = 0 then 0.0 else 1e300 end as f
  from c, (values (0), (1)) as turns(e)
), g as (
  select *, sum(size) over (order by f, r, k, size, e rows unbounded preceding) as total from q
)
select doc_id, cast(any_value(size) as bigint) as size, any_value(source_size) as source_size,
       any_value(target) as target,
       cast(any_value(size) * count(*) filter (where total <= 1.5 * (select sum(size) from d)) as bigint) as taken,
       count(*) filter (where total <= 1.5 * (select sum(size) from d)) as turns
from g group by rid, doc_id
"""
