"""Documents whose shingle sets agree to a share, joined by segments of parity sketches.

Every shingle toggles one bit of a wide sketch, so two sketches differ in no more bits than the sets differ in
elements. A sketch is cut into segments; sets of similar size (a band) have the same segments. Sets that differ in
at most d elements differ in at most d segments: of the d + 1 rarest segments that are not empty they share one.
Only those are joined. A short sketch of all shingles, folded, leaves out pairs that differ in too many bits, and
every link is confirmed on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import near
from marginalia.llm import words as W
from marginalia.session import materialise

#: Sets below this size are one band, whose segments hold one shingle each; every further band doubles the size.
FIRST_BAND, FINE = 64, 1 << 16
#: The least bits of the folded sketch.
FOLDED = 512
#: Shingles counted together, how often one must stand among so many to be reported (twice at least), and how many are
#: told to all tasks.
COUNTED, SEVERAL, COMMON = 1 << 20, 4, 1 << 16
#: Links of one document beyond which they are dealt to several tasks.
HUB = 512
#: Rows of a table of ids up to which it is sent to all tasks (some 40 bytes each); beyond, both sides are shuffled.
SENT = 500_000

_DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("shingle", T.LongType()), T.StructField("seen", T.LongType()),
])
_SKETCHED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("own", T.ArrayType(T.LongType())), T.StructField("below", T.ArrayType(T.LongType())),
    T.StructField("sketch", T.ArrayType(T.LongType())),
])


def most_apart(n: int, m: int, percent: int) -> int:
    """The most elements in which sets of n and m elements differ if they agree to ``percent``."""
    return (n + m) * (100 - percent) // (100 + percent)


def reach(n: int, percent: int) -> int:
    """The most elements in which any set can differ from one of n elements that it agrees with."""
    return most_apart(n, n * 100 // percent, percent)


def band(n: int) -> int:
    return max(0, (n // FIRST_BAND).bit_length())


def segments(level: int, percent: int) -> int:
    """Segments of a band: few enough to hold several shingles, and many enough that more than ``reach`` are not empty."""
    if level == 0:
        return FINE
    fill = {True: 1.0, percent < 80: 0.5, percent < 70: 0.125}[True]
    return int((FIRST_BAND << (level - 1)) / fill)


def sketch_words(shingles: np.ndarray, level: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of each segment that is not empty, where its shingles start); shingles are sorted, so segments are runs.

    A segment has 2**32 bits; its key is the exclusive or of a number for each set bit, so that a bit toggled
    twice is gone from it.
    """
    place = (shingles >> np.uint64(32)) * np.uint64(segments(level, percent)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    bits = W.mix((shingles & np.uint64(0xFFFFFFFF)) * W.BASE + np.uint64(1))
    parity = np.bitwise_xor.reduceat(bits, starts)
    return W.mix(parity + place[starts] * W.BASE + W.mix(np.uint64([level + 1]))).view(np.int64), starts


def folded(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The parity of all shingles on a power of two of bits, as 64-bit words; the halves of it give that on half the bits."""
    odd = np.bincount((W.mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded_bits(n: int) -> int:
    """Enough to tell sets that differ in a quarter of their elements from sets that differ in half of them."""
    return max(FOLDED, 1 << (n - 1).bit_length())


def rare_first(shingles: np.ndarray, level: int, percent: int, common: np.ndarray, seen: np.ndarray, count: int) -> np.ndarray:
    """Keys of the ``count`` rarest segments, by how often the least common of their shingles stands in the corpus.

    Any order that all sets follow is right; this one leaves what many documents share for the end.
    """
    keys, starts = sketch_words(shingles, level, percent)
    if not len(common):
        return keys[:count]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    often = np.minimum.reduceat(np.where(common[at] == shingles, seen[at], 0), starts)
    rare = np.flatnonzero(often == 0)
    if len(rare) >= count:
        return keys[rare[:count]]
    return keys[np.argsort(often, kind="stable")[:count]]


def _key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for part in W.words(batch.column(1), W.BLANK_SEPARATED):
        for a, b in zip(part.offsets[:-1], part.offsets[1:]):
            yield W.shingles(part.hashes[a:b], size)


def _counted(size: int):
    """One row per document, and rows of shingles that stand several times among those counted together."""

    def reported(held: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        often = times >= max(2, SEVERAL * int(times.sum()) / COUNTED)
        values, times = values[often].view(np.int64), times[often]
        none = [pa.nulls(len(values), k) for k in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(values), pa.array(times, pa.int64())], names=_DOCS.names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, n = [], set(), 0
        for batch in batches:
            sizes, keys = [], []
            for found in _sets(batch, size):
                sizes.append(len(found))
                keys.append(_key(found))
                if len(found) and keys[-1] not in known:  # copies count once
                    known.add(keys[-1])
                    held.append(found)
                    n += len(found)
                    if n >= COUNTED:
                        yield reported(held)
                        held, known, n = [], set(), 0
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), none, none], names=_DOCS.names)
        yield reported(held)

    return counted


def _sketched(size: int, percent: int, common: list[int], seen: list[int]):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.array(common, np.uint64), np.array(seen, np.int64)
        nothing = np.zeros(0, np.int64)
        for batch in batches:
            ids, sizes, keys, own, below, sketch = [], [], [], [], [], []
            for doc_id, found in zip(batch.column(0).cast(pa.int64()).to_pylist(), _sets(batch, size)):
                n = len(found)
                if n == 0 or doc_id is None:
                    continue
                count = reach(n, percent) + 1
                level = band(n)
                # smaller sets of the band below look for this one among their own segments
                low = level > 0 and n * percent <= 100 * ((FIRST_BAND << (level - 1)) - 1)
                alone = count == 1  # nothing but an equal set agrees with so small a one
                ids.append(doc_id)
                sizes.append(n)
                keys.append(_key(found))
                own.append(nothing if alone else rare_first(found, level, percent, *order, count))
                below.append(rare_first(found, level - 1, percent, *order, count) if low else nothing)
                sketch.append(folded(found, folded_bits(n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), near._lists(own),
                 near._lists(below), near._lists(sketch)], names=_SKETCHED.names)

    return sketched


def _apart(n: Column, m: Column, percent: int) -> Column:
    return F.floor((n + m) * (100 - percent) / (100 + percent))


def _halved(sketch: Column, other: Column) -> Column:
    """A sketch of twice the other's bits on as many bits as that has."""
    half = F.size(other)
    both = F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(sketch) > half, both).otherwise(sketch)


def _bits_fit(sketch: Column, other: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether two sketches differ in no more bits than sets of n and m elements may differ in elements."""
    short = [F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))) for i in range(FOLDED // 64)]
    words = F.zip_with(_halved(sketch, other), _halved(other, sketch), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    bits = F.when(F.greatest(F.size(sketch), F.size(other)) == FOLDED // 64, sum(short[1:], short[0])).otherwise(
        F.aggregate(words, F.lit(0), lambda s, x: s + x))
    return bits <= _apart(n, m, percent)


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose folded sketches do not differ in too many bits."""
    pairs = materialise(pairs.distinct(), "parity-candidates")
    of = lambda side: classes.select(
        F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    both = dealt_join(dealt_join(pairs, of("b"), "b"), of("a"), "a")
    return both.filter(_bits_fit(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def dealt_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Join on ``key``, which is unique in ``one``; keys with many rows are dealt to several tasks."""
    hubs = many.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HUB).select(
        F.col(key).alias("_hub"), F.ceil(F.col("_rows") / HUB).cast("int").alias("_deals"))
    turn = F.pmod(F.xxhash64(*[F.col(c) for c in many.columns if c != key]), F.coalesce("_deals", F.lit(1)))
    left = many.join(hubs, F.col(key) == F.col("_hub"), "left").withColumn("_deal", turn.cast("int")).drop("_hub", "_deals")
    right = one.join(hubs, F.col(key) == F.col("_hub"), "left").withColumn(
        "_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_hub", "_deals")
    return left.join(right, [key, "_deal"]).drop("_deal")


def _whole_sets(size: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, rows = [], []
            for node, key, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _sets(batch, size)):
                if _key(found) == key:  # an id may have other texts besides
                    nodes.append(node)
                    rows.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), near._lists(rows)], names=["node", "shingles"])

    return whole


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets agree to at least ``percent``; only their texts are read again."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialise(nodes.join(classes.select("node", "set_key"), "node"), "parity-wanted")
    sent = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    texts = docs.join(sent, F.col("doc_id") == F.col("node")).select("node", "text", "set_key")
    sets = materialise(
        texts.mapInArrow(_whole_sets(size), "node long, shingles array<long>").dropDuplicates(["node"]), "parity-sets")
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return dealt_join(dealt_join(pairs, right, "b"), left, "a").filter(100 * common >= percent * union).select("a", "b")


def _fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _across(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a bucket from different components whose sizes and sketches fit; the join emits no others."""
    left = members.join(classes.select("node", "sketch"), "node")
    right = left.select(*[F.col(c).alias(f"{c}_b") for c in ("bucket", "node", "n", "component", "sketch")])
    apart = (F.col("node") < F.col("node_b")) & (F.col("component") != F.col("component_b"))
    fits = _fits(F.col("n"), F.col("n_b"), percent)
    near_by = _bits_fit(F.col("sketch"), F.col("sketch_b"), F.col("n"), F.col("n_b"), percent)
    return left.join(right, [F.col("bucket") == F.col("bucket_b"), apart & fits & near_by]).select(
        F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def similar_classes(docs: DataFrame, *, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their set keys, classes of equal sets, links between classes); see ``similar_documents``."""
    if not 60 <= percent <= 100:
        raise ValueError("percent must be between 60 and 100")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = materialise(docs.mapInArrow(_counted(size), _DOCS), "parity-documents")
    # of bounded number; they only order the segments
    common = (
        counted.filter("shingle is not null").groupBy("shingle").agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "shingle").limit(COMMON).collect()
    )
    values = np.array([r["shingle"] for r in common], np.int64).view(np.uint64)
    by_value = np.argsort(values)
    seen = np.array([r["seen"] for r in common], np.int64)[by_value]
    known = counted.filter("n_shingles is not null").select("doc_id", "n_shingles", "set_key")
    sketched = docs.mapInArrow(_sketched(size, percent, values[by_value].tolist(), seen.tolist()), _SKETCHED)
    classes = materialise(
        sketched.groupBy("set_key").agg(
            F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "own", "below", "sketch")]), "parity-classes")

    keyed = classes.select("node", "n", F.explode(F.concat("own", "below")).alias("bucket"))
    shared = materialise(keyed.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "parity-buckets")
    members = materialise(keyed.join(shared, "bucket"), "parity-members")
    company = members.groupBy("node").agg(F.sum("m").alias("company"))
    members = members.join(company, "node")
    centre = members.groupBy("bucket").agg(F.max(F.struct("company", "n", "node")).alias("c"))
    star = (
        members.join(centre, "bucket").filter("node <> c.node").filter(_fits(F.col("n"), F.col("c.n"), percent))
        .select(F.col("c.node").alias("a"), F.col("node").alias("b"))
    )
    star = materialise(_close(star, classes, percent), "parity-star")
    links = materialise(_confirmed(star, docs, classes, size, percent), "parity-links")

    at = near.connected(links)
    labelled = members.join(at, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = materialise(
        labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        .select("bucket"), "parity-mixed")
    rest = materialise(labelled.join(mixed, "bucket"), "parity-open")
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialise(_across(rest, classes, percent).join(done, ["a", "b"], "left_anti"), "parity-pairs")
    more = _confirmed(pairs, docs, classes, size, percent)
    return known, classes.select("set_key", "node", "n"), materialise(links.union(more), "parity-links")


def similar_documents(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct runs of ``size``
    blank-separated words, A-Z lower-cased; with fewer words the whole sequence is the one run. ``component_id`` is
    the least doc_id reachable. ``percent`` is at least 60, below which too few segments of a sketch stay the same.

    Null and empty texts have no shingle and no link. Rows that share a doc_id are one document, linked as any of
    its texts is. A row without doc_id takes part in no group: its component is null. Texts are read whole, of any
    length. Other columns are ignored; an empty table gives an empty result.

    Equal sets are one class, so copies cost one row each. In a bucket of sets that share a segment, all are first
    compared with the one that has most company; only members of different components are then compared with each
    other, by their sketches inside the join, which hands on no pair whose sketches differ too much. A set
    whose rarest segments are fewer than the theorem asks for, because its shingles fell into too few of them, has a
    chance below 1e-14 for any text of over 64 shingles, and none to speak of below.
    """
    known, classes, links = similar_classes(docs, size=size, percent=percent)
    one_id = near._shared_ids(known, classes)
    at = near.connected(materialise(links.union(one_id), "parity-all-links"))
    by_class = classes.join(at, "node", "left").select(
        F.col("set_key").alias("_key"), F.coalesce("component", "node").alias("component_id"))
    # a row without words goes with the other rows of its document
    wordless = F.concat(F.lit("document without words "), F.col("doc_id").cast("string")).cast("binary")
    by_id = one_id.select(F.col("b").alias("node")).distinct().join(at, "node").select(
        F.concat(F.lit("document without words "), F.col("node").cast("string")).cast("binary").alias("_key"),
        F.col("component").alias("component_id"))
    found = known.join(
        by_class.union(by_id), (F.coalesce("set_key", wordless) == F.col("_key")) & F.col("doc_id").isNotNull(), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE = """
with recursive word as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
    from documents
),
shingle as (
    select doc_id, list_sort(list_distinct(
        case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end)) as s
    from word
),
class as (select min(doc_id) as node, s, len(s) as n from shingle where len(s) > 0 group by s),
each as (select node, n, unnest(s) as x from class),
link as (
    select a.node as a, b.node as b from each a join each b on a.x = b.x and a.node < b.node
    where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    group by a.node, b.node, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
edge as (select a, b from link union select b, a from link),
reach(node, other) as (select a, a from edge union select r.node, e.b from reach r join edge e on r.other = e.a),
component as (select node, min(other) as component_id from reach group by node)
select d.doc_id, cast(len(d.s) as bigint) as n_shingles,
       cast(coalesce(m.component_id, c.node, d.doc_id) as bigint) as component_id
from shingle d left join class c on d.s = c.s left join component m on m.node = c.node
"""
