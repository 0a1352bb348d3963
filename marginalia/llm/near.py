"""Near-duplicate groups by circulant MinHash, confirmed on full shingle sets.

Two permutations of the ring of 32-bit numbers make all signature coordinates: the first scatters the
shingles, the second, shifted around the ring by one step per coordinate, orders them; a coordinate is the
least place. Coordinates are cut into bands, and texts that share a band are candidates. Every link is
confirmed as intersection / union of the whole shingle sets, and groups are connected components of links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import words as W
from marginalia.session import materialise

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**40, about 1e-7.
BANDS, ROWS = 40, 5
_SHIFT = np.uint32(0x9E3779B1)


def _scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit ring."""
    x = x ^ (x >> np.uint32(17))
    x = x * np.uint32(0xED5AD4BB)
    x = x ^ (x >> np.uint32(11))
    return x * np.uint32(0xAC4C1B51)


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """``size`` coordinates of a set of 64-bit shingles, from two permutations and a shift per coordinate."""
    places = _scatter((shingles >> np.uint64(32)).astype(np.uint32))
    shifts = (np.arange(size, dtype=np.uint32) * _SHIFT)[:, None]
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(places), 512):
        x = places[None, at : at + 512] - shifts
        y = x >> np.uint32(16)
        x ^= y
        x *= np.uint32(0x7FEB352D)
        np.right_shift(x, np.uint32(15), out=y)
        x ^= y
        x *= np.uint32(0x846CA68B)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def _bands(signed: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in signed.reshape(BANDS, ROWS).T:
        keys = W.mix(keys * W.BASE + column)
    return keys.view(np.int64)


_SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
])
_SETS = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("own", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType())),
])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))


def _sign(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, bands = [], [], []
            for part in W.words(batch.column(1), W.BLANK_SEPARATED):
                for a, b in zip(part.offsets[:-1], part.offsets[1:]):
                    found = W.shingles(part.hashes[a:b], size)
                    counts.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    bands.append(_bands(signature(found)) if len(found) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), _lists(bands)],
                names=_SIGNED.names,
            )

    return sign


def _collect_sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.words(batch.column(1), W.BLANK_SEPARATED):
                rows = [W.shingles(part.hashes[a:b], size) for a, b in zip(part.offsets[:-1], part.offsets[1:])]
                ids = batch.column(0).slice(part.first, len(rows)).cast(pa.int64())
                own = [int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little", signed=True) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own, pa.int64()), _lists([r.view(np.int64) for r in rows])], names=_SETS.names)

    return sets


def connected(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over links (a, b).

    Each round every node takes the least component among its neighbours' and then its component's own
    component, so chains halve; what a round made is written to the shared folder.
    """
    both = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "near-links")
    at = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("component")), "near-components")
    while True:
        near = both.join(at.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node"))
        step = at.join(near.agg(F.min("component").alias("m")), "node").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        roots = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = materialise(step.join(roots, "component").select("node", "old", F.col("root").alias("component")),
                             "near-components")
        at = jumped.select("node", "component")
        if jumped.filter("old <> component").isEmpty():
            return at


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which any two whole sets agree to at least ``percent``."""
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return pairs.join(right, "b").join(left, "a").filter(100 * common >= percent * union).select("a", "b").distinct()


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Sets whose sizes differ by more cannot reach the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest shingles; every link is among them.

    Two sets of n and m elements that agree to ``percent`` share an element among the first
    n - ceil(n * percent / 100) + 1 and the like of m, in any order of elements. Rarest first, a passage that
    many texts share stands last, and texts with nothing else in common make no pair. What stands from the
    first common element on bounds what two sets can share, which leaves out texts that share a passage and
    have too much of their own.
    """
    held = sets.join(nodes, "node").select(
        "node", "own", F.size("shingles").alias("n"), "component", F.explode("shingles").alias("shingle"))
    seen = materialise(
        held.groupBy("shingle").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .filter("f > 1"), "near-shingles")
    ranked = held.join(seen, "shingle", "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("node", "own").orderBy(F.coalesce("f", F.lit(1)), "shingle")))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = materialise(ranked.filter(F.col("place") <= first).filter("lo < hi")
                       .select("shingle", "node", "n", "component", (F.col("n") - F.col("place") + 1).alias("left")), "near-rare")
    other = rare.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "component", "left")])
    most = F.least("left", "left_b")
    return (
        rare.join(other, "shingle").filter("node < node_b and component <> component_b")
        .filter((100 + percent) * most >= percent * (F.col("n") + F.col("n_b")))
        .select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()
    )


def _shared_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from the class of each text to its doc_id, for documents whose rows differ in their sets."""
    live = signed.filter("doc_id is not null")
    sets = F.xxhash64(F.coalesce("set_key", F.lit(b"")))
    several = live.groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).filter("lo < hi").select("doc_id")
    of = live.filter("n_shingles > 0").select("doc_id", "set_key").join(several, "doc_id", "left_semi").distinct()
    return of.join(classes.select("set_key", "node"), "set_key").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct runs of
    ``size`` blank-separated words, A-Z lower-cased; with fewer words the whole sequence is the one run.
    ``component_id`` is the least doc_id reachable, ``kept`` marks the document that has it.

    Null and empty texts have no shingle and no link. Rows that share a doc_id are one document, linked as
    any of its texts is. A row without doc_id takes part in no group: its component is null and it is kept.
    Other columns are ignored; an empty table gives an empty result.

    Equal sets are one class, so copies cost one row each. In a bucket of texts that share a band, all are
    first compared with the most central one, the one with most company over all its buckets; pairs within
    one component found so need no look, and only pairs of different components that share one of their
    rarest shingles are compared one by one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_sign(size), _SIGNED), "near-signed")
    classes = materialise(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "near-classes",
    )
    joined = F.explode("bands").alias("bucket")
    shared = materialise(
        classes.select("node", joined).groupBy("bucket").agg(
            F.count("*").alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"),
        "near-buckets")
    members = materialise(classes.select("node", "n", joined).join(shared.select("bucket", "m"), "bucket"), "near-members")
    company = members.groupBy("node").agg(F.sum("m").alias("company"))
    members = members.join(company, "node")
    centre = members.groupBy("bucket").agg(F.max(F.struct("company", "n", "node")).alias("c"))
    star = (
        members.join(centre, "bucket").filter("node <> c.node").filter(_fits(F.col("n"), F.col("c.n"), percent))
        .select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
    )
    star = materialise(star, "near-star")
    wanted = members.select("node").distinct()
    sets = materialise(
        docs.join(wanted, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(_collect_sets(size), _SETS)
        .filter(F.size("shingles") > 0).dropDuplicates(["node", "own"]), "near-sets")
    same = materialise(_shared_ids(signed, classes), "near-same")
    links = materialise(_confirmed(star, sets, percent).union(same), "near-links")
    at = connected(links)

    labelled = members.join(at, "node", "left").select(
        "bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    mixed = materialise(
        labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi"),
        "near-mixed")
    unsettled = materialise(labelled.join(mixed.select("bucket"), "bucket").select("node", "component").distinct(), "near-open")
    rest = _rare_pairs(unsettled, sets, percent)
    done = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _confirmed(rest.join(done, ["a", "b"], "left_anti"), sets, percent)
    at = connected(links.union(more))

    by_class = classes.join(at, "node", "left").select(
        F.col("set_key").alias("_key"), F.coalesce("component", "node").alias("component_id"))
    # a row without words goes with the other rows of its document
    wordless = F.concat(F.lit("document without words "), F.col("doc_id").cast("string")).cast("binary")
    by_id = same.select(F.col("b").alias("node")).distinct().join(at, "node").select(
        F.concat(F.lit("document without words "), F.col("node").cast("string")).cast("binary").alias("_key"),
        F.col("component").alias("component_id"))
    found = signed.join(by_class.union(by_id), (F.coalesce("set_key", wordless) == F.col("_key")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
