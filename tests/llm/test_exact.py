"""The hash index against plain grouping of texts."""

import hashlib
import re

from pyspark.sql import functions as F

from marginalia.llm import exact
from tests.conftest import DATA


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), n in zip(rows, norm):
        group = [r[0] for r, m in zip(rows, norm) if m == n]
        keep = min((g for g in group if g is not None), default=None)
        out.append((d, keep, len(group), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, **how):
    rows = exact.exact_duplicates(df, **how).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows), key=repr)


def test_odd_rows(spark):
    rows = [(3, "a b"), (1, "a  b"), (2, "a\n\tb"), (2, "a\n\tb"), (4, None), (5, ""), (6, " "), (7, "\x0b"), (None, "a b"),
            (None, "q"), (None, "q"), (8, "a b"), (9, "A b"), (10, "é" * 300_000), (11, "é" * 300_000 + "\r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as bucket", "3 as keep_id")
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []


def test_small_buckets(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert found(df, capacity=3) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_directory_splits_only_overfull_buckets(spark):
    keys = [*range(40), *[(1 << 62) + i * (1 << 55) for i in range(20)], -1, -(1 << 61)]
    slots, depth = exact.directory(spark.createDataFrame([(k,) for k in keys * 2], "key long"), 8)
    held = spark.createDataFrame([(k,) for k in keys], "key long").join(
        slots, exact._slot(F.col("key"), depth) == F.col("slot")).collect()
    assert len(held) == len(keys)
    sizes = {}
    for r in held:
        sizes.setdefault((r.bucket, r.depth), []).append(r.key)
    assert all(len(v) <= 8 or r[1] == depth for r, v in sizes.items())
    assert len({d for _, d in sizes}) > 1
    for (bucket, d), members in sizes.items():
        assert {(k % 2**64) >> (64 - d) for k in members} == {bucket >> (depth - d)}


def test_texts_of_one_key_are_chained(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    index = exact.build_index(df, str(tmp_path / "index"))
    assert sorted((r.chain, r.keep_id, r.group_size) for r in index.collect())[0][0] == 1
    assert {(r.keep_id, r.group_size) for r in index.collect()} == {(1, 2), (2, 1)}
    assert found(df) == brute([(1, "a"), (2, "b"), (3, "a")])
