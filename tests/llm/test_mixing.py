"""Shares, limits and the order of the mix."""

import random

import duckdb
import pandas as pd
import pytest

from marginalia.llm import mixing


def _rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def _want(rows):
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, text, source from frame")
    return sorted(con.execute(mixing.ORACLE).fetchall(), key=repr)


def _got(docs, **how):
    found = mixing.mix_shares(docs, **how).collect()
    return sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken, r.turns) for r in found), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_one_global_order(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "é", "Z", "zz"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 9, 40])), rng.choice(names[: rng.randint(1, 6)])) for i in range(300)]
    docs = _rows(spark, rows)
    got = _got(docs)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in _want(rows)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in _want(rows)])
    assert sum(g[4] for g in got) <= 1.5 * sum(g[1] for g in got)
    by_source = {}
    for r in mixing.mix_shares(docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        taken, _, most = by_source.get(r.source, (0, 0, 0))
        by_source[r.source] = taken + r.taken, r.target, max(most, r["size"])
        assert r.taken in (0, r["size"], 2 * r["size"])
    for taken, target, most in by_source.values():
        assert abs(taken - target) <= 3 * most


def test_targets_stop_at_twice_the_source(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w " * 90, "c")]
    found = {r.doc_id: r.target for r in mixing.mix_shares(_rows(spark, rows)).collect()}
    assert found[1] == 20.0 and found[3] == 180.0 and found[2] == pytest.approx(1.5 * 1100 - 200)


def test_buckets_do_not_change_the_mix(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 20)), rng.choice("aaab")) for i in range(500)]
    docs = _rows(spark, rows)
    whole = _got(docs)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert _got(docs) == whole == _got(docs.repartition(7))


def test_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", None), (None, None, None), (2, "", "t"), (3, " \n", "t"),
            (4, "w " * 300_000, "s"), (5, "x\x0by z", "s")]
    docs = _rows(spark, rows).selectExpr("*", "1 as size", "'q' as target", "2 as _size")
    assert [g[:3] + g[4:] for g in _got(docs)] == [w[:3] + w[4:] for w in _want(rows)]
    again = mixing.mixed(docs)
    assert again.columns == docs.columns
    assert again.count() == sum(g[5] for g in _got(docs))
    assert _got(docs.limit(0)) == [] and mixing.mixed(docs.limit(0)).count() == 0
    blank = _rows(spark, [(1, "", "a"), (2, None, "b")])
    assert [(g[1], g[3], g[4]) for g in _got(blank)] == [(0, 0.0, 0)] * 2
