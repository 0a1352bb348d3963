"""Two-level windows and replays against plain pandas, with one key holding most rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions.skew import last_n_before, previous_by_bucket, running_count, running_sum
from marginalia.operators import intake, quota, security
from tests.conftest import at


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return pd.DataFrame([
        (("hot" if rng.random() < 0.8 else rng.choice("abc")), i, at(rng.randrange(3000)), rng.randrange(100)) for i in range(600)
    ], columns=["k", "id", "ts", "v"])


def test_running_sum_and_count(spark, rows):
    df, order, bucket = spark.createDataFrame(rows), [F.col("ts"), F.col("id")], F.date_trunc("hour", "ts")
    got = running_count(running_sum(df, ["k"], bucket, order, F.col("v"), "s"), ["k"], bucket, order, "n").toPandas().sort_values("id")
    want = rows.sort_values(["ts", "id"])
    want["s"], want["n"] = want.groupby("k")["v"].cumsum(), want.groupby("k").cumcount() + 1
    want = want.sort_values("id")
    assert got["s"].tolist() == want["s"].tolist() and got["n"].tolist() == want["n"].tolist()


def test_running_sum_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "k string, o int, v int")
    got = running_sum(df, ["k"], F.col("o"), [F.col("o")], F.col("v"), "s").collect()
    assert sorted((r.k or "", r.s) for r in got) == [("", 5), ("", 11), ("a", 7)]


def test_previous_and_last_n(spark, rows):
    df, order, bucket = spark.createDataFrame(rows), [F.col("ts"), F.col("id")], F.date_trunc("hour", "ts")
    got = last_n_before(previous_by_bucket(df, ["k"], bucket, order, F.col("id"), "p"), ["k"], bucket, order, F.col("v"), 3, "last").collect()
    want = rows.sort_values(["ts", "id"])
    previous, last = {}, {}
    for _, group in want.groupby("k"):
        ids, values = group["id"].tolist(), group["v"].tolist()
        for i, ident in enumerate(ids):
            previous[ident], last[ident] = (ids[i - 1] if i else None), values[max(0, i - 3):i]
    assert {r.id: r.p for r in got} == previous and {r.id: r.last for r in got} == last


def test_lockouts_against_brute_force(spark):
    rng = random.Random(9)
    rows, clock = [], 0
    for i in range(900):
        clock += rng.choice([5, 60, 200, 400, 901])
        rows.append((i, "t", rng.choice(["u", "u", "u", "w"]), at(seconds=clock), rng.random() < 0.15))
    want = []
    for user in "uw":
        count, until, lock = 0, None, None
        for _, _, email, ts, ok in rows:
            if email != user:
                continue
            if until and ts >= until:
                count, until, lock = 0, None, None
            if lock:
                lock[2] += 1
            elif ok:
                count, until = 0, None
            else:
                count, until = count + 1, ts + pd.Timedelta(seconds=900)
                if count == 5:
                    lock = [user, ts, 0]
                    want.append(lock)
    df = spark.createDataFrame(rows, "event_id long, tenant_id string, email string, ts timestamp_ntz, ok boolean")
    got = sorted((r.email, r.locked_at, r.refused) for r in security.lockouts(df).collect())
    assert len(want) > 5 and got == sorted(map(tuple, want))


def test_token_reuse_grace_and_replay(spark):
    rows = [
        ("a", 1, at(0), 0, 1), ("a", 2, at(1), 1, 2), ("a", 3, at(1, 5), 1, 9), ("a", 4, at(2), 2, 3), ("a", 5, at(9), 1, 4), ("a", 6, at(10), 3, 5),
        ("b", 7, at(0), 0, 1), ("b", 8, at(3), 1, 2),
    ]
    df = spark.createDataFrame(rows, "family string, event_id long, ts timestamp_ntz, presented long, issued long")
    assert [tuple(r) for r in security.token_reuse(df).collect()] == [("a", at(9), "reuse", 3)]


def test_admission_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice("xxxy"), at(rng.randrange(5000)), rng.randrange(1, 400)) for i in range(300)]
    limits = [("x", 45, 9000, 2, 100), ("y", None, 4000, 0, 0)]
    want = {}
    for tenant, max_n, max_b, n, b in limits:
        for i, t, _, size in sorted(docs, key=lambda r: (r[2], r[0])):
            if t != tenant:
                continue
            if max_n is not None and n + 1 > max_n:
                want[i] = "documents"
            elif b + size > max_b:
                want[i] = "storage_bytes"
            else:
                n, b, want[i] = n + 1, b + size, None
    got = intake.admit(
        spark.createDataFrame(docs, "doc_id long, tenant_id string, created_at timestamp_ntz, size_bytes long"),
        spark.createDataFrame(limits, "tenant_id string, max_documents long, max_bytes long, used_documents long, used_bytes long"),
    ).collect()
    assert {r.doc_id: r.reason for r in got} == want and all(r.admitted == (r.reason is None) for r in got)
    assert {"documents", "storage_bytes", None} == set(want.values())


def test_unlimited_tenants_admit_everything(spark):
    docs = spark.createDataFrame([(1, "z", at(0), 10**12)], "doc_id long, tenant_id string, created_at timestamp_ntz, size_bytes long")
    none = spark.createDataFrame([], "tenant_id string, max_documents long, max_bytes long, used_documents long, used_bytes long")
    assert [(r.doc_id, r.admitted) for r in intake.admit(docs, none).collect()] == [(1, True)]


def test_reservations_summed_and_replayed_agree(spark):
    rng = random.Random(4)
    events = []
    for turn in range(200):
        amount, kind = rng.randrange(1, 50), rng.choice(["commit", "release", None])
        start = rng.randrange(0, 10000) * 1000 + turn
        events.append(("t", "tokens_month", "2024-01", turn, start, "reserve", amount, None))
        if kind:
            events.append(("t", "tokens_month", "2024-01", turn, start + rng.randrange(1, 300) * 1000, kind, amount, rng.randrange(0, 60) if kind == "commit" else None))
    df = spark.createDataFrame(events, "tenant_id string, resource string, period string, turn long, seq long, kind string, amount long, actual long")

    def replayed(limit):
        used = granted = denied = 0
        held = {}
        for _, _, _, turn, _, kind, amount, actual in sorted(events, key=lambda e: (e[4])):
            if kind == "reserve":
                if limit is not None and used + amount > limit:
                    denied += 1
                else:
                    used, granted, held[turn] = used + amount, granted + 1, amount
            elif turn in held:
                used = max(used - amount + (0 if kind == "release" else actual), 0)
                del held[turn]
        return used, granted, denied

    for limit in (None, 10**6, 900, 50):
        held = spark.createDataFrame([("t", "tokens_month", limit)], "tenant_id string, resource string, limit long")
        r = quota.replay_reservations(df, held).first()
        assert (r.used, r.granted, r.denied) == replayed(limit)
