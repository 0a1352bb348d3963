import decimal

import pytest
from pyspark.sql import functions as F

from marginalia.functions.entries import plan_limits, price_table, retention_months
from marginalia.operators import chunk as K
from marginalia.operators import identity as I
from marginalia.operators import quota as Q
from marginalia.operators import retrieve as R
from marginalia.operators import usage as U
from tests.conftest import at

D = decimal.Decimal


def test_price_entries(spark):
    text = " a:1/2 ;;bad;neg:-1/1;x:y:0.15/0.60;nan:1/2/3;:1/2;a:3/4;noslash:5;"
    got = {r.model: (r.prompt_price, r.completion_price) for r in U.prices_from(spark, text).collect()}
    assert got == {"a": (D(3), D(4)), "x:y": (D("0.15"), D("0.60"))}
    assert price_table(spark.createDataFrame([("",)], "t string"), [], "t").count() == 0


@pytest.mark.parametrize("tokens, price, cost", [
    (1, "0.5", "0.000000"), (3, "0.5", "0.000002"), (5, "0.5", "0.000002"), (1000, "0.15", "0.000150"), (0, "1", "0.000000"),
])
def test_cost_rounds_half_even(spark, tokens, price, cost):
    df = spark.createDataFrame([(tokens, 0, D(price), D(0))], "p int, c int, pp decimal(14,8), cp decimal(14,8)")
    assert df.select(U.cost(F.col("p"), F.col("c"), F.col("pp"), F.col("cp"))).first()[0] == D(cost)


def test_unpriced_model_costs_null_and_null_user_is_one_bucket(spark):
    rows = [(1, "t", None, "llm", "m", 10, 5, at(0)), (2, "t", None, "llm", "m", 1, 1, at(1)), (3, "t", 7, "llm", "zz", 1, 1, at(2))]
    usage = spark.createDataFrame(rows, "id long, tenant_id string, user_id long, category string, model string, prompt_tokens int, completion_tokens int, created_at timestamp_ntz")
    daily = U.daily_rollup(U.price_usage(usage, U.prices_from(spark, "m:1/1")))
    got = {(r.user_id, r.model): (r.requests, r.cost) for r in daily.collect()}
    assert got == {(None, "m"): (2, D("0.000017")), (7, "zz"): (1, None)}
    report = U.usage_report(daily, "user", "2024-01-01", "2024-01-01").collect()
    assert [r.key for r in report] == ["7", "None"]
    again = U.refresh_rollup(U.refresh_rollup(daily, U.price_usage(usage, U.prices_from(spark, "m:1/1")), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")), U.price_usage(usage, U.prices_from(spark, "m:1/1")), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    assert sorted(map(str, again.collect())) == sorted(map(str, daily.collect()))


def test_report_keys_are_whitelisted(spark):
    with pytest.raises(ValueError):
        U.usage_report(spark.range(1), "tenant_id", "2024-01-01", "2024-01-02")
    with pytest.raises(ValueError):
        U.cost_report(spark.range(1), "user", "2024-01-01", "2024-01-02")


@pytest.mark.parametrize("config, target, overlap", [
    ('{"chunk":{"target_tokens":256,"overlap_tokens":32}}', 256, 32), ('{"chunk":{"target_tokens":true,"overlap_tokens":"9"}}', 512, 64),
    ('{"chunk":{"target_tokens":9,"overlap_tokens":900}}', 64, 63), ('{"chunk":{"target_tokens":5.5,"overlap_tokens":-4}}', 512, 0),
    ('{"chunk":{"target_tokens":99999999999999999999}}', 4000, 64), ('{"chunk":[1]}', 512, 64), ("{}", 512, 64), ("not json", 512, 64),
    ('{"chunk":{"target_tokens":null}}', 512, 64), ('{"chunk":{"target_tokens":64,"overlap_tokens":"x"}}', 64, 64),
])
def test_chunk_settings(spark, config, target, overlap):
    r = K.chunk_settings(spark.createDataFrame([(config,)], "config string")).first()
    assert (r.target_tokens, r.overlap_tokens) == (target, overlap)


def test_rag_settings(spark):
    config = '{"retrieval":{"top_k":999,"context_chunks":0,"context_token_budget":"5","min_score_ratio":0.25,"query_history_turns":false}}'
    r = R.rag_settings(spark.createDataFrame([(config,)], "config string")).first()
    assert (r.top_k, r.context_chunks, r.context_token_budget, r.min_score_ratio, r.query_history_turns) == (200, 1, 4500, 0.25, 1)


@pytest.mark.parametrize("settings, limit", [
    ('{"quota":{"documents":30}}', 30), ('{"quota":{"documents":null}}', None), ('{"quota":{"documents":true}}', 100), ('{"quota":{"documents":-1}}', 100),
    ('{"quota":{"documents":0}}', 0), ('{"quota":[]}', 100), ("{}", 100), ('{"quota":{"unknown":5}}', 100),
])
def test_quota_override(spark, settings, limit):
    tenants = spark.createDataFrame([("t", settings)], "tenant_id string, settings string")
    got = {r.resource: r.limit for r in Q.limits(tenants, "documents:100;storage_bytes: 5 ;bad;tokens_month:-1;messages_day:x").collect()}
    assert got == {"documents": limit, "storage_bytes": 5, "tokens_month": None, "messages_day": None, "streams": None}


def test_plan_and_thresholds(spark):
    line = spark.createDataFrame([("a:1;a: 2 ;b:;c:1:2;d:+3",)], "t string")
    assert {r.resource: r.limit for r in plan_limits(line, [], "t").collect()} == {"a": 2, "d": 3}
    assert Q.thresholds("100;80;x;0;101; 80") == [80, 100]


def test_alert_once_per_threshold_in_integers(spark):
    rows = [(i, "t", at(i), v) for i, v in enumerate([79, 0, 1, 10, 10, 50])]
    usage = spark.createDataFrame(rows, "id long, tenant_id string, created_at timestamp_ntz, v long")
    held = spark.createDataFrame([("t", "tokens_month", 100)], "tenant_id string, resource string, limit long")
    got = Q.threshold_alerts(usage, held, "tokens_month", F.col("v")).orderBy("threshold").collect()
    assert [(r.threshold, r.crossed_at, r.used) for r in got] == [(80, at(2), 80), (100, at(4), 100)]
    none = spark.createDataFrame([("t", "tokens_month", 0)], held.schema)
    assert Q.threshold_alerts(usage, none, "tokens_month", F.col("v")).count() == 0
    with pytest.raises(ValueError):
        Q.threshold_alerts(usage, held, "streams", F.col("v"))


def test_retention_and_cutoff(spark):
    line = spark.createDataFrame([("log:13;x;:5;z:0;neg:-1;audit: 84 ;log:1",)], "t string")
    assert {r.table_name: r.months for r in retention_months(line, [], "t").collect()} == {"log": 1, "audit": 84}
    now = F.lit("2024-03-31 10:00:00").cast("timestamp_ntz")
    assert str(spark.range(1).select(I.cutoff(F.lit(13), now)).first()[0]) == "2023-02-01"


def test_expiry_includes_the_boundary_and_spares_tables_without_policy(spark):
    parts = spark.createDataFrame([("log", "log_a", "2024-01-01"), ("log", "log_b", "2024-02-01"), ("log", "log_c", "2024-03-01"), ("msg", "msg_a", "2000-01-01"), ("log", "log_d", None)],
                                  "table_name string, partition string, upper_bound string").withColumn("upper_bound", F.col("upper_bound").cast("date"))
    policy = spark.createDataFrame([("log", 2)], "table_name string, months int")
    got = I.expired_partitions(parts, policy, F.lit("2024-04-09 00:00:00").cast("timestamp_ntz"))
    assert sorted((r.partition, r.action) for r in got.collect()) == [("log_a", "detach"), ("log_b", "detach")]
    assert I.expired_partitions(parts, policy, F.lit("2024-04-09 00:00:00").cast("timestamp_ntz"), drop=True).first()["action"] == "drop"


def test_periods(spark):
    now = F.lit("2024-12-31 23:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([(r,) for r in Q.RESOURCES], "resource string")
    got = {r.resource: (r.label, str(r.end)) for r in df.select("resource", Q.period_label(F.col("resource"), now).alias("label"), Q.resets_at(F.col("resource"), now).alias("end")).collect()}
    assert got["tokens_month"] == ("2024-12", "2025-01-01 00:00:00") and got["messages_day"] == ("2024-12-31", "2025-01-01 00:00:00")
    assert got["documents"][1] == got["streams"][1] == "None"
