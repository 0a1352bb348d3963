"""Registered usage-ledger queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions.entries import price_table
from marginalia.operators import usage as U
from marginalia.operators.paging import page
from marginalia.operators.sinks import append_by_month, overwrite_partitions, upsert
from marginalia.plans import fixtures as fx
from marginalia.plans.fixtures import ntz
from marginalia.session import materialise, prepare, scratch_path
from marginalia.sources.tables import table, tenant_view

EXTRA = {
    # cost in whole millionths, half-even, by integer arithmetic on prices in 1e-8 units
    "px_priced": """
select *, case when pp is null then null else
    (q + case when r > 50000000 or (r = 50000000 and q % 2 = 1) then 1 else 0 end) end as micro from (
  select *, (prompt_tokens::hugeint * pp + completion_tokens::hugeint * cp) // 100000000 as q,
    (prompt_tokens::hugeint * pp + completion_tokens::hugeint * cp) % 100000000 as r
  from fx_usage left join (values ('click', 15000000::hugeint, 60000000::hugeint), ('view', 2000000, 0),
    ('purchase', 150000000, 250000000)) as p(m, pp, cp) on p.m = model)""",
    "px_daily": """
select tenant_id, created_at::date as day, user_id, category, model, count(*) as requests,
  sum(prompt_tokens)::bigint as prompt_tokens, sum(completion_tokens)::bigint as completion_tokens, sum(micro) as micro
from px_priced group by all""",
    "px_line": """
select p_partkey, p_type || ':' || p_size || '.25/' || (p_partkey % 9) || ';;bad; neg:-' || p_size || '/1; ' || p_name || ' : ' || p_size
  || ' / 2.5 ;a:b:' || p_size || '/1/2;' || p_brand || ':v' || p_size || ':' || p_size || '/0;' || p_type || ':' || p_size || '/7;' as line
from part""",
}


def _line(spark, d):
    size = F.col("p_size").cast("string")
    return table(prepare(spark), d, "part").select("p_partkey", F.concat(
        F.col("p_type"), F.lit(":"), size, F.lit(".25/"), F.col("p_partkey") % 9, F.lit(";;bad; neg:-"), size,
        F.lit("/1; "), F.col("p_name"), F.lit(" : "), size, F.lit(" / 2.5 ;a:b:"), size, F.lit("/1/2;"),
        F.col("p_brand"), F.lit(":v"), size, F.lit(":"), size, F.lit("/0;"), F.col("p_type"), F.lit(":"), size, F.lit("/7;"),
    ).alias("line"))


def priced(spark, d):
    return U.price_usage(fx.usage(spark, d), U.prices_from(spark, fx.PRICES))


def daily(spark, d):
    return U.daily_rollup(priced(spark, d))


def _money(df):
    return df.withColumn("cost", F.col("cost").cast("double"))


def usg_01_price_table(spark, d):
    out = price_table(_line(spark, d), ["p_partkey"], "line")
    return out.select("p_partkey", "model", F.col("prompt_price").cast("double").alias("prompt_price"),
                      F.col("completion_price").cast("double").alias("completion_price"))


def usg_02_priced_usage(spark, d):
    return _money(priced(spark, d).select("id", "model", "prompt_tokens", "completion_tokens", "cost"))


def usg_03_daily_rollup(spark, d):
    return _money(daily(spark, d))


def _stored(spark, d):
    old = priced(spark, d).filter(F.col("created_at") < ntz("2024-01-29 12:00:00"))
    renamed = F.when((F.to_date("created_at") == F.lit("2024-01-29").cast("date")) & (F.col("model") == "signup"), "retired")
    return U.daily_rollup(old.withColumn("model", F.coalesce(renamed, F.col("model"))))


def usg_04_refresh_rollup(spark, d):
    return _money(U.refresh_rollup(_stored(spark, d), priced(spark, d), ntz("2024-01-30 23:59:59")))


def _report(key):
    return lambda spark, d: _money(U.usage_report(daily(spark, d), key, "2024-01-05", "2024-01-20"))


def usg_05_cost_by_category(spark, d):
    return _money(U.cost_report(daily(spark, d), "category", "2024-01-05", "2024-01-20"))


def usg_06_llm_tokens(spark, d):
    return U.llm_tokens(fx.usage(spark, d), ntz("2024-01-01 00:00:00"))


def usg_08_turns_without_usage(spark, d):
    return U.turns_without_usage(fx.message(spark, d), fx.usage(spark, d)).select("message_id", "conversation_id")


def usg_09_turn_usage(spark, d):
    reported = fx.usage(spark, d).select(
        F.col("id").alias("message_id"), "prompt_tokens", "completion_tokens", (F.col("id") % 5).alias("reasoning_tokens")
    )
    return U.turn_usage(fx.message(spark, d), reported)


def src_01_tenant_scan(spark, d):
    return tenant_view(fx.usage(spark, d), "src7").select("id", "tenant_id", "model", "created_at")


def snk_01_append_ledger(spark, d):
    path = scratch_path(spark, "ledger")
    append_by_month(fx.usage(spark, d), path)
    return spark.read.parquet(path).groupBy("month", "tenant_id").agg(
        F.count("*").alias("rows"), F.sum(F.col("prompt_tokens").cast("long")).alias("prompt_tokens"))


def snk_02_upsert(spark, d):
    """The merged rollup, written by day with only the touched days replaced, and read back."""
    path = scratch_path(spark, "daily")
    stored = _stored(spark, d)
    overwrite_partitions(stored, path, "day")
    written = spark.read.schema(stored.schema).parquet(path).select(*stored.columns)
    recent = priced(spark, d).filter(F.col("created_at") >= ntz("2024-01-29 00:00:00"))
    touched = F.col("day") >= F.lit("2024-01-29").cast("date")
    merged = materialise(upsert(written.filter(touched), U.daily_rollup(recent).select(*stored.columns), U.BUCKET), "days")
    overwrite_partitions(merged, path, "day")
    back = spark.read.schema(stored.schema).parquet(path)
    return back.groupBy("day", "model").agg(
        F.sum("requests").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("cost").cast("double").alias("cost"))


def pag_01_keyset_page(spark, d):
    rows = page(fx.usage(spark, d), "created_at", "id", after=("2024-01-20 00:00:00", 10**12), limit=50)
    return rows.select("id", "created_at", "position", "next_ts", "next_id")


QUERIES = {
    "usg_01_price_table": usg_01_price_table,
    "usg_02_priced_usage": usg_02_priced_usage,
    "usg_03_daily_rollup": usg_03_daily_rollup,
    "usg_04_refresh_rollup": usg_04_refresh_rollup,
    "usg_05_report_by_day": _report("day"),
    "usg_05_report_by_user": _report("user"),
    "usg_05_report_by_model": _report("model"),
    "usg_05_cost_by_category": usg_05_cost_by_category,
    "usg_06_llm_tokens": usg_06_llm_tokens,
    "usg_08_turns_without_usage": usg_08_turns_without_usage,
    "usg_09_turn_usage": usg_09_turn_usage,
    "src_01_tenant_scan": src_01_tenant_scan,
    "snk_01_append_ledger": snk_01_append_ledger,
    "snk_02_upsert": snk_02_upsert,
    "pag_01_keyset_page": pag_01_keyset_page,
}

_REFRESHED = """
select tenant_id, day, user_id, category, model, requests, prompt_tokens, completion_tokens, micro from px_daily
  where day < date '2024-01-29' or day >= date '2024-01-29'
union all
select * from (
select tenant_id, created_at::date as day, user_id, category, 'retired' as model, count(*) as requests,
  sum(prompt_tokens)::bigint, sum(completion_tokens)::bigint, sum(micro)
from px_priced where created_at >= timestamp '2024-01-29' and created_at < timestamp '2024-01-29 12:00:00' and model = 'signup'
group by 1, 2, 3, 4)
"""


def _report_sql(col):
    return f"""
select coalesce(cast({col} as varchar), 'None') as key, sum(requests)::bigint as requests, sum(prompt_tokens)::bigint as prompt_tokens,
  sum(completion_tokens)::bigint as completion_tokens, sum(micro) / 1e6 as cost
from px_daily where day between date '2024-01-05' and date '2024-01-20' group by {col}"""


ORACLES = {
    "usg_01_price_table": """
with e as (select p_partkey, unnest(string_split(line, ';')) as raw, generate_subscripts(string_split(line, ';'), 1) as pos from px_line),
s as (select p_partkey, pos, trim(regexp_extract(trim(raw), '^(.*):([^:]*)$', 1)) as model,
  regexp_extract(trim(raw), '^(.*):([^:]*)$', 2) as price from e),
n as (select p_partkey, pos, model, try_cast(trim(split_part(price, '/', 1)) as decimal(14,8)) as prompt_price,
  try_cast(trim(substr(price, strpos(price, '/') + 1)) as decimal(14,8)) as completion_price
  from s where model <> '' and contains(price, '/'))
select p_partkey, model, prompt_price::double as prompt_price, completion_price::double as completion_price
from n where prompt_price >= 0 and completion_price >= 0
qualify row_number() over (partition by p_partkey, model order by pos desc) = 1""",
    "usg_02_priced_usage": "select id, model, prompt_tokens, completion_tokens, micro / 1e6 as cost from px_priced",
    "usg_03_daily_rollup": "select * exclude (micro), micro / 1e6 as cost from px_daily",
    "usg_04_refresh_rollup": f"select * exclude (micro), micro / 1e6 as cost from ({_REFRESHED})",
    "usg_05_report_by_day": _report_sql("day"),
    "usg_05_report_by_user": _report_sql("user_id"),
    "usg_05_report_by_model": _report_sql("model"),
    "usg_05_cost_by_category": f"select key, cost from ({_report_sql('category')})",
    "usg_06_llm_tokens": """
select tenant_id, sum(prompt_tokens + completion_tokens)::bigint as tokens from fx_usage
where category = 'llm' and created_at >= timestamp '2024-01-01' group by tenant_id""",
    "usg_08_turns_without_usage": """
select message_id, conversation_id from fx_message m where role = 'assistant'
  and not exists (select 1 from fx_usage u where u.request_id = cast(m.message_id as varchar))""",
    "usg_09_turn_usage": """
with t as (select *, sum(length(content)) over (partition by conversation_id order by created_at, message_id
    rows between unbounded preceding and 1 preceding) as before from fx_message)
select t.message_id, case when u.id is not null then u.prompt_tokens::bigint else greatest(1, coalesce(before, 0)::bigint // 4) end as prompt_tokens,
  case when u.id is not null then u.completion_tokens + u.id % 5 else greatest(1, length(content)::bigint // 4) end as output_tokens,
  u.id is null as estimated
from t left join fx_usage u on u.id = t.message_id where role = 'assistant'""",
    "src_01_tenant_scan": "select id, tenant_id, model, created_at from fx_usage where tenant_id = 'src7'",
    "snk_01_append_ledger": """
select strftime(created_at, '%Y_%m') as month, tenant_id, count(*) as rows, sum(prompt_tokens)::bigint as prompt_tokens
from fx_usage group by all""",
    "snk_02_upsert": f"""
select day, model, sum(requests)::bigint as requests, sum(prompt_tokens)::bigint as prompt_tokens, sum(micro) / 1e6 as cost
from ({_REFRESHED}) group by day, model""",
    "pag_01_keyset_page": """
with r as (select id, created_at, row_number() over (order by created_at desc, id desc) as position, count(*) over () as n
  from fx_usage where created_at <= timestamp '2024-01-20')
select id, created_at, position::int as position, case when position = 50 and n > 50 then created_at end as next_ts,
  case when position = 50 and n > 50 then id end as next_id from r where position <= 50""",
}
