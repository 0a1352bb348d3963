"""Usage ledger: pricing, daily rollup, reports, per-turn usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.entries import price_table
from marginalia.functions.skew import running_sum
from marginalia.operators.sinks import upsert

BUCKET = ["tenant_id", "day", "user_id", "category", "model"]
REPORT_KEYS = ("day", "user", "model", "category")
CHARS_PER_TOKEN = 4


def prices_from(spark, text: str) -> DataFrame:
    """The price list of one configuration line (as many rows as that line has entries)."""
    line = spark.range(1).select(F.lit(text).alias("text"))
    return price_table(line, [], "text")


def cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Cost of one call, rounded half-even to six decimals before it is stored."""
    per_million = prompt.cast("decimal(12,0)") * prompt_price + completion.cast("decimal(12,0)") * completion_price
    return F.bround(per_million * F.lit("0.000001").cast("decimal(6,6)"), 6).cast("decimal(12,6)")


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost``; a model without a price costs NULL, not zero. The price list is one config line."""
    joined = usage.join(prices, "model", "left")
    spent = cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("prompt_price"), F.col("completion_price"))
    return joined.select(*usage.columns, spent.alias("cost"))


def daily_rollup(priced: DataFrame) -> DataFrame:
    """Requests, tokens and cost per tenant, UTC day, user (NULL is one bucket), category, model."""
    return priced.withColumn("day", F.to_date("created_at")).groupBy(*BUCKET).agg(
        F.count("*").alias("requests"),
        F.sum(F.col("prompt_tokens").cast("long")).alias("prompt_tokens"),
        F.sum(F.col("completion_tokens").cast("long")).alias("completion_tokens"),
        F.sum("cost").cast("decimal(14,6)").alias("cost"),
    )


def refresh_rollup(stored: DataFrame, priced: DataFrame, now: Column) -> DataFrame:
    """Recompute yesterday and today and merge; other days and vanished buckets stay as stored.

    Only the two days of the stored rollup meet the new rows; all others pass by.
    """
    today = F.to_date(now)
    start = F.date_sub(today, 1).cast("timestamp_ntz")
    end = F.date_add(today, 1).cast("timestamp_ntz")
    recent = priced.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    touched = F.coalesce(F.col("day").between(F.date_sub(today, 1), today), F.lit(False))
    fresh = upsert(stored.filter(touched), daily_rollup(recent).select(*stored.columns), BUCKET)
    return stored.filter(~touched).unionByName(fresh)


def usage_report(daily: DataFrame, group_by: str, start: str, end: str) -> DataFrame:
    """Totals of an inclusive date range by one whitelisted key, printed as text (``None`` for NULL)."""
    if group_by not in REPORT_KEYS:
        raise ValueError(f"group_by must be one of {REPORT_KEYS}")
    column = "user_id" if group_by == "user" else group_by
    ranged = daily.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    totals = ranged.groupBy(F.col(column).alias("_key")).agg(
        F.sum("requests").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"),
    )
    return totals.orderBy(F.col("_key").asc_nulls_last()).select(
        F.coalesce(F.col("_key").cast("string"), F.lit("None")).alias("key"),
        "requests", "prompt_tokens", "completion_tokens", "cost",
    )


def cost_report(daily: DataFrame, group_by: str, start: str, end: str) -> DataFrame:
    """As ``usage_report``, cost only; grouping costs by user is not offered."""
    if group_by == "user":
        raise ValueError("costs cannot be grouped by user")
    return usage_report(daily, group_by, start, end).select("key", "cost")


def llm_tokens(usage: DataFrame, since: Column) -> DataFrame:
    spent = usage.filter((F.col("category") == "llm") & (F.col("created_at") >= since))
    total = F.sum(F.col("prompt_tokens").cast("long") + F.col("completion_tokens"))
    return spent.groupBy("tenant_id").agg(total.alias("tokens"))


def turns_without_usage(messages: DataFrame, usage: DataFrame) -> DataFrame:
    """Assistant turns the ledger knows nothing about (aborted before any usage was reported)."""
    turns = messages.filter(F.col("role") == "assistant").withColumn("request_id", F.col("message_id").cast("string"))
    return turns.join(usage.select("request_id"), "request_id", "left_anti").drop("request_id")


def turn_usage(messages: DataFrame, reported: DataFrame) -> DataFrame:
    """Tokens per assistant turn: as reported (reasoning counts as output), else estimated from length.

    ``reported`` has message_id, prompt_tokens, completion_tokens, reasoning_tokens. The prompt of a turn
    is everything said before it in its conversation.
    """
    said = running_sum(
        messages.select("message_id", "conversation_id", "role", "created_at", F.length("content").alias("chars")),
        ["conversation_id"], F.date_trunc("hour", "created_at"), [F.col("created_at"), F.col("message_id")],
        F.col("chars").cast("long"), "through",
    ).filter(F.col("role") == "assistant")
    joined = said.join(reported, "message_id", "left")
    known = F.col("prompt_tokens").isNotNull()
    guess = lambda chars: F.greatest(F.lit(1), F.floor(chars / CHARS_PER_TOKEN)).cast("long")
    output = F.col("completion_tokens").cast("long") + F.coalesce("reasoning_tokens", F.lit(0))
    return joined.select(
        "message_id",
        F.when(known, F.col("prompt_tokens").cast("long")).otherwise(guess(F.col("through") - F.col("chars"))).alias("prompt_tokens"),
        F.when(known, output).otherwise(guess(F.col("chars"))).alias("output_tokens"),
        (~known).alias("estimated"),
    )
