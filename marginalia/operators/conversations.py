"""Conversations: recency order, counters, snapshots, groups, title search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of the groups, by age.
GROUPS = ("已釘選", "今天", "昨天", "前 7 天", "前 30 天", "更早")


def owned_page_source(conversations: DataFrame, user: int | str) -> DataFrame:
    """A user's conversations with the time they are ordered by."""
    return conversations.filter(F.col("user_id") == user).withColumn("recent_at", F.coalesce("last_message_at", "created_at"))


def counters(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(
        F.count("*").alias("message_count"), F.max("created_at").alias("last_message_at")
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Newest memory snapshot per conversation and the version number the next one gets."""
    newest = F.max_by(F.struct("version", "summary", "token_count"), "version").alias("s")
    return snapshots.groupBy("conversation_id").agg(newest).select(
        "conversation_id", "s.*", (F.col("s.version") + 1).alias("next_version")
    )


def recency_group(pinned: Column, at: Column, now: Column) -> Column:
    """Display group of a conversation; no message yet counts as now."""
    moment = F.coalesce(at, now)
    today = F.date_trunc("day", now)
    since = lambda days: moment >= today - F.make_dt_interval(F.lit(days))
    return (
        F.when(pinned, GROUPS[0]).when(moment >= today, GROUPS[1]).when(since(1), GROUPS[2])
        .when(since(7), GROUPS[3]).when(since(30), GROUPS[4]).otherwise(GROUPS[5])
    )


def recency_groups(conversations: DataFrame, now: Column) -> DataFrame:
    """Members per group in the fixed display order; empty groups are not listed."""
    label = recency_group(F.col("pinned"), F.col("last_message_at"), now)
    place = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("label"))
    return conversations.groupBy(label.alias("label")).agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place")


def title_search(conversations: DataFrame, needle: str) -> DataFrame:
    wanted = needle.strip().lower()
    return conversations if wanted == "" else conversations.filter(F.contains(F.lower("title"), F.lit(wanted)))
