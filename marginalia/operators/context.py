"""Prompt assembly: numbered context, user turn, memory window, active prompt, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import token_estimate

# --- fixed values: delimiters and labels of the assembled prompt -----------------------------------
START = "<<<KNOWLEDGE_CONTEXT>>>"
END = "<<<END_KNOWLEDGE_CONTEXT>>>"
DEFUSED = "<<redacted-delimiter>>"
UNNAMED = "未命名文件"
ROLES = ("system", "user", "assistant", "tool")
PARTS = (("system", 800), ("memory", 1500), ("context", 4500), ("question", 700))
# ---------------------------------------------------------------------------------------------------
HISTORY = 20
MEMORY_WINDOWS = (10, 6, 4)
MEMORY_BUDGET = 1500


def source_line(marker: Column, name: Column, page: Column, heading_path: Column) -> Column:
    """``[c:n] 來源：name 第 p 頁（a › b）``; page and path only where they exist."""
    shown = F.when(F.coalesce(name, F.lit("")) == "", F.lit(UNNAMED)).otherwise(name)
    paged = F.when(page.isNotNull(), F.concat(shown, F.lit(" 第 "), page, F.lit(" 頁"))).otherwise(shown)
    path = F.when(F.size(heading_path) > 0, F.concat(F.lit("（"), F.array_join(heading_path, " › "), F.lit("）"))).otherwise("")
    return F.concat(F.lit("[c:"), marker.cast("string"), F.lit("] 來源："), paged, path)


def defuse(text: Column) -> Column:
    """Replace forged delimiters inside a chunk; nothing else is touched."""
    return F.replace(F.replace(text, F.lit(START), F.lit(DEFUSED)), F.lit(END), F.lit(DEFUSED))


def context_blocks(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, context. ``selected``: query_id, position, content, document_name, page, heading_path.

    A question without chunks still gets the two delimiters, so the model sees that there is nothing.
    """
    piece = F.concat_ws(
        "\n", source_line(F.col("position"), F.col("document_name"), F.col("page"), F.col("heading_path")),
        defuse(F.col("content")), F.lit(""),
    )
    body = F.transform(F.array_sort(F.collect_list(F.struct("position", piece.alias("p")))), lambda s: s["p"])
    joined = selected.groupBy("query_id").agg(body.alias("pieces"))
    lines = F.concat(F.array(F.lit(START)), F.coalesce("pieces", F.array().cast("array<string>")), F.array(F.lit(END)))
    return queries.select("query_id").join(joined, "query_id", "left").select("query_id", F.array_join(lines, "\n").alias("context"))


def user_turn(question: Column, context: Column) -> Column:
    """Context first, then the question; no context means the question alone."""
    with_context = F.concat(context, F.lit("\n\n問題："), question)
    return F.when(F.coalesce(context, F.lit("")) == "", question).otherwise(with_context)


def memory_window(messages: DataFrame, current: DataFrame, limit: int = HISTORY) -> DataFrame:
    """The newest ``limit`` messages per conversation, oldest first.

    The current pair (``current``: message_id) and empty messages are left out after the limit is
    applied; an unknown role reads as ``user``. The row limit prunes before the shuffle.
    """
    newest = W.partitionBy("conversation_id").orderBy(F.col("created_at").desc(), F.col("message_id").desc())
    recent = messages.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= limit)
    kept = recent.filter(F.coalesce(F.col("content"), F.lit("")) != "").join(current, "message_id", "left_anti")
    oldest = W.partitionBy("conversation_id").orderBy("created_at", "message_id")
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    return kept.select(
        "conversation_id", F.row_number().over(oldest).alias("position"), "message_id", role.alias("role"), "content"
    )


def active_prompts(wanted: DataFrame, prompts: DataFrame, versions: DataFrame) -> DataFrame:
    """The template in force for each wanted (tenant_id, key): the tenant's own prompt before the system one.

    Only the published version that ``active_version_id`` points at counts, never the largest number;
    a prompt of one's own without such a version hides the system prompt.
    """
    live = prompts.filter(F.col("deleted_at").isNull())
    found = F.struct("prompt_id", "active_version_id")
    own = live.filter(F.col("tenant_id").isNotNull()).select("tenant_id", "key", found.alias("own"))
    system = live.filter(F.col("tenant_id").isNull()).select("key", found.alias("system"))
    picked = wanted.join(own, ["tenant_id", "key"], "left").join(system, "key", "left").select(
        "tenant_id", "key", F.coalesce("own", "system").alias("p")
    ).select("tenant_id", "key", "p.*")
    published = versions.filter(F.col("status") == "published").select(
        F.col("version_id").alias("active_version_id"), "prompt_id", "version", "template"
    )
    return picked.join(published, ["active_version_id", "prompt_id"]).select("tenant_id", "key", "version", "template")


def token_budgets(prompts: DataFrame) -> DataFrame:
    """Tokens against the planned share for each part of an assembled prompt."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(name).alias("part"), token_estimate(F.coalesce(F.col(name), F.lit(""))).alias("tokens"), F.lit(share).alias("budget"))
        for name, share in PARTS
    ])).alias("p")
    return prompts.select("query_id", parts).select("query_id", "p.*", (F.col("p.budget") - F.col("p.tokens")).alias("slack"))


def memory_overflow(messages: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window per conversation, messages to fold into the next summary).

    The window is the largest of 10, 6, 4 messages whose tokens fit the memory budget (4 if none does).
    Overflow: messages older than the newest 10 and newer than the last snapshot's covered message.
    """
    newest = W.partitionBy("conversation_id").orderBy(F.col("created_at").desc(), F.col("message_id").desc())
    widest = MEMORY_WINDOWS[0]
    recent = messages.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= widest)
    sums = [F.sum(F.when(F.col("_r") <= n, token_estimate(F.col("content")))).alias(f"t{n}") for n in MEMORY_WINDOWS]
    edge = F.min(F.struct("created_at", "message_id")).alias("edge")
    per = recent.groupBy("conversation_id").agg(*sums, edge)
    window = F.coalesce(*[F.when(F.col(f"t{n}") <= MEMORY_BUDGET, F.lit(n)) for n in MEMORY_WINDOWS], F.lit(MEMORY_WINDOWS[-1]))
    windows = per.select("conversation_id", window.alias("window"))
    covered = snapshots.groupBy("conversation_id").agg(F.max_by("upto_message_id", "version").alias("upto"))
    older = messages.join(per.select("conversation_id", "edge"), "conversation_id").join(covered, "conversation_id", "left")
    overflow = older.filter(
        (F.struct("created_at", "message_id") < F.col("edge")) & (F.col("message_id") > F.coalesce("upto", F.lit(-1)))
    )
    return windows, overflow.select("conversation_id", "message_id")
