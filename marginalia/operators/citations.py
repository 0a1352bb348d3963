"""Citations: markers, verified lists, dropped markers, answer segments, answers from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.arrays import each
from marginalia.functions.text import MARKER, markers, snippet

RESUME_SECONDS = 300


def marker_rows(answers: DataFrame) -> DataFrame:
    """Every marker of every answer in order, repeats included."""
    return each(answers, ["message_id"], markers(F.col("content")), "marker", "pos")


def _distinct_markers(answers: DataFrame) -> DataFrame:
    """Markers once each with the place they first appear at; found inside the row, no shuffle."""
    seen = F.array_distinct(markers(F.col("content")))
    return each(answers, ["message_id", "conversation_id"], seen, "marker", "pos")


def citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """One row per distinct marker: its chunk, or none. ``n`` numbers the matched ones in answer order.

    ``context``: conversation_id, n, chunk_id, content. Markers are text: ``01`` does not match ``1``.
    """
    numbered = context.select("conversation_id", F.col("n").cast("string").alias("marker"), "chunk_id", "content")
    rows = _distinct_markers(answers).join(numbered, ["conversation_id", "marker"], "left")
    entry = F.struct("pos", "marker", "chunk_id", snippet(F.col("content")).alias("snippet"))
    listed = rows.groupBy("message_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), entry))).alias("matched"),
        F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNull(), F.struct("pos", "marker")))).alias("unmatched"),
    )
    return listed.select(
        "message_id", "matched", F.transform("unmatched", lambda s: s["marker"]).alias("dropped")
    )


def citation_rows(lists: DataFrame) -> DataFrame:
    return lists.select("message_id", F.posexplode("matched").alias("i", "c")).select(
        "message_id", (F.col("i") + 1).alias("n"), "c.marker", "c.chunk_id", "c.snippet"
    )


def turn_stats(answers: DataFrame, lists: DataFrame, context: DataFrame) -> DataFrame:
    """{context_chunks, citations, dropped} of each turn that retrieved something and produced text."""
    held = context.groupBy("conversation_id").agg(F.count("*").alias("context_chunks"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return answers.filter(F.col("content") != "").join(held, "conversation_id").join(lists, "message_id", "left").select(
        "message_id", "tenant_id", "created_at", "context_chunks",
        size("matched").alias("citations"), size("dropped").alias("dropped"),
    )


def hallucination_report(stats: DataFrame, keys: list[Column]) -> DataFrame:
    marked = F.sum(F.col("citations") + F.col("dropped"))
    return stats.groupBy(*keys).agg(
        F.count("*").alias("turns"), F.sum("context_chunks").alias("context_chunks"), F.sum("citations").alias("citations"),
        F.sum("dropped").alias("dropped"), F.try_divide(F.sum("dropped"), marked).alias("dropped_rate"),
    )


def answer_segments(answers: DataFrame, lists: DataFrame) -> DataFrame:
    """Text and citation pieces in display order; unmatched markers vanish, a cut-off marker at the end too."""
    visible = F.regexp_replace("content", r"(?s)\[c:(?!.*\[c:)[^\]]*\z", "")
    places = F.map_from_entries(F.transform(
        F.coalesce(F.col("matched"), F.array().cast("array<struct<pos:int,marker:string,chunk_id:bigint,snippet:string>>")),
        lambda c, i: F.struct(c["marker"], i + 1),
    ))
    rows = answers.join(lists, "message_id", "left").select(
        "message_id", F.split(visible, MARKER, -1).alias("texts"), markers(visible).alias("marks"), places.alias("places")
    )
    none = F.lit(None)
    pairs = F.flatten(F.transform(F.col("texts"), lambda text, i: F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("int").alias("index")),
        F.struct(F.lit("citation").alias("kind"), F.get("marks", i).alias("text"), F.try_element_at("places", F.get("marks", i)).alias("index")),
    )))
    shown = F.filter(pairs, lambda s: F.when(s["kind"] == "text", s["text"] != "").otherwise(s["index"].isNotNull()))
    return each(rows, ["message_id"], shown, "s", "segment_no").select("message_id", "segment_no", "s.*")


def evaluation_sample(answers: DataFrame, ident: str = "message_id", percent: int = 5) -> DataFrame:
    """A repeatable sample of answers for review."""
    return answers.filter(F.pmod(F.col(ident), F.lit(100)) < percent)


def answers_from_events(events: DataFrame) -> DataFrame:
    """Answer text from its deltas in sequence order; the last terminal event decides the status.

    The text of one answer is the result itself, so its deltas meet in one row.
    """
    delta = F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "text")))
    terminal = F.max_by("type", F.when(F.col("type") != "delta", F.col("seq")))
    status = (
        F.when(F.col("last") == "done", "completed").when(F.col("last") == "stopped", "interrupted")
        .when(F.col("last") == "error", "failed").otherwise("streaming")
    )
    return events.groupBy("message_id").agg(F.array_sort(delta).alias("deltas"), terminal.alias("last")).select(
        "message_id", F.array_join(F.transform("deltas", lambda s: s["text"]), "").alias("content"), status.alias("status")
    )


def resume_events(events: DataFrame, after: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(events after a sequence number for streams still held, streams that have expired)."""
    last = events.groupBy("message_id").agg(F.max("ts").alias("last"))
    gone = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(RESUME_SECONDS))
    marked = last.withColumn("expired", F.col("last") + gone <= now)
    held = marked.filter("not expired").select("message_id")
    return events.filter(F.col("seq") > after).join(held, "message_id", "left_semi"), marked.filter("expired").select("message_id", "last")
