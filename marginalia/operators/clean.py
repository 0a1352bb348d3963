"""Cleaning: repeated headers, garbled blocks, renumbering, per-document and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import clean_text, is_blank, match_text, token_estimate, unreadable_ratio

GARBLED_RATIO = 0.3
HEADER_MAX_TOKENS = 16
HEADER_MIN_PAGES = 3
HIGH_DROP_RATE = 0.2


def repeated_headers(blocks: DataFrame) -> DataFrame:
    """Short lines that stand on three or more distinct pages of one document."""
    lines = blocks.filter(F.col("page").isNotNull() & (F.col("type") != "table")).select(
        "doc_id", "page", match_text(F.col("text")).alias("match_text")
    ).distinct()
    short = lines.filter((F.col("match_text") != "") & (token_estimate(F.col("match_text")) <= HEADER_MAX_TOKENS))
    return short.groupBy("doc_id", "match_text").agg(F.count("*").alias("pages")).filter(
        F.col("pages") >= HEADER_MIN_PAGES
    )


def is_garbled(text: Column) -> Column:
    """More than 30 % unreadable characters; line breaks and tabs count as unreadable."""
    return F.when(F.length(text) == 0, True).otherwise(unreadable_ratio(text) > GARBLED_RATIO)


def judged(blocks: DataFrame) -> DataFrame:
    """Every block with its cleaned text and its fate: ``header``, ``dropped`` or ``kept``.

    One shuffle, by document: the header test counts page changes inside (document, line) groups, which
    that partitioning already holds together, and so do the numbering and the statistics that follow. The
    cleaned text is made before the windows, so no later filter evaluates it again.
    """
    table = F.col("type") == "table"
    prepared = blocks.repartition("doc_id").withColumn("match_text", match_text(F.col("text"))).withColumn(
        "clean_text", F.when(table, F.col("text")).otherwise(clean_text(F.col("text")))
    ).drop("text")
    line = F.col("match_text")
    candidate = F.col("page").isNotNull() & ~table & (line != "") & (token_estimate(line) <= HEADER_MAX_TOKENS)
    bad = is_blank(F.col("clean_text")) | (~table & is_garbled(F.col("clean_text")))
    flagged = prepared.withColumn("_candidate", candidate).withColumn("_bad", bad)
    same_line = W.partitionBy("doc_id", "match_text")
    paged = same_line.orderBy(F.col("_candidate").desc(), "page")
    fresh = F.col("_candidate") & ~F.coalesce(F.lag("page").over(paged) == F.col("page"), F.lit(False))
    counted = flagged.withColumn("_fresh", fresh).withColumn("_pages", F.sum(F.col("_fresh").cast("int")).over(same_line))
    fate = F.when(F.col("_pages") >= HEADER_MIN_PAGES, "header").when(F.col("_bad"), "dropped").otherwise("kept")
    return counted.withColumn("fate", fate).drop("match_text", "_candidate", "_bad", "_fresh", "_pages")


def cleaned(blocks: DataFrame) -> DataFrame:
    """The kept blocks with their cleaned text, renumbered densely from 0 within each document."""
    kept = judged(blocks).filter(F.col("fate") == "kept")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("block_order")) - 1
    rest = [c for c in blocks.columns if c not in ("text", "block_order")]
    return kept.select(*rest, F.col("block_order").alias("old_order"), place.alias("block_order"), F.col("clean_text").alias("text"))


def cleaned_texts(blocks: DataFrame) -> DataFrame:
    """doc_id, text: what is left of each document, its kept blocks in order, one below the other.

    A document of which nothing is left has the empty text.
    """
    kept = F.array_sort(F.collect_list(F.when(F.col("fate") == "kept", F.struct("block_order", "clean_text"))))
    return judged(blocks).groupBy("doc_id").agg(kept.alias("_kept")).select(
        "doc_id", F.array_join(F.transform("_kept", lambda b: b["clean_text"]), "\n").alias("text"))


def clean_stats(blocks: DataFrame) -> DataFrame:
    """Per document: blocks without headers, dropped blocks, removed headers, drop rate and its warning."""
    fates = judged(blocks).groupBy("doc_id").agg(
        F.count_if(F.col("fate") != "header").alias("total"),
        F.count_if(F.col("fate") == "dropped").alias("dropped"),
        F.count_if(F.col("fate") == "header").alias("removed_headers"),
    )
    rate = F.when(F.col("total") > 0, F.col("dropped") / F.col("total")).otherwise(F.lit(0.0))
    return fates.select(
        "*", F.bround(rate, 4).alias("drop_rate"), (rate > HIGH_DROP_RATE).alias("quality_warning")
    )


def quality_report(stats: DataFrame, documents: DataFrame) -> DataFrame:
    """Per knowledge base: documents, warned share, median drop rate.

    Rates are stored with four decimals, so the exact median works on at most 10 001 distinct values.
    """
    return stats.join(documents.select("doc_id", "tenant_id", "kb_id"), "doc_id").groupBy("tenant_id", "kb_id").agg(
        F.count("*").alias("docs"),
        F.avg(F.col("quality_warning").cast("int")).alias("warn_rate"),
        F.percentile("drop_rate", 0.5).alias("median_drop_rate"),
    )
