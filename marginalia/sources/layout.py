"""Positioned text lines (as a PDF page holds them) and spreadsheet rows to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.skew import running_count
from marginalia.functions.text import SPACE, strip
from marginalia.sources.blocks import with_heading_path

HEADING_RATIO = 1.2
GAP_RATIO = 1.6
ROWS_PER_BLOCK = 50


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def body_sizes(lines: DataFrame) -> DataFrame:
    """Font size that carries most characters per document; of two equal ones the smaller."""
    weight = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return weight.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))


def heading_sizes(lines: DataFrame) -> DataFrame:
    """doc_id, size, level: sizes from 1.2 times the body size on, largest first."""
    big = lines.select("doc_id", "size").distinct().join(body_sizes(lines), "doc_id").filter(
        F.col("size") >= F.col("body") * HEADING_RATIO
    )
    return big.select("doc_id", "size", F.dense_rank().over(W.partitionBy("doc_id").orderBy(F.col("size").desc())).alias("level"))


def outline_levels(outline: DataFrame) -> DataFrame:
    """doc_id, title, level of the first outline entry with each title."""
    named = outline.withColumn("title", collapse(F.col("title"))).filter(F.col("title") != "")
    return named.groupBy("doc_id", "title").agg(F.min_by("level", "entry_no").alias("outline_level"))


def line_blocks(lines: DataFrame, tables: DataFrame, outline: DataFrame) -> DataFrame:
    """Lines (doc_id, line_no, page, text, size, top, height) and tables (doc_id, page, top, text) to blocks.

    A document with an outline takes its headings from there and ignores sizes. A paragraph ends at a page
    change, a size change, a wide gap, a heading or a table.
    """
    titled = outline_levels(outline)
    sized = heading_sizes(lines).join(titled.select("doc_id").distinct(), "doc_id", "left_anti")
    levelled = lines.withColumn("title", collapse(F.col("text"))).join(titled, ["doc_id", "title"], "left").join(
        sized, ["doc_id", "size"], "left"
    )
    level = F.coalesce("outline_level", "level").cast("int")
    items = levelled.select(
        "doc_id", F.lit(0).alias("kind"), F.col("line_no").cast("long").alias("line_no"), "page", "top", "text", "size", "height", level.alias("level")
    ).unionByName(tables.select(
        "doc_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("line_no"), "page", "top", "text",
        F.lit(None).cast("double").alias("size"), F.lit(None).cast("double").alias("height"), F.lit(None).cast("int").alias("level"),
    ))
    reading = [F.col(c) for c in ("page", "top", "kind", "line_no")]
    order = W.partitionBy("doc_id").orderBy(*reading)
    prev = lambda c: F.lag(c).over(order)
    alone = (F.col("kind") == 1) | F.col("level").isNotNull()
    line_height = F.greatest(prev("height"), F.col("height"), F.lit(1.0))
    gap = (
        (F.col("page") != prev("page")) | (F.col("size") != prev("size"))
        | ((F.col("top") - prev("top")) > line_height * GAP_RATIO)
    )
    flagged = items.withColumn("_alone", alone)
    flagged = flagged.withColumn("_break", F.col("_alone") | F.coalesce(F.lag("_alone").over(order), F.lit(True)) | F.coalesce(gap, F.lit(False)))
    flagged = flagged.withColumn("block_order", F.sum(F.col("_break").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    place = F.struct("page", "top", "kind", "line_no")
    texts = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "text"))), lambda s: s["text"])
    blocks = flagged.groupBy("doc_id", "block_order").agg(
        F.max("kind").alias("kind"), F.max("level").alias("level"), F.min("page").alias("page"), F.array_join(texts, "\n").alias("text")
    )
    kind = F.when(F.col("kind") == 1, "table").when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    return with_heading_path(blocks.select("doc_id", "block_order", kind.alias("type"), "text", "page", "level")).drop("level")


def outside_tables(objects: DataFrame, boxes: DataFrame) -> DataFrame:
    """Text objects whose centre lies in no table box of their page (edges count as inside)."""
    x, y = (F.col("o.x0") + F.col("o.x1")) / 2, (F.col("o.top") + F.col("o.bottom")) / 2
    same = (F.col("o.doc_id") == F.col("b.doc_id")) & (F.col("o.page") == F.col("b.page"))
    inside = x.between(F.col("b.x0"), F.col("b.x1")) & y.between(F.col("b.top"), F.col("b.bottom"))
    return objects.alias("o").join(boxes.alias("b"), same & inside, "left_anti")


def markdown_table(rows: Column) -> Column:
    """array<array<string>> to a pipe table; the first row is the header, short rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: strip(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    shown = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(rows, lambda row: F.concat(F.transform(row, cell), F.array_repeat(F.lit(""), width - F.size(row))))
    lines = F.transform(padded, shown)
    rule = shown(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")).otherwise("")


def sheet_blocks(rows: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Spreadsheet rows (keys, sheet, row_no, cells) to a heading and tables of at most 50 data rows.

    The header repeats in every table; empty rows are dropped; a sheet with only a header keeps one table.
    ``bucket`` cuts the row numbers into ranges, so that a sheet with a third of all rows is numbered by
    many tasks.
    """
    sheet = [*keys, "sheet"]
    filled = rows.filter(F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != ""))
    plain = filled.select(*sheet, "row_no", F.transform("cells", lambda c: F.coalesce(c, F.lit(""))).alias("cells"), bucket.alias("_at"))
    numbered = running_count(plain, sheet, F.col("_at"), [F.col("row_no")], "_n")
    header = plain.groupBy(*sheet).agg(F.min_by("cells", "row_no").alias("header"))
    body = numbered.filter(F.col("_n") > 1).withColumn("win", F.floor((F.col("_n") - 2) / ROWS_PER_BLOCK).cast("int"))
    windows = body.groupBy(*sheet, "win").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda s: s["cells"]).alias("data")
    )
    tables = header.join(windows, sheet, "left")
    data = F.coalesce("data", F.array().cast("array<array<string>>"))
    shown = tables.select(
        *sheet, (F.coalesce("win", F.lit(0)) + 1).alias("block_order"), F.lit("table").alias("type"),
        markdown_table(F.concat(F.array("header"), data)).alias("text"),
    )
    titles = header.select(*sheet, F.lit(0).alias("block_order"), F.lit("heading").alias("type"), F.col("sheet").cast("string").alias("text"))
    return titles.unionByName(shown)
