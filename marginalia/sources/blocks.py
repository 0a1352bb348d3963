"""Plain text to paragraph blocks, and heading paths over any block table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.arrays import each
from marginalia.functions.text import strip

# A line that is empty or holds only blanks separates two paragraphs.
BLANK_LINE = r"\n[ \t\r\f\x0B]*\n"


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text -> one paragraph block per blank-line separated piece, numbered from 0, no page.

    Pieces keep the position of the split, so numbering needs no shuffle: blank pieces are filtered
    inside the array before it is exploded.
    """
    pieces = F.filter(
        F.transform(F.split("text", BLANK_LINE, -1), strip), lambda piece: piece != ""
    )
    return each(docs, ["doc_id"], pieces, "text", "block_order").select(
        "doc_id", "block_order", F.lit("paragraph").alias("type"), "text",
        F.lit(None).cast("long").alias("page"), F.array().cast("array<string>").alias("heading_path"),
    )


def with_heading_path(blocks: DataFrame) -> DataFrame:
    """Add ``heading_path``: the open headings above a block, outermost first.

    A heading closes every heading of its own level or deeper; levels have no bound. Needs doc_id,
    block_order, type, text, level. A document's headings are folded in order once, and each block takes
    the path of the last heading at or before it (documents are bounded by the intake size cap).
    """
    heading = (F.col("type") == "heading") & F.col("level").isNotNull()
    entry = F.struct("block_order", F.col("level").cast("int").alias("level"), "text")
    folded = F.aggregate(
        F.array_sort(F.collect_list(entry)),
        F.struct(F.array().cast("array<struct<level:int,text:string>>").alias("open"),
                 F.array().cast("array<struct<at:bigint,above:array<string>,own:string>>").alias("paths")),
        _open_heading, lambda done: done["paths"],
    )
    paths = blocks.filter(heading).groupBy(F.col("doc_id").alias("_doc")).agg(folded.alias("_paths")).select(
        "_doc", F.explode("_paths").alias("_p"))
    upto = W.partitionBy("doc_id").orderBy("block_order").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(heading, F.col("block_order").cast("long")), ignorenulls=True).over(upto)
    rows = blocks.withColumn("_last", last)
    joined = rows.join(paths, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_last") == F.col("_p.at")), "left")
    path = F.when(F.col("_last") == F.col("block_order"), F.col("_p.above")).otherwise(
        F.concat("_p.above", F.array("_p.own")))
    return joined.select(*blocks.columns, F.coalesce(path, F.array().cast("array<string>")).alias("heading_path"))


def _open_heading(so_far: Column, heading: Column) -> Column:
    """One step of the fold: close what is not above the heading, note its path, open it."""
    above = F.filter(so_far["open"], lambda h: h["level"] < heading["level"])
    made = F.struct(heading["block_order"].cast("long").alias("at"),
                    F.transform(above, lambda h: h["text"]).alias("above"), heading["text"].alias("own"))
    opened = F.array(F.struct(heading["level"].alias("level"), heading["text"].alias("text")))
    return F.struct(F.concat(above, opened).alias("open"), F.concat(so_far["paths"], F.array(made)).alias("paths"))
