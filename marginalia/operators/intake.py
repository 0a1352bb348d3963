"""Intake: media type by content, size cap, hashing, exact duplicates, admission, fair dispatch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.replay import replay
from marginalia.functions.skew import running_count, running_sum

MAX_UPLOAD_BYTES = 32 * 1024 * 1024
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
TEXT = "text/plain"
MARKDOWN = "text/markdown"
# A zip directory record is 46 bytes, then the member name as plain bytes.
_MEMBER = r"(?s)PK\x01\x02.{42}"
_ZIP_END = "PK\x05\x06"
ADMITTED = (
    "doc_id long, tenant_id string, created_at timestamp_ntz, max_documents long, used_documents long, "
    "admitted boolean, reason string"
)


def media_type(content: Column, filename: Column) -> Column:
    """Media type proven by the bytes; the file name only tells Markdown from plain text. NULL = rejected."""
    latin = F.decode(content, "ISO-8859-1")
    is_zip = F.startswith(latin, F.lit("PK\x03\x04")) & F.contains(latin, F.lit(_ZIP_END))
    as_text = content.cast("string")
    hidden = r"[\p{C}\p{Z}&&[^ \t\n\r\f\x0B]]"
    readable = F.is_valid_utf8(as_text) & ~as_text.rlike(hidden)
    markdown = F.lower(filename).rlike(r"\.(md|markdown)$")
    return (
        F.when(F.octet_length(content) == 0, F.lit(None))
        .when(F.startswith(latin, F.lit("%PDF-")), PDF)
        .when(is_zip & latin.rlike(_MEMBER + r"word/document\.xml"), DOCX)
        .when(is_zip & latin.rlike(_MEMBER + r"xl/workbook\.xml"), XLSX)
        .when(readable & markdown, MARKDOWN)
        .when(readable, TEXT)
    )


def within_size(size: Column, limit: int = MAX_UPLOAD_BYTES) -> Column:
    return size <= limit


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def mark_duplicates(docs: DataFrame, keys: list[str], order: list[str], ident: str) -> DataFrame:
    """Add ``duplicate_of``: the first document with the same key, NULL for that first one.

    The first one is found by a map-side combined minimum, never by sorting a group of copies; the join
    back is one row per key on the right, which AQE splits when one key is hot on the left. A document
    whose key has a NULL part is nobody's duplicate.
    """
    first = docs.groupBy(*keys).agg(F.min(F.struct(*order, F.col(ident).alias("_first"))).alias("_f"))
    joined = docs.join(first, keys, "left")
    return joined.select(
        *docs.columns, F.when(F.col("_f._first") != F.col(ident), F.col("_f._first")).alias("duplicate_of")
    )


def unseen(docs: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Documents whose key is not stored yet (soft-deleted rows still hold their key)."""
    return docs.join(stored.select(*keys).distinct(), keys, "left_anti")


def admit(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Check every arriving document against its tenant's count and byte limit, in arrival order.

    ``limits``: tenant_id, max_documents, max_bytes (NULL = unlimited), used_documents, used_bytes.
    A rejected document uses nothing. As long as everything before a document was admitted the answer
    is a plain running sum; only rows behind a tenant's first rejection go through the ordered fold,
    which reads them row by row and keeps two numbers.
    """
    order = [F.col("created_at"), F.col("doc_id")]
    bucket = F.date_trunc("hour", "created_at")
    sized = docs.select("doc_id", "tenant_id", "created_at", "size_bytes")
    counted = running_count(sized, ["tenant_id"], bucket, order, "n")
    summed = running_sum(counted, ["tenant_id"], bucket, order, F.col("size_bytes"), "through")
    rows = summed.join(limits, "tenant_id", "left")
    count_ok = F.coalesce(F.col("used_documents") + F.col("n") <= F.col("max_documents"), F.lit(True))
    bytes_ok = F.coalesce(F.col("used_bytes") + F.col("through") <= F.col("max_bytes"), F.lit(True))
    rows = rows.withColumn("_fits", count_ok & bytes_ok)
    clear = rows.filter("_fits").select("doc_id", "tenant_id", F.lit(True).alias("admitted"), F.lit(None).cast("string").alias("reason"))
    # rows before the first rejection are settled; what they used is where the fold starts
    start = rows.filter("_fits").groupBy("tenant_id").agg(F.count("*").alias("_n"), F.sum("size_bytes").alias("_b"))
    late = rows.filter("not _fits").join(start, "tenant_id", "left").select(
        "doc_id", "tenant_id", "created_at", "size_bytes", "max_documents", "max_bytes",
        (F.coalesce("used_documents", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("base_n"),
        (F.coalesce("used_bytes", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("base_b"),
    )
    # a document that no longer fits at the fold's start never will: only the rest needs the order
    over_count = F.coalesce(F.col("base_n") + 1 > F.col("max_documents"), F.lit(False))
    over_bytes = F.coalesce(F.col("base_b") + F.col("size_bytes") > F.col("max_bytes"), F.lit(False))
    late = late.withColumn("_hopeless", F.when(over_count, "documents").when(over_bytes, "storage_bytes"))
    open_rows = late.filter("_hopeless is null").drop("_hopeless")
    folded = replay(open_rows, ["tenant_id"], ["created_at", "doc_id"], _Admission, ADMITTED)
    # the count limit is checked first: once a tenant is full, size is no longer the reason
    full = folded.filter(F.col("admitted") & (F.col("used_documents") >= F.col("max_documents"))).groupBy("tenant_id").agg(
        F.min(F.struct("created_at", "doc_id")).alias("_full")
    )
    refused = late.filter("_hopeless is not null").join(full, "tenant_id", "left").select(
        "doc_id", "tenant_id", F.lit(False).alias("admitted"),
        F.when(F.struct("created_at", "doc_id") > F.col("_full"), "documents").otherwise(F.col("_hopeless")).alias("reason"),
    )
    return clear.unionByName(folded.select(*clear.columns)).unionByName(refused)


class _Admission:
    """State of one tenant behind its first rejection: documents and bytes used so far."""

    def __init__(self, key: tuple):
        self.tenant, self.documents, self.bytes = key[0], None, None

    def row(self, doc) -> Iterator[tuple]:
        if self.documents is None:
            self.documents, self.bytes = int(doc.base_n), int(doc.base_b)
        size, reason = int(doc.size_bytes), None
        if not pd.isna(doc.max_documents) and self.documents + 1 > doc.max_documents:
            reason = "documents"
        elif not pd.isna(doc.max_bytes) and self.bytes + size > doc.max_bytes:
            reason = "storage_bytes"
        else:
            self.documents, self.bytes = self.documents + 1, self.bytes + size
        limit = None if pd.isna(doc.max_documents) else int(doc.max_documents)
        yield (doc.doc_id, self.tenant, doc.created_at, limit, self.documents, reason is None, reason)

    def end(self) -> Iterator[tuple]:
        return iter(())


def fair_waves(backlog: DataFrame, k: int = 2) -> DataFrame:
    """Dispatch order that lets no tenant hold more than ``k`` places in one wave.

    ``wave`` counts from 1; ``place`` is the document's place among its tenant's ``k`` in that wave.
    """
    turn = running_count(
        backlog, ["tenant_id"], F.date_trunc("hour", "created_at"), [F.col("created_at"), F.col("doc_id")], "turn"
    )
    return turn.withColumn("wave", (F.floor((F.col("turn") - 1) / k) + 1).cast("int")).withColumn(
        "place", ((F.col("turn") - 1) % k + 1).cast("int")
    )
