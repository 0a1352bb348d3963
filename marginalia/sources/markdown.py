"""Markdown source text to typed blocks.

What a line is depends on the lines before it (an open fence, a running list), so a small walker reads
the lines of one document. The document is one row already, so no shuffle is needed for it; the heading
path is added afterwards by ``blocks.with_heading_path``.

Supported: ATX and setext headings, fenced and indented code, pipe tables, lists, quotes, HTML and plain
paragraphs (kept as source text), thematic breaks (dropped). Nested blocks stay inside their container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.batches import written_batches
from marginalia.sources.blocks import with_heading_path

BLOCKS = "doc_id long, block_order int, type string, text string, level int"
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")
# The words of an ATX heading: what stands between its opening and closing number signs.
TITLE = re.compile(r"\s*#*\s*(.*?)\s*#*\s*$")
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)")
INTERRUPTING_ITEM = re.compile(r" {0,3}(?:[-+*]|1[.)])[ \t]+\S")
QUOTE = re.compile(r" {0,3}>")
DELIMITER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, block_order, type, text, heading_path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_walk_batches, BLOCKS)
    return with_heading_path(rows).drop("level")


def _walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]
    schema = pa.schema(list(zip((part.split()[0] for part in BLOCKS.split(", ")), types)))

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, text in zip(*batch.columns):
                doc = doc.as_py()
                yield from ((doc, order, *block) for order, block in enumerate(blocks_of(text.as_py())))

    return written_batches(rows(), schema, 3)


def blocks_of(text: str) -> Iterator[tuple[str, str, int | None]]:
    """(type, text, level) of each top-level block; ``level`` only for headings."""
    lines = text.split("\n")
    at = 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
            continue
        start, (at, kind, level) = at, _block_end(lines, at)
        body = "\n".join(lines[start:at]).strip()
        if kind == "fence":
            inner = lines[start + 1:at]
            if inner and _closes(FENCE.match(lines[start])[1], inner[-1]):
                inner = inner[:-1]
            yield "code", "\n".join(inner).rstrip("\n"), None
        elif kind == "indented":
            yield "code", "\n".join(each[4:] if each[:4].strip() == "" else each.lstrip("\t") for each in lines[start:at]).rstrip("\n"), None
        elif kind == "heading":
            underlined = at - start > 1
            yield "heading", lines[start].strip() if underlined else TITLE.match(body)[1], level
        elif kind != "rule" and body:
            yield kind, body, None


def _closes(opener: str, line: str) -> bool:
    mark = line.strip()
    return len(line) - len(line.lstrip(" ")) < 4 and set(mark) == {opener[0]} and len(mark) >= len(opener)


def _block_end(lines: list[str], at: int) -> tuple[int, str, int | None]:
    """Where the block that starts at a non-blank line ends (exclusive), its kind and heading level."""
    line, last = lines[at], len(lines)
    if line.startswith(("    ", "\t")):
        end = at + 1
        while end < last and (not lines[end].strip() or lines[end].startswith(("    ", "\t"))):
            end += 1
        while not lines[end - 1].strip():
            end -= 1
        return end, "indented", None
    if heading := ATX.match(line):
        return at + 1, "heading", len(heading[1])
    if fence := FENCE.match(line):
        end = at + 1
        while end < last and not _closes(fence[1], lines[end]):
            end += 1
        return min(end + 1, last), "fence", None
    if RULE.match(line):
        return at + 1, "rule", None
    if ITEM.match(line):
        return _list_end(lines, at), "paragraph", None
    if QUOTE.match(line):
        end = at + 1
        while end < last and lines[end].strip() and (QUOTE.match(lines[end]) or not _interrupts(lines[end])):
            end += 1
        return end, "paragraph", None
    if "|" in line and at + 1 < last and "|" in lines[at + 1] and DELIMITER.match(lines[at + 1]):
        if _columns(line) == _columns(lines[at + 1]):
            end = at + 2
            while end < last and lines[end].strip() and not _interrupts(lines[end]):
                end += 1
            return end, "table", None
    end = at + 1
    while end < last and lines[end].strip():
        if underline := SETEXT.match(lines[end]):
            return end + 1, "heading", 1 if underline[1][0] == "=" else 2
        if _interrupts(lines[end]):
            break
        end += 1
    return end, "paragraph", None


def _columns(row: str) -> int:
    return len(re.split(r"(?<!\\)\|", row.strip().strip("|")))


def _interrupts(line: str) -> bool:
    """Can this line end a paragraph without a blank line before it?"""
    return bool(ATX.match(line) or FENCE.match(line) or RULE.match(line) or QUOTE.match(line) or INTERRUPTING_ITEM.match(line))


def _marker(line: str) -> str | None:
    """What makes two items one list: the bullet character, or the sign after the number."""
    item = ITEM.match(line)
    return item[0].strip()[-1] if item and not RULE.match(line) else None


def _list_end(lines: list[str], at: int) -> int:
    """End of a list: blank lines stay inside while an indented line or an item of the same kind follows."""
    kind, end, last = _marker(lines[at]), at + 1, len(lines)
    while end < last:
        line = lines[end]
        inside = line.startswith(("  ", "\t")) or _marker(line) == kind
        if line.strip():
            if not inside and (not lines[end - 1].strip() or _marker(line) or _interrupts(line)):
                break
            end += 1
            continue
        ahead = end
        while ahead < last and not lines[ahead].strip():
            ahead += 1
        if ahead == last or not (lines[ahead].startswith(("  ", "\t")) or _marker(lines[ahead]) == kind):
            break
        end = ahead
    return end
