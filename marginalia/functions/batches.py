"""Rows that Python makes from texts, handed on as Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters and rows that are held before they are handed on.
HELD_CHARS, HELD_ROWS = 1 << 21, 10_000


def written_batches(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of some ``HELD_CHARS`` characters of their column number ``text``, however many rows come."""
    held: list[tuple] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        chars += len(row[text])
        if chars >= HELD_CHARS or len(held) >= HELD_ROWS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()
