"""Benchmark decontamination: runs of benchmark words found in documents, word by word, by a hash set."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import words as W
from marginalia.session import materialise

#: Windows (with their items) broadcast as one block, some 100 bytes each.
MAX_WINDOWS = 400_000
_FILTER_BITS = 22

_WINDOWS = T.StructType([
    T.StructField("item", T.StringType()), T.StructField("n", T.IntegerType()),
    T.StructField("hash", T.LongType()), T.StructField("words", T.BinaryType()),
])
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_HITS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN)),
]


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by its first word."""
    count = max(len(hashes) - n + 1, 0)
    total = np.full(count, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        total *= W.BASE
        total += hashes[k : k + count]
    return W.mix(total)


def _spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(W.ALPHANUMERIC[raw[s:e]].tobytes() for s, e in zip(starts, ends))


def _item_windows(size: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.buffers(batch.column(1))
            names = batch.column(0).to_pylist()
            rows = []
            for part in W.words(batch.column(1), W.ALPHANUMERIC):
                for i, (a, b) in enumerate(zip(part.offsets[:-1], part.offsets[1:])):
                    n = min(size, int(b - a))
                    if n == 0:
                        continue
                    raw = data[at[part.first + i] : at[part.first + i + 1]]
                    for k, h in enumerate(_runs(part.hashes[a:b], n)):
                        spelled = _spelled(raw, part.starts[a + k : a + k + n], part.ends[a + k : a + k + n])
                        rows.append((names[part.first + i], n, int(h.view(np.int64)), spelled))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                names=_WINDOWS.names,
            )

    return windows


def _block(windows: DataFrame, k: int, count: int):
    """One of ``count`` parts of the windows, ready for the tasks: {length: hashes}, {words: items}."""
    lengths: dict[int, list[int]] = defaultdict(list)
    owners: dict[bytes, list[str]] = defaultdict(list)
    for row in windows.filter(F.pmod("hash", F.lit(count)) == k).toLocalIterator():
        lengths[row.n].append(row.hash)
        owners[bytes(row.words)].append(row.item)
    sets = {n: np.unique(np.array(h, dtype=np.int64).view(np.uint64)) for n, h in lengths.items()}
    return windows.sparkSession.sparkContext.broadcast((sets, dict(owners)))


def _in_set(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Positions of ``found`` whose hash is in the sorted ``known``; a bit table turns most away."""
    bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
    bits[known >> np.uint64(64 - _FILTER_BITS)] = True
    near = np.flatnonzero(bits[found >> np.uint64(64 - _FILTER_BITS)])
    at = np.searchsorted(known, found[near])
    return near[known[np.minimum(at, len(known) - 1)] == found[near]]


def _merged(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the runs of true values."""
    edges = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _code_points(raw: np.ndarray, part: W.Words, a: int, b: int, hit: np.ndarray) -> list[dict]:
    """The hit runs of the text ``raw``, whose words are a:b, as code points."""
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    first, last = _merged(hit)
    return [{"start": int(characters[s]), "end": int(characters[e])}
            for s, e in zip(part.starts[a:b][first], part.ends[a:b][last])]


def _scan(block, earlier: bool, last: bool):
    """Find a block's windows. Word positions and items travel on to the next block; the last one reports."""
    word_runs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, names = block.value
        for batch in batches:
            width = batch.num_columns - (2 if earlier else 0)
            texts = batch.column(width - 1)
            items = [set(x) for x in batch.column(width).to_pylist()] if earlier else [set() for _ in range(len(texts))]
            known_runs = batch.column(width + 1).to_pylist() if earlier else None
            data, at = W.buffers(texts)
            n_words, n_hit, spans = [], [], []
            for part in W.words(texts, W.ALPHANUMERIC):
                marks = np.zeros(len(part.hashes) + 1, dtype=np.int64)
                for n, known in sets.items():
                    for w in _in_set(_runs(part.hashes, n), known):
                        doc = int(np.searchsorted(part.offsets, w, side="right")) - 1
                        if w + n > part.offsets[doc + 1]:
                            continue
                        raw = data[at[part.first + doc] : at[part.first + doc + 1]]
                        own = names.get(_spelled(raw, part.starts[w : w + n], part.ends[w : w + n]))
                        if own:
                            items[part.first + doc].update(own)
                            marks[w] += 1
                            marks[w + n] -= 1
                hit = np.cumsum(marks[:-1]) > 0
                for doc, (a, b) in enumerate(zip(part.offsets[:-1], part.offsets[1:])):
                    row = part.first + doc
                    for run in known_runs[row] if earlier else ():
                        hit[a + run["start"] : a + run["end"]] = True
                    n_words.append(int(b - a))
                    n_hit.append(int(hit[a:b].sum()))
                    if not n_hit[-1]:
                        spans.append([])
                    elif last:
                        spans.append(_code_points(data[at[row] : at[row + 1]], part, a, b, hit[a:b]))
                    else:
                        spans.append([{"start": int(s), "end": int(e) + 1} for s, e in zip(*_merged(hit[a:b]))])
            found = [pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, word_runs)]
            if last:
                found = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), *found]
            columns = batch.columns[: width - 1 if last else width]
            yield pa.RecordBatch.from_arrays([*columns, *found], names=[f"c{i}" for i in range(len(columns) + len(found))])

    return scan


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, max_windows: int = MAX_WINDOWS,
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the columns ``keep``, n_words, n_hit, items, spans.

    Words are runs of ASCII letters and digits and of characters outside ASCII, A-Z lower-cased. A window is
    ``size`` consecutive words of an item; an item of fewer words, but not none, is one window. ``n_hit``
    counts the words inside any occurrence of a window, ``items`` are the ids (as text, sorted) of the items
    with one, and ``spans`` the hit runs as code points [start, end) of the text.

    Null and empty texts have no words. Items without an id are one item named ''; items that share an id
    are one. Repeated documents each give a row. No benchmark means no hits. Columns may have any names;
    those of the result come after ``keep``.

    Window hashes find candidates, and the words themselves confirm them. A set of up to ``max_windows``
    windows is broadcast; a larger benchmark is searched for in as many passes as it has such blocks, each
    pass handing on what it found, so no task holds more than one block beyond its texts.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    windows = materialise(items.mapInArrow(_item_windows(size), _WINDOWS).distinct(), "benchmark-windows")
    count = max(1, -(-windows.count() // max_windows))
    rows = docs.select(*keep, F.col("text").cast("string"))
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    runs = [T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))]
    for k in range(count):
        last = k == count - 1
        fields = rows.schema.fields[: len(keep)] if last else rows.schema.fields[: len(keep) + 1]
        fields = [*fields, *(_HITS if last else runs)]
        schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
        rows = rows.mapInArrow(_scan(_block(windows, k, count), k > 0, last), schema)
        if not last:
            rows = materialise(rows, "benchmark-hits")
    return rows.toDF(*keep, *[f.name for f in _HITS])


def _whole(docs: DataFrame, benchmark: DataFrame, how: dict) -> tuple[DataFrame, int]:
    """All columns under numbers, then the four of the hits."""
    found = benchmark_hits(docs, benchmark, keep=tuple(f"`{c}`" for c in docs.columns), **how)
    return found.toDF(*[f"c{i}" for i in range(len(found.columns))]), len(docs.columns)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any hit, with all their columns."""
    found, n = _whole(docs, benchmark, how)
    return found.filter(F.col(f"c{n + 1}") == 0).select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def remove_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """All documents, with all their columns; the hit runs are cut out of their texts."""
    found, n = _whole(docs, benchmark, how)
    text, spans = F.col(f"c{docs.columns.index('text')}"), F.col(f"c{n + 3}")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.transform(
        F.arrays_zip(starts.alias("start"), ends.alias("end")),
        lambda p: F.substr(text, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")),
    )
    cut = F.when(F.size(spans) > 0, F.concat_ws("", pieces)).otherwise(text)
    return found.select([(cut if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])
