"""Token ids of whole texts, packed in the fewest bits of the vocabulary, in blocks of whole documents.

The store is a Parquet folder with one row per block: where the block stands among all blocks of its shard,
the bits of its ids, and how many ids each of its documents has. Blocks are read in any order, and
an id at any place is found from the block's offset and the fixed width alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import pieces as P
from marginalia.llm import words as W
from marginalia.session import scratch_path

#: Ids after which a block closes; the next document opens a new one.
BLOCK_IDS = 1 << 18
#: Pieces of text whose ids a worker remembers over all its tasks, some 60 bytes each.
CACHE = 1_000_000
#: Pieces that are encoded as one text.
TOGETHER = 500

_BLOCK = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
    T.StructField("n_ids", T.LongType()), T.StructField("bits", T.IntegerType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("packed", T.BinaryType()),
])


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` per id, least bit first, one after another."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """The ids ``start .. start + count - 1`` of a block, without reading those before."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, dtype=f"<u{bits // 8}", offset=start * (bits // 8), count=count).astype(np.uint32)
    first = start * bits
    raw = np.frombuffer(packed, dtype=np.uint8)[first // 8 : -(-(first + count * bits) // 8)]
    flat = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + count * bits].reshape(count, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _taken(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same list column, values and offsets, of some of its rows."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    places = np.repeat(offsets[rows] - ends + sizes, sizes)
    places += np.arange(len(places))
    return flat[places], np.concatenate([[0], ends])


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer that never joins across white space before a word.

    Texts are cut there and each different piece is encoded once: pieces are found by a hash among sorted hashes,
    all at once for some texts, and their bytes are compared with those remembered. What the pieces give is
    exactly what the whole text gives. Beyond ``cache`` pieces, or 32 bytes for each, the half used most stays.

    With ``special_as_text`` names of special tokens are text like any other; else a text that holds such a
    name is encoded whole, as the library does by default.
    """

    def __init__(self, path: str, cache: int = CACHE, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.path, self.whole = path, None
        self.special = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = cache
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)
        for token, at in self.tokenizer.get_vocab().items():
            self.bytes_of[at] = len(token)  # one character of a token stands for one byte
        # hashes in order, and the row each has in the columns of bytes, ids and uses
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.raw_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        if len(self.keys) <= self.cache and len(self.raw) <= 32 * self.cache:
            return
        most = np.argsort(-self.uses, kind="stable")[: self.cache // 2]
        stay = np.sort(most[np.cumsum(np.diff(self.raw_at)[most]) <= 16 * self.cache])
        moved = np.full(len(self.uses), -1)
        moved[stay] = np.arange(len(stay))
        kept = moved[self.rows] >= 0
        self.keys, self.rows = self.keys[kept], moved[self.rows[kept]]
        self.raw, self.raw_at = _taken(self.raw, self.raw_at, stay)
        self.ids, self.ids_at = _taken(self.ids, self.ids_at, stay)
        self.uses = self.uses[stay] // 2

    def _learn(self, raw: np.ndarray, at: np.ndarray, rows: np.ndarray):
        """(order, bytes, their offsets, ids, their offsets) of some pieces, which come out as ``rows[order]``.

        Pieces that begin with white space and do not end with it are joined to longer texts and divided by bytes.
        """
        first, last = raw[at[rows]], P.after_white_space(raw, at[rows + 1])
        joined = ((first == 0x20) | (first == 0x0A)) & ~last
        order, n = np.argsort(~joined, kind="stable"), int(joined.sum())
        flat, flat_at = _taken(raw, at, rows[order])
        cuts = np.concatenate([np.arange(0, n, TOGETHER), np.arange(n, len(rows) + 1)])
        data, cuts = flat.tobytes(), flat_at[cuts].tolist()
        texts, parts = [data[a:b].decode() for a, b in zip(cuts, cuts[1:])], []
        for i in range(0, len(texts), 16):  # what the library returns is far larger than the ids
            found = self.tokenizer.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)
            parts.append(np.fromiter(chain.from_iterable(e.ids for e in found), dtype="<u4"))
        ids = np.concatenate(parts)
        ends = np.cumsum(self.bytes_of[ids])
        ids_at = np.concatenate([[0], np.searchsorted(ends, flat_at[1:]) + 1])
        if not len(ids) or ids_at[-1] != len(ids) or not np.array_equal(ends[ids_at[1:] - 1], flat_at[1:]):
            raise ValueError("a token crosses the cut before a word")
        return order, flat, flat_at, ids, ids_at

    def _ids_of(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces ``raw[at[i]:at[i + 1]]``, one after another, and how many each has."""
        self._forget()
        found, first, back, times = np.unique(
            P.hashes(raw, at[:-1], at[1:]), return_index=True, return_inverse=True, return_counts=True)
        where = np.searchsorted(self.keys, found)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == found[known]
        rows = np.full(len(found), -1)
        rows[known] = self.rows[where[known]]
        new = np.flatnonzero(~known)
        if len(new):
            order, flat, flat_at, ids, ids_at = self._learn(raw, at, first[new])
            rows[new[order]] = len(self.uses) + np.arange(len(new))
            self.raw_at = np.concatenate([self.raw_at, len(self.raw) + flat_at[1:]])
            self.ids_at = np.concatenate([self.ids_at, len(self.ids) + ids_at[1:]])
            self.raw, self.ids = np.concatenate([self.raw, flat]), np.concatenate([self.ids, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            self.keys, self.rows = np.insert(self.keys, where[new], found[new]), np.insert(self.rows, where[new], rows[new])
        self.uses[rows] += times
        rows = rows[back]
        same = np.array_equal((self.raw_at[1:] - self.raw_at[:-1])[rows], np.diff(at))
        if same and np.array_equal(_taken(self.raw, self.raw_at, rows)[0], raw):
            ids, ids_at = _taken(self.ids, self.ids_at, rows)
        else:  # two pieces of one hash: none of these is taken from memory
            order, _, _, ids, ids_at = self._learn(raw, at, np.arange(len(at) - 1))
            ids, ids_at = _taken(ids, ids_at, np.argsort(order))
        return ids, np.diff(ids_at)

    def runs(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """The ids of each text, for runs of texts of some bytes together; a longer text comes alone. Null is empty."""
        data, edges = W.buffers(texts)
        named = np.zeros(len(texts), bool)
        for name in self.special:
            named |= pc.fill_null(pc.match_substring(texts, name), False).to_numpy(zero_copy_only=False)
        i, n = 0, len(texts)
        while i < n:
            j = int(np.searchsorted(edges, edges[i] + W.SLICE, side="right")) - 1
            j = min(max(j, i + 1), n)
            raw, inside = data[edges[i] : edges[j]], edges[i : j + 1] - edges[i]
            starts, _ = P.cut(raw, inside)
            at, ids, sizes = np.append(starts, len(raw)), [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
            a = 0
            while a < len(starts):
                b = max(int(np.searchsorted(at, at[a] + W.SLICE, side="right")) - 1, a + 1)
                of_run, many = self._ids_of(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                ids.append(of_run)
                sizes.append(many)
                a = b
            upto = np.cumsum(np.concatenate(sizes))[np.searchsorted(starts, inside)]
            ids = np.concatenate(ids)
            out = [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
            for k in np.flatnonzero(named[i:j]).tolist():
                self.whole = self.whole or type(self.tokenizer).from_file(self.path)
                out[k] = np.array(self.whole.encode(texts[i + k].as_py(), add_special_tokens=False).ids, dtype="<u4")
            yield out
            i = j

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        return [ids for run in self.runs(pa.array(texts, pa.large_string())) for ids in run]


def _encoder(path: str) -> Encoder:
    state = P.worker_state()
    if ("encoder", path) not in state:
        state["encoder", path] = Encoder(path, special_as_text=False)
    return state["encoder", path]


def _write_blocks(path: str, end_id: int, block_ids: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard, block = TaskContext.get().partitionId(), 0
        encoder, end = _encoder(path), np.array([end_id], dtype="<u4")
        bits = width(len(encoder.bytes_of))
        docs, lengths, parts, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            row = [shard, block, size, bits, docs, lengths, pack(np.concatenate(parts), bits)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=_BLOCK.names)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), chain.from_iterable(encoder.runs(batch.column(1)))):
                docs.append(key)
                lengths.append(len(ids) + 1)
                parts += (ids, end)
                size += len(ids) + 1
                if size >= block_ids:
                    yield closed()
                    docs, lengths, parts, size, block = [], [], [], 0, block + 1
        if docs:
            yield closed()

    return blocks


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write the store to the folder ``path``, in ascending order of doc_id.

    ``end_id`` follows each document. Null and empty texts have only that id. Documents without doc_id come
    first; rows that share a doc_id stand in the order of a hash of their texts. An empty table gives an empty store.
    A special token's name in a text gives that token's id. Other columns are ignored. A block holds whole documents, so a very long one is a block by itself.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    ordered.mapInArrow(_write_blocks(tokenizer, end_id, block_ids), _BLOCK).write.option(
        "compression", "zstd").parquet(path)


def _documents(spark: SparkSession, path: str, column: str, of, kind: pa.DataType) -> DataFrame:
    """doc_id, start, n_tokens, shard, block, place and what ``of`` makes of each document's ids.

    Blocks are unpacked where they lie; only the sizes of blocks are added up over the whole store.
    """
    name = column.split()[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, bits, docs, lengths = (batch.column(i)[row].as_py() for i in range(5))
                places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                ids = unpack(batch.column(5)[row].as_buffer(), bits, 0, int(places[-1]))
                made = [of(ids[a:b]) for a, b in zip(places[:-1], places[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()),
                     pa.array(docs, pa.int64()), pa.array(places[:-1]), pa.array(lengths, pa.int64()), pa.array(made, kind)],
                    names=["shard", "block", "doc_id", "place", "n_tokens", name],
                )

    blocks = spark.read.schema(_BLOCK).parquet(path)
    rows = blocks.select("shard", "block", "bits", "doc_ids", "lengths", "packed").mapInArrow(
        read, f"shard int, block int, doc_id long, place long, n_tokens long, {column}")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("of_shard"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("of_block")).join(
        shards, "shard").select("shard", "block", (F.col("of_shard") + F.col("of_block")).alias("base"))
    return rows.join(bases, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "shard", "block", "place", name)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, shard, block, place, ids."""
    return _documents(spark, path, "ids array<int>", lambda ids: ids.tolist(), pa.list_(pa.int32()))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """The same with ids_crc32, of the ids as little-endian unsigned 32-bit numbers, in place of the ids."""
    return _documents(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def encoded(docs: DataFrame, *, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the store to the shared folder and return what it holds: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer=tokenizer, end_id=end_id)
    return token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "block", "place")
