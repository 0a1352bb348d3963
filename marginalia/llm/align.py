"""Which tokens of two tokenizers stand for the same bytes, and how often, over a whole corpus.

Both token rows of a text are cut where tokens of both end. In most groups one token meets one of the same
bytes: a table from each id of A to the id of B with its bytes recognises them, and they are counted in a
vector as long as A's vocabulary. Only pairs from other groups are shuffled, once for a block of documents.

Texts are cut before words, where neither tokenizer joins, and each different piece is aligned once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import pieces as P
from marginalia.session import materialise, scratch_path

#: Pieces that a worker remembers, some 250 bytes each.
REMEMBERED = 200_000
#: Bytes of text after which a block of documents closes; a longer document is a block by itself.
BLOCK_BYTES = 4 << 20
#: Blocks that are written or read together, at most, and that a task scores, on average.
ROW_GROUP, SCORED = 2, 2
#: Bytes of pieces that are encoded together.
TOGETHER = 1 << 14

_BLOCK = T.StructType([
    T.StructField("block", T.LongType()),
    *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs")],
    T.StructField("groups_sha256", T.ArrayType(T.StringType())),
    T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("pair_docs", T.ArrayType(T.LongType())),
    T.StructField("same", T.ArrayType(T.LongType())),
])
_SCORED = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
    T.StructField("groups_sha256", T.StringType()),
])


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Two tokenizers, the bytes of their tokens, and the id of B with the bytes of each id of A (-1: none)."""

    def __init__(self, byte_level: str, piecewise: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piecewise)
        alphabet = _byte_alphabet()
        special = set(self.a.get_added_tokens_decoder())
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, at in self.a.get_vocab().items():
            if at not in special:
                self.bytes_a[at] = bytes(alphabet[c] for c in token)
        n = self.b.vocab_size()
        listed = [self.b.id_to_piece(i) for i in range(n)]
        none = [self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) for i in range(n)]
        byte = [re.fullmatch("<0x([0-9A-F]{2})>", p) if self.b.is_byte(i) else None for i, p in enumerate(listed)]
        self.bytes_b = [b"" if bad else bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()
                        for p, bad, m in zip(listed, none, byte)]
        known = {x: i for i, x in enumerate(self.bytes_b) if x and byte[i]}
        known |= {x: i for i, x in enumerate(self.bytes_b) if x and not byte[i]}  # a piece is preferred to a byte
        self.same = np.array([known.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.names = np.array([str(i) for i in range(max(len(self.bytes_a), n))], object)
        # pieces may be encoded apart if A splits words by its usual expression and no token of B crosses a cut
        before = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        inner = re.compile("[^▁]▁|.\n|\n.", re.S)
        self.cuttable = usual and not any(inner.search(p) for p in listed)

    def of_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def of_b(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts as they stand; None where the bytes of the tokens are not those of the text.

        The library puts a space before a text, so a letter and a line break, which joins with nothing, go first.
        Where pieces cannot be encoded apart, each text is a whole one that begins with that space.
        """
        lead = 3 if self.cuttable else 0
        out = []
        for text, ids in zip(texts, self.b.encode(["q\n" + t if lead else t[1:] for t in texts], num_threads=1)):
            size, k = 0, 0
            while size < lead and k < len(ids):
                size += len(self.bytes_b[ids[k]])
                k += 1
            same = size == lead and b"".join(map(self.bytes_b.__getitem__, ids[k:])) == text.encode()
            out.append(np.array(ids[k:], np.int64) if same else None)
        return out


class Pieces:
    """What is known of each different piece: counts, the groups as text, and its links as pairs with multiplicity.

    A pair is one number, a * (size of B's vocabulary) + b. Rows ``off[i]:off[i + 1]`` of ``pair`` and ``times``
    belong to piece i; ``keys`` are sorted hashes and ``slots`` the pieces they name.
    """

    def __init__(self, tokenizers: Tokenizers, remembered: int = REMEMBERED):
        self.t, self.remembered = tokenizers, remembered
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.bad, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)
        self.off, self.pair, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _append(self, text, counts, bad, sizes, pair, times) -> None:
        self.text += text
        self.counts = np.concatenate([self.counts, counts])
        self.bad = np.concatenate([self.bad, bad])
        self.uses = np.concatenate([self.uses, np.zeros(len(text), np.int64)])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(sizes)])
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times.astype(np.int32)])

    def forget(self) -> None:
        """Beyond the bound, the half of the pieces that were used most stays."""
        if len(self.keys) <= self.remembered:
            return
        stay = np.sort(np.argsort(-self.uses, kind="stable")[: self.remembered // 2])
        new = np.full(len(self.text), -1)
        new[stay] = np.arange(len(stay))
        _, places = P.spread(self.off, stay)
        sizes = (self.off[1:] - self.off[:-1])[stay]
        self.pair, self.times = self.pair[places], self.times[places]
        self.off = np.concatenate([[0], np.cumsum(sizes)])
        self.text = [self.text[i] for i in stay]
        self.counts, self.bad, self.uses = self.counts[stay], self.bad[stay], self.uses[stay] // 2
        keep = new[self.slots] >= 0
        self.keys, self.slots = self.keys[keep], new[self.slots[keep]]

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of every piece, learning those not met before; long ones are dropped by the next ``find``."""
        keep = len(self.slots)
        if len(self.text) > keep:  # the long pieces of the call before
            del self.text[keep:]
            self.counts, self.bad, self.uses = self.counts[:keep], self.bad[:keep], self.uses[:keep]
            self.off = self.off[: keep + 1]
            self.pair, self.times = self.pair[: self.off[-1]], self.times[: self.off[-1]]
        self.forget()
        found, first, back, times = np.unique(
            P.hashes(raw, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        where = np.searchsorted(self.keys, found)
        slots = np.full(len(found), -1)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == found[known]
        slots[known] = self.slots[where[known]]
        new = np.flatnonzero(~known)
        if len(new):
            long = ends[first[new]] - starts[first[new]] > P.LONG
            new = np.concatenate([new[~long], new[long]])
            base = len(self.text)
            self.learn([raw[a:b].tobytes() for a, b in zip(starts[first[new]], ends[first[new]])])
            slots[new] = base + np.arange(len(new))
            short = new[: len(new) - int(long.sum())]
            self.keys = np.insert(self.keys, where[short], found[short])
            self.slots = np.insert(self.slots, where[short], slots[short])
        self.uses[slots] += times
        return slots[back]

    def learn(self, new: list[bytes]) -> None:
        """Encode, align and append pieces; those that end in a letter or sign are encoded several at a time."""
        ends = [x[-1:].decode() if x[-1] < 0x80 else x[-4:].decode(errors="ignore")[-1] for x in new]
        alone = [not self.t.cuttable or x <= " " or x.isspace() for x in ends]
        size = np.array([len(x) for x in new], np.int64)
        joined = np.flatnonzero(~np.array(alone, bool))
        cuts = np.flatnonzero(np.diff(np.cumsum(size[joined]) // TOGETHER)) + 1
        runs = [r.tolist() for r in np.split(joined, cuts) if len(r)] + [[i] for i, x in enumerate(alone) if x]
        texts = [b"".join(new[i] for i in r).decode() for r in runs]
        of_a, of_b = self.t.of_a(texts), self.t.of_b(texts)
        again = [i for r, b in zip(runs, of_b) if b is None and len(r) > 1 for i in r]
        if again:  # a piece that B does not keep has company: each by itself
            texts = [new[i].decode() for i in again]
            of_a = [x for x, r, b in zip(of_a, runs, of_b) if b is not None or len(r) == 1] + self.t.of_a(texts)
            kept = [(r, b) for r, b in zip(runs, of_b) if b is not None or len(r) == 1]
            runs = [r for r, _ in kept] + [[i] for i in again]
            of_b = [b for _, b in kept] + self.t.of_b(texts)
        order = np.array([i for r in runs for i in r])
        bad = np.array([b is None for r, b in zip(runs, of_b) for _ in r], bool)
        empty = np.zeros(0, np.int64)
        a = np.concatenate([empty if y is None else x for x, y in zip(of_a, of_b)])
        b = np.concatenate([empty if y is None else y for y in of_b])
        text, counts, sizes, pair, times = self._aligned(a, b, np.where(bad, 0, size[order]))
        # back into the order of ``new``
        back = np.argsort(order)
        off = np.concatenate([[0], np.cumsum(sizes)])
        _, places = P.spread(off, back)
        self._append([text[i] for i in back], counts[back], bad[back], sizes[back], pair[places], times[places])

    def _aligned(self, a: np.ndarray, b: np.ndarray, size: np.ndarray):
        """(text, counts, number of pairs) of each piece, and all their pairs and times, of token rows over the pieces."""
        t, n, vb = self.t, len(size), len(self.t.bytes_b)
        ends_a, ends_b, ends = np.cumsum(t.size_a[a]), np.cumsum(t.size_b[b]), np.cumsum(size)
        mark = np.zeros(int(ends[-1]) + 1, np.uint8)
        mark[ends_a] |= 1
        mark[ends_b] |= 2
        if not (mark[ends[size > 0]] == 3).all():
            raise ValueError("a token crosses the cut before a word")
        close = np.flatnonzero(mark == 3)
        in_a, in_b = np.searchsorted(close, ends_a), np.searchsorted(close, ends_b)
        many_a, many_b = np.bincount(in_a, minlength=len(close)), np.bincount(in_b, minlength=len(close))
        piece = np.searchsorted(ends, close)
        counts = np.stack([np.bincount(piece, weights=w, minlength=n).astype(np.int64) for w in (
            many_a, many_b, np.ones(len(close)), many_a * many_b)], axis=1)
        one = (many_a == 1) & (many_b == 1)
        first_a, first_b = np.searchsorted(in_a, np.flatnonzero(one)), np.searchsorted(in_b, np.flatnonzero(one))
        key_a, times_a = np.unique(in_a[~one[in_a]] * len(t.bytes_a) + a[~one[in_a]], return_counts=True)
        key_b, times_b = np.unique(in_b[~one[in_b]] * vb + b[~one[in_b]], return_counts=True)
        group_a, group_b = key_a // len(t.bytes_a), key_b // vb
        starts_b = np.searchsorted(group_b, np.arange(len(close) + 1))
        which, at_b = P.spread(starts_b, group_a)
        where = np.concatenate([piece[one], piece[group_a[which]]])
        pair = np.concatenate([a[first_a] * vb + b[first_b], key_a[which] % len(t.bytes_a) * vb + key_b[at_b] % vb])
        times = np.concatenate([np.ones(len(first_a), np.int64), times_a[which] * times_b[at_b]])
        key, times = P.summed((where << 32) | pair, times)
        sizes = np.bincount(key >> 32, minlength=n)
        return self._text(a, b, in_a, in_b, piece, n), counts, sizes, key & 0xFFFFFFFF, times

    def _text(self, a, b, in_a, in_b, piece, n) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each piece."""
        place = np.concatenate([in_a * 2, in_b * 2 + 1])
        order = np.argsort(place, kind="stable")
        place = place[order]
        follow = np.full(len(place), "\n", object)
        if len(place):
            group = place >> 1
            same_side, same_group = place[1:] == place[:-1], group[1:] == group[:-1]
            same_piece = piece[group[1:]] == piece[group[:-1]]
            follow[:-1] = np.where(same_side, ",", np.where(same_group, "|", np.where(same_piece, ";", "\n")))
        names = self.t.names[np.concatenate([a, b])[order]]
        rows = "".join(chain.from_iterable(zip(names.tolist(), follow.tolist()))).encode().split(b"\n")[:-1]
        out = [b""] * n
        for i, row in zip(piece[np.diff(piece, prepend=-1) > 0].tolist(), rows):
            out[i] = row
        return out


def _pieces(paths: tuple[str, str]) -> Pieces:
    state = P.worker_state()
    if ("align", paths) not in state:
        state["align", paths] = Pieces(Tokenizers(*paths))
    return state["align", paths]


def _one(values, kind: pa.DataType) -> pa.ListArray:
    """A column of one row, a list."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


class _Block:
    """Documents whose pairs are counted together."""

    def __init__(self, number: int, same: np.ndarray, size_b: int, vector: np.ndarray):
        self.number, self.same, self.size_b, self.vector = number, same, size_b, vector
        self.bytes, self.docs, self.counts, self.digests, self.lengths, self.pair, self.times = 0, [], [], [], [], [], []

    def row(self) -> list:
        pair, times = np.concatenate(self.pair), np.concatenate(self.times)
        a, b = pair // self.size_b, pair % self.size_b
        equal = self.same[a] == b
        self.vector += np.bincount(a[equal], minlength=len(self.vector))
        others, back, docs = np.unique(pair[~equal], return_inverse=True, return_counts=True)
        at = np.empty(len(pair), np.int64)
        at[equal], at[~equal] = -a[equal] - 1, back
        counts = np.concatenate(self.counts)
        ids = pa.concat_arrays(self.docs)
        long, short = pa.int64(), pa.int32()
        return [pa.array([self.number], long), _one(ids, long), *[_one(c, long) for c in counts.T],
                _one(np.concatenate(self.lengths), long), _one(self.digests, pa.string()), _one(at, short), _one(times, short),
                _one(others, long), _one(docs, long), pa.nulls(1, pa.list_(long))]


def _documents(texts: pa.Array, known: Pieces):
    """Yield (first text, bytes, counts, groups as text or None, number of pairs, pairs, times) for runs of texts."""
    for first, raw, edges in P.prefixed(texts):
        n = len(edges) - 1
        starts, ends = P.cut(raw, edges) if known.t.cuttable else (edges[:-1][np.diff(edges) > 0], edges[1:][np.diff(edges) > 0])
        slots = known.find(raw, starts, ends) if len(starts) else np.zeros(0, np.int64)
        off = np.searchsorted(starts, edges)
        upto = lambda x: np.concatenate([np.zeros((1, *x.shape[1:]), np.int64), np.cumsum(x, axis=0)])
        total = upto(known.counts[slots])
        fails = upto(known.bad[slots].astype(np.int64))
        good = (fails[off[1:]] == fails[off[:-1]]) & (off[1:] > off[:-1])
        counts = (total[off[1:]] - total[off[:-1]]) * good[:, None]
        row = slots.tolist()
        groups = [b";".join(map(known.text.__getitem__, row[i:j])) if ok else None for i, j, ok in zip(off[:-1], off[1:], good)]
        doc = np.repeat(np.arange(n), np.diff(off))
        live = good[doc]
        size = len(known.text)
        key, times = np.unique(doc[live] * size + slots[live], return_counts=True)
        which, places = P.spread(known.off, key % size if len(key) else np.zeros(0, np.int64))
        pair, times = P.summed((key[which] // size << 32) | known.pair[places], times[which] * known.times[places])
        yield first, len(raw), counts, groups, np.bincount(pair >> 32, minlength=n), pair & 0xFFFFFFFF, times


def _encode(paths: tuple[str, str], block_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces(paths)
        vector = np.zeros(len(known.t.bytes_a), np.int64)
        number = TaskContext.get().partitionId() << 32
        block = _Block(number, known.t.same, len(known.t.bytes_b), vector)
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, size, counts, groups, lengths, pair, times in _documents(batch.column(1), known):
                block.docs.append(ids.slice(first, len(counts)))
                block.counts.append(counts)
                block.digests += ["" if g is None else hashlib.sha256(g).hexdigest() for g in groups]
                block.lengths.append(lengths)
                block.pair.append(pair)
                block.times.append(times)
                block.bytes += size
                if block.bytes >= block_bytes:
                    yield pa.RecordBatch.from_arrays(block.row(), names=_BLOCK.names)
                    number += 1
                    block = _Block(number, known.t.same, len(known.t.bytes_b), vector)
        if block.docs:
            yield pa.RecordBatch.from_arrays(block.row(), names=_BLOCK.names)
        if vector.any():
            rest = [pa.nulls(1, pa.list_(pa.string() if f.name == "groups_sha256" else pa.int32() if f.name in ("at", "times")
                                         else pa.int64())) for f in _BLOCK.fields[1:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), *rest, pa.array([vector.tolist()], pa.list_(pa.int64()))], names=_BLOCK.names)

    return encode


def _score(same_docs: list[int], best: list[int], size_b: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_same, most = np.array(same_docs), np.array(best)
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: batch.column(k)[i].values for k, c in enumerate(batch.schema.names)}
                n_docs = len(x["doc_id"])
                at, times, pairs, lengths = (x[c].to_numpy() for c in ("at", "times", "pairs", "n_pairs"))
                seen = np.zeros(len(pairs), np.int64)
                if len(pairs):
                    seen[x["seen"].field("at").to_numpy()] = x["seen"].field("n").to_numpy()
                a, n = -at.astype(np.int64) - 1, np.empty(len(at), np.int64)
                equal = at < 0
                a[~equal] = pairs[at[~equal]] // size_b
                n[equal], n[~equal] = of_same[a[equal]], seen[at[~equal]]
                edges = np.concatenate([[0], np.cumsum(lengths)])
                per_doc = [np.concatenate([[0], np.cumsum(v)]) for v in (times * (n == most[a]), times * n)]
                scores = [pa.array(v[edges[1:]] - v[edges[:-1]], pa.int64()) if n_docs else pa.array([], pa.int64()) for v in per_doc]
                yield pa.RecordBatch.from_arrays(
                    [*[x[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], *scores, x["groups_sha256"]], names=_SCORED.names)

    return score


class Alignment:
    """All documents aligned: ``pair_counts()`` over the corpus, ``documents()`` with what each contributes."""

    def __init__(self, docs: DataFrame, byte_level: str, piecewise: str, block_bytes: int = BLOCK_BYTES):
        self.tokenizers = Tokenizers(byte_level, piecewise)
        self.size_b = len(self.tokenizers.bytes_b)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        path = scratch_path(docs.sparkSession, "align-blocks")
        # by its size alone a row group would be closed after a hundred blocks at the earliest
        docs.mapInArrow(_encode((byte_level, piecewise), block_bytes), _BLOCK).write.option(
            "parquet.block.row.count.limit", ROW_GROUP).parquet(path)
        made = docs.sparkSession.read.schema(_BLOCK).parquet(path)
        self.blocks = made.filter("block is not null")
        self.vectors = made.filter("same is not null")
        self.irregular = materialise(
            self.blocks.select(F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p"))
            .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_docs").alias("n")), "align-pairs")

    def _same_docs(self) -> np.ndarray:
        """For each id of A, the documents that link it with the id of B of its bytes: a vector of the vocabulary's length."""
        total = np.zeros(len(self.tokenizers.bytes_a), np.int64)
        each = self.vectors.select(F.posexplode("same").alias("a", "n")).filter("n > 0")
        for row in each.groupBy("a").agg(F.sum("n").alias("n")).collect():
            total[row["a"]] = row["n"]
        return total

    def pair_counts(self) -> DataFrame:
        """a_id, b_id, n_docs of every pair of ids that some document links."""
        spark = self.irregular.sparkSession
        same = self._same_docs()
        rows = [(int(a), int(self.tokenizers.same[a]), int(same[a])) for a in np.flatnonzero(same)]
        regular = spark.createDataFrame(rows, "a_id long, b_id long, n_docs long")
        return regular.union(self.irregular.select(
            F.floor(F.col("pair") / self.size_b).alias("a_id"), (F.col("pair") % self.size_b).alias("b_id"), F.col("n").alias("n_docs")))

    def documents(self) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per document."""
        same = self._same_docs()
        best = same.copy()
        most = self.irregular.groupBy(F.floor(F.col("pair") / self.size_b).cast("long").alias("a")).agg(F.max("n").alias("n"))
        for row in most.collect():  # at most one number for each id of A
            best[row["a"]] = max(best[row["a"]], row["n"])
        tasks = max(1, -(-self.blocks.count() // SCORED))  # more blocks make more tasks, not larger ones
        wanted = self.blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
        seen = wanted.join(self.irregular, "pair").select(F.col("block").alias("_block"), "at", "n").repartition(
            tasks, "_block").groupBy("_block").agg(F.collect_list(F.struct("at", "n")).alias("seen"))
        both = self.blocks.repartition(tasks, "block").join(seen, F.col("block") == F.col("_block"), "left").select(
            *[c for c in _BLOCK.names if c not in ("block", "pair_docs", "same")], F.coalesce(
                "seen", F.array().cast("array<struct<at:int,n:bigint>>")).alias("seen"))
        return both.mapInArrow(_score(same.tolist(), best.tolist(), self.size_b), _SCORED)


def aligned_documents(docs: DataFrame, *, byte_level: str, piecewise: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizer (a tokenizers file) over a space and the text, B a piece tokenizer (a sentencepiece
    model) over the text, before which it puts a space; names of special tokens are plain text. Byte offsets where
    tokens of both end cut them into groups; every token of A is linked with every token of B in its group. A pair's
    count is the number of documents that hold it linked; ``n_best`` are the links whose count is the highest of
    their id of A, ties included, and ``count_sum`` adds up the counts of all links. ``groups_sha256`` is that of
    the groups, written ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts whose tokens do not give back their bytes, have no tokens: zeros and an empty
    ``groups_sha256``. Each row is a document of its own, also when its doc_id is null or repeated. A text of any
    length is aligned whole. Other columns are ignored; an empty table gives an empty result.
    """
    return Alignment(docs, byte_level, piecewise, block_bytes).documents()


def aligned_groups(docs: DataFrame, *, byte_level: str, piecewise: str) -> DataFrame:
    """doc_id and the groups of each document as text; null where it has no tokens."""
    paths = (byte_level, piecewise)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces(paths)
        for batch in batches:
            for first, _, counts, groups, *_ in _documents(batch.column(1), known):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()).slice(first, len(counts)), pa.array([g and g.decode() for g in groups], pa.string())],
                    names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "doc_id long, groups string")
