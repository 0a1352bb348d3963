"""Language identification: known words first, then ever shorter character n-grams for unseen words.

A word that was seen in training adds its log frequency in each language. Of any other word the longest
character n-grams of which at least one was seen stand in, with the mean of their log frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm import words as W
from marginalia.llm.pieces import worker_state
from marginalia.session import materialise

#: Labelled documents a language is learned from.
SAMPLE_ROWS = 2000
#: A longer text counts as much as one of so many characters, so that no single document speaks for its language.
FULL_CHARS = 2000
#: Runs of more letters are known by their n-grams alone.
LONGEST_WORD = 100
#: Counts are whole numbers of this share of one, so that their sums do not depend on order.
_UNIT = 1 << 20
#: Log frequencies in a model; beyond that the words and n-grams counted least are left out.
MAX_CELLS = 24_000_000
LENGTHS = (4, 3, 2, 1)
_SLICE = 1 << 18
_EDGE = np.uint64(0xA0761D6478BD642F)

_COUNTS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("kind", T.IntegerType()),
    T.StructField("hash", T.LongType()), T.StructField("n", T.LongType()),
])
_FOUND = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


class Model(NamedTuple):
    languages: list[str]
    prior: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # 0 for words, n for n-grams: sorted hashes, log frequencies


def _letters() -> np.ndarray:
    """The lower-case letter of each code point, 0 for what is no letter; made once in a worker."""
    state = worker_state()
    if "letters" in state:
        return state["letters"]
    table = np.zeros(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return state.setdefault("letters", table)


class _Flat(NamedTuple):
    rows: np.ndarray  # the text each word belongs to
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    total: np.ndarray  # prefix sums over characters, word edges counted as one


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers, texts) of a slice of characters together; longer texts are cut where no letter stands.

    A word longer than a slice is read in pieces.
    """
    numbers, parts, size = [], [], 0
    for number, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text) or at == 0:
            end = min(at + _SLICE, len(text))
            if end < len(text):
                cut = end
                while cut > at and text[cut - 1].isalpha():
                    cut -= 1
                end = cut if cut > at else end
            if parts and size + end - at > _SLICE:
                yield numbers, parts
                numbers, parts, size = [], [], 0
            numbers.append(number)
            parts.append(text[at:end])
            size += end - at + 1
            at = max(end, at + 1)
    if parts:
        yield numbers, parts


def _flat(numbers: list[int], parts: list[str]) -> _Flat:
    joined = "\n" + "\n".join(parts) + "\n"
    low = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    inside = low != 0
    edges = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
    weights = np.where(inside, W.mix(low.astype(np.uint64)), _EDGE)
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(weights * W.power("up", len(low)), out=total[1:])
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
    rows = np.array(numbers)[np.searchsorted(begins, starts, side="right") - 1] if len(starts) else np.zeros(0, np.int64)
    return _Flat(rows, starts, ends, _hash(total, starts, ends - starts), total)


def _hash(total: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    return W.mix((total[starts + lengths] - total[starts]) * W.power("down", len(total))[starts])


def _grams(total: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which word) of the n-grams of words together with their edges."""
    counts = np.maximum(ends - starts + 3 - n, 0)
    word = np.repeat(np.arange(len(starts)), counts)
    first = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    return _hash(total, starts[word] - 1 + first, n), word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = batch.column(0).to_pylist()
        names = sorted(set(languages))
        number = np.array([names.index(x) for x in languages])
        texts = batch.column(1).to_pylist()
        weight = np.array([max(1, _UNIT * FULL_CHARS // max(FULL_CHARS, len(t or ""))) for t in texts], dtype=np.float64)
        for numbers, parts in _pieces(texts):
            flat = _flat(numbers, parts)
            for k, name in enumerate(names):
                own = number[flat.rows] == k if len(flat.rows) else np.zeros(0, bool)
                if not own.any():
                    continue
                mine = weight[flat.rows[own]]
                short = np.flatnonzero((flat.ends - flat.starts)[own] <= LONGEST_WORD)
                kinds = {0: (flat.hashes[own][short], short)}
                kinds |= {n: _grams(flat.total, flat.starts[own], flat.ends[own], n) for n in LENGTHS}
                for kind, (hashes, word) in kinds.items():
                    hashes, place = np.unique(hashes, return_inverse=True)
                    n = np.bincount(place, weights=mine[word], minlength=len(hashes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(hashes), pa.string()), pa.array([kind] * len(hashes), pa.int32()),
                         pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=_COUNTS.names)


def _commonest(counted: DataFrame, most: int) -> DataFrame:
    """Counts of some ``most`` words and n-grams that were counted most in all languages together.

    Of the least count that still has a place, as many as there is room for, chosen by a hash.
    """
    totals = counted.groupBy("kind", "hash").agg(F.sum("n").alias("total"))
    steps = totals.groupBy(F.floor(F.log("total") * 32).alias("step")).agg(F.count("*").alias("size"))
    sizes = sorted(((r.step, r.size) for r in steps.collect()), reverse=True)  # some 1,400 steps hold every long
    if sum(size for _, size in sizes) <= most:
        return counted
    room, last, share = most, None, 0.0
    for step, size in sizes:
        last, share = step, min(1.0, room / size)
        room -= size
        if room <= 0:
            break
    step, chance = F.floor(F.log("total") * 32), F.pmod(F.xxhash64("kind", "hash"), F.lit(1 << 30)) / (1 << 30)
    kept = totals.filter((step > last) | ((step == last) & (chance < share)))
    return counted.join(kept.select("kind", "hash"), ["kind", "hash"], "left_semi")


def train(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, max_cells: int = MAX_CELLS) -> Model:
    """Learn from rows of ``docs`` (doc_id, text, lang); those without text, lang or doc_id are passed over.

    Word and n-gram frequencies come from the whole texts, however long, of about ``sample_rows`` rows of each
    language, chosen by a hash of their ids; counts of texts beyond ``FULL_CHARS`` characters are scaled down to that
    weight, and runs of over ``LONGEST_WORD`` letters are learned by n-grams alone. The languages' shares come from all rows. A model has some ``max_cells``
    numbers, one for each language and word or n-gram: beyond that the rarest are left out.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.dropna()
    shares = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy("lang").collect()
    languages, sizes = [r.lang for r in shares], np.array([r.rows for r in shares], dtype=float)
    if not languages:
        return Model([], np.zeros(0), {})
    size_of = F.create_map(*[F.lit(v) for r in shares for v in (r.lang, r.rows)])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.filter(chance * F.try_element_at(size_of, F.col("lang")) < sample_rows).select("lang", "text")
    counted = materialise(
        sample.mapInArrow(_count, _COUNTS).groupBy("lang", "kind", "hash").agg(F.sum("n").cast("long").alias("n")),
        "language-counts")
    found = _commonest(counted, max(1, max_cells // len(languages))).toArrow()
    lang = pc.index_in(found["lang"], value_set=pa.array(languages, found["lang"].type)).to_numpy()
    kind, keys, n = (found[c].to_numpy() for c in ("kind", "hash", "n"))
    tables = {}
    for k in (0, *LENGTHS):
        of = kind == k
        known, place = np.unique(keys[of].view(np.uint64), return_inverse=True)
        counts = np.full((len(known), len(languages)), 0.1)
        np.add.at(counts, (place, lang[of]), n[of] / _UNIT)
        tables[k] = known, np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return Model(languages, np.log(sizes / sizes.sum()), tables)


def _places(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return at, known[at] == hashes


def _word_scores(model: Model, flat: _Flat) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the different words of a slice, and which of them each word is."""
    hashes, first, which = np.unique(flat.hashes, return_index=True, return_inverse=True)
    known, logs = model.tables[0]
    at, seen = _places(known, hashes)
    scores = np.zeros((len(hashes), len(model.languages)), dtype=np.float32)
    scores[seen] = logs[at[seen]]
    left = np.flatnonzero(~seen)
    for n in LENGTHS:
        if not len(left):
            break
        known, logs = model.tables[n]
        grams, word = _grams(flat.total, flat.starts[first[left]], flat.ends[first[left]], n)
        at, seen = _places(known, grams)
        at, word = at[seen], word[seen]
        hits = np.bincount(word, minlength=len(left))
        for k in range(len(model.languages)):
            sums = np.bincount(word, weights=logs[at, k], minlength=len(left))
            scores[left, k] = np.where(hits > 0, sums / np.maximum(hits, 1), 0)
        left = left[hits == 0]
    return scores, which


def _identify(model, place: int):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Model(*model.value)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            sums = np.tile(found.prior, (len(texts), 1))
            words = np.zeros(len(texts), dtype=np.int64)
            for numbers, parts in _pieces(texts):
                flat = _flat(numbers, parts)
                if not len(flat.rows):
                    continue
                words += np.bincount(flat.rows, minlength=len(texts))
                if found.languages:
                    scores, which = _word_scores(found, flat)
                    for k in range(len(found.languages)):
                        sums[:, k] += np.bincount(flat.rows, weights=scores[which, k], minlength=len(texts))
            if found.languages:
                sums -= sums.max(axis=1, keepdims=True)
                share = 1 / np.exp(sums).sum(axis=1)
                best = [found.languages[k] if n else "und" for k, n in zip(sums.argmax(axis=1), words)]
                share = np.where(words > 0, share, 0.0)
            else:
                best, share = ["und"] * len(texts), np.zeros(len(texts))
            made = [pa.array(best, pa.string()), pa.array(share, pa.float64())]
            columns = [c for i, c in enumerate(batch.columns) if i != place or not batch.schema.names[i].startswith("_")]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[f"c{i}" for i in range(len(columns) + 2)])

    return identify


def identify(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, lang_pred, score.

    ``score`` is the share of the best language among all, by words and the languages' shares in training.
    Texts that are null or have no letter are 'und' with score 0, and so are all if nothing was learned. Ties
    go to the language that comes first by name. Whole texts count; repeated rows each give a row.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    if "text" in keep:
        place, fields = keep.index("text"), rows.schema.fields
        rows = rows.toDF(*[f"c{i}" for i in range(len(keep))])
    else:
        place, fields = len(keep), rows.schema.fields
        rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string"))
        rows = rows.toDF(*[f"c{i}" for i in range(len(keep))], "_text")
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*fields, *_FOUND])])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # a plain tuple needs no class where it is read
    return rows.mapInArrow(_identify(shared, place), schema).toDF(*keep, *[f.name for f in _FOUND])
