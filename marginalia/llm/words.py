"""Words of whole texts as 64-bit hashes, found for many texts at once on their UTF-8 bytes.

A word is a maximal run of word bytes; all bytes of a character outside ASCII are word bytes in both
alphabets below, so byte runs and character runs are the same. A-Z count as a-z.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer word is hashed by itself.
SLICE = 1 << 20

_random = np.random.default_rng(20240229)
_WEIGHT = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT[0] = 0
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _lower(separators: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[separators] = 0
    return table


#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
BLANK_SEPARATED = _lower(np.array([0x20, *range(0x09, 0x0E)]))
#: NUL is a word byte there; it takes the place of the space, which is none.
BLANK_SEPARATED[0] = 0x20
#: ASCII letters and digits, and everything outside ASCII.
ALPHANUMERIC = _lower(np.array([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def power(way: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base ("up") or of its inverse ("down"); n is at most a slice and one."""
    if way not in _powers:
        steps = np.full(SLICE + 1, BASE if way == "up" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[way] = np.cumprod(steps)
    return _powers[way][:n]


class Words(NamedTuple):
    """Words of the texts ``first .. first + len(offsets) - 2``: those of text i are at offsets[i]:offsets[i + 1]."""

    first: int
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # byte positions within the text
    ends: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 positions that divide them; null has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _hashed(raw: np.ndarray, edges: np.ndarray, alphabet: np.ndarray):
    """(hashes, starts, ends) of the words in at most a slice of bytes; no word crosses an edge."""
    low = alphabet[raw]
    inside = low != 0
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(raw) + 1, dtype=bool)
    after[:-1] = inside
    before[edges] = False
    after[edges] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_WEIGHT[low] * power("up", len(raw)), out=total[1:])
    return mix((total[ends] - total[starts]) * power("down", len(raw))[starts]), starts, ends


def _long_text(raw: np.ndarray, alphabet: np.ndarray):
    """The same for one text of any length: cut where no word is, a word of a whole slice by itself."""
    parts, at = [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        if end < len(raw):
            gaps = np.flatnonzero(alphabet[raw[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(raw) and alphabet[raw[end]] != 0:
                    more = np.flatnonzero(alphabet[raw[end : end + SLICE]] == 0)
                    end = end + int(more[0]) if len(more) else min(end + SLICE, len(raw))
        if end - at > SLICE:
            digest = hashlib.blake2b(alphabet[raw[at:end]].tobytes(), digest_size=8).digest()
            parts.append((np.frombuffer(digest, np.uint64), np.array([at]), np.array([end])))
        else:
            h, s, e = _hashed(raw[at:end], np.array([0, end - at]), alphabet)
            parts.append((h, s + at, e + at))
        at = end
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def words(texts: pa.Array, alphabet: np.ndarray):
    """Yield ``Words`` for runs of texts of at most a slice together; a longer text comes alone."""
    data, at = buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(at, at[i] + SLICE, side="right")) - 1
        j = min(max(j, i + 1), n)
        raw, edges = data[at[i] : at[j]], at[i : j + 1] - at[i]
        if len(raw) > SLICE:
            hashes, starts, ends = _long_text(raw, alphabet)
        else:
            hashes, starts, ends = _hashed(raw, edges, alphabet)
        offsets = np.searchsorted(starts, edges)
        shift = np.repeat(edges[:-1], np.diff(offsets))
        yield Words(i, offsets, hashes, starts - shift, ends - shift)
        i = j


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The distinct runs of ``size`` words of one text, sorted; a text of fewer words, but not none, is one run."""
    n = min(size, len(hashes))
    if n == 0:
        return np.zeros(0, np.uint64)
    count = len(hashes) - n + 1
    total = np.full(count, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        total = mix(total * BASE + hashes[k : k + count])
    return np.unique(total)
