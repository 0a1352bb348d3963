"""Texts cut before white space into pieces that recur, found and hashed on their UTF-8 bytes."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from marginalia.llm import words as W

#: Longer pieces are hashed by themselves and are not worth remembering.
LONG = 256

_WEIGHT = W.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * W.BASE) | np.uint64(1)


def worker_state() -> dict:
    """What one Python worker keeps between its tasks; functions travel by value, so their globals do not last."""
    name = "marginalia_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def prefixed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, their edges) of runs of texts, a space before each text that is not empty.

    A run has at most a slice of bytes, but for a longer text, which comes alone. Null is empty.
    """
    data, at = W.buffers(texts)
    i, n = 0, len(texts)
    while i < n:
        j = int(np.searchsorted(at, at[i] + W.SLICE, side="right")) - 1
        j = min(max(j, i + 1), n)
        sizes = np.diff(at[i : j + 1])
        edges = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
        raw = np.full(edges[-1], 0x20, np.uint8)
        inside = np.ones(len(raw), bool)
        inside[edges[:-1][sizes > 0]] = False
        raw[inside] = data[at[i] : at[j]]
        yield i, raw, edges
        i = j


def after_white_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space, by Unicode."""
    a, b, c = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    blank = (a <= 0x20) | (a == 0x7F)
    blank |= (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    blank |= (c == 0xE1) & (b == 0x9A) & (a == 0x80)
    blank |= (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    blank |= (c == 0xE2) & (b == 0x81) & (a == 0x9F)
    return blank | ((c == 0xE3) & (b == 0x80) & (a == 0x80))


def cut(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of pieces: each text is cut before a space or line feed that does not follow white space."""
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    at = at[at > 0]
    at = at[~after_white_space(raw, at)]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    first[edges[:-1][np.diff(edges) > 0]] = True
    starts = np.flatnonzero(first)
    return starts, np.concatenate([starts[1:], [len(raw)]])[: len(starts)]


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece's bytes and length."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + W.SLICE, side="right")), i + 1)
        first = starts[i]
        if ends[j - 1] - first <= W.SLICE:
            total = np.zeros(ends[j - 1] - first + 1, np.uint64)
            np.cumsum(_WEIGHT[raw[first : ends[j - 1]]] * W.power("up", len(total) - 1), out=total[1:])
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = W.mix((total[b] - total[a]) * W.power("down", len(total))[a] + (b - a).astype(np.uint64))
        i = j
    for k in np.flatnonzero(ends - starts > LONG):
        digest = hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=8).digest()
        out[k] = np.frombuffer(digest, np.uint64)[0]
    return out


def spread(offsets: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``slots``, place) for every element that the slots' rows hold in a list divided by ``offsets``."""
    sizes = offsets[slots + 1] - offsets[slots]
    which = np.repeat(np.arange(len(slots)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[slots][which]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values
