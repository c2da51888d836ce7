"""Words of many texts at once as numpy arrays, for code inside Arrow tasks.

Texts are handled as UTF-8 bytes in slices of bounded size, so a task's memory
follows the slice, not the batch; a text longer than a slice is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ROLL = np.uint64(0xA0761D6478BD642F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number made to depend on all others."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


with np.errstate(over="ignore"):
    BYTE_CODES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)


@dataclass
class Slice:
    """Consecutive texts: their bytes and the place where each begins and ends."""
    first: int
    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    @property
    def n(self) -> int:
        return len(self.begins)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(per_byte, dtype=np.int64)))
        return total[self.ends] - total[self.begins]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of one Arrow column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        edges = bounds[at:to + 1] - bounds[at]
        yield Slice(at, data[bounds[at]:bounds[to]], edges[:-1], edges[1:])
        at = to


@dataclass
class Words:
    """Words of a slice: byte range, text they belong to, 64-bit hash."""
    starts: np.ndarray
    stops: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    per_text: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Where each text's words begin."""
        return np.concatenate(([0], np.cumsum(self.per_text)[:-1])).astype(np.int64)


def spans(part: Slice, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs of bytes that ``apart`` doesn't hold."""
    n = len(part.data)
    inside = ~apart[part.data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[part.begins[part.begins < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[part.ends[part.ends > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


_powers = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the hash's base and of its inverse, up to the n-th at least."""
    global _powers
    if _powers.shape[1] <= n:
        _powers = np.empty((2, max(n + 1, 2 * SLICE_BYTES)), np.uint64)
        _powers[0], _powers[1] = _BASE, _BASE_INVERSE
        _powers[:, 0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(_powers, axis=1, out=_powers)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial hash of each byte range, from running sums over stretches of bounded length."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(stops, low + SLICE_BYTES, "right")))
            n = int(stops[to - 1] - low)
            up, down = powers(n)
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODES[data[low:low + n]] * up[:n], out=run[1:])
            a, b = starts[at:to] - low, stops[at:to] - low
            out[at:to] = mixed((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64) * _STEP)
            at = to
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and for every key the number of its like."""
    which, found = pd.factorize(keys)
    example = np.empty(len(found), np.int64)
    example[which] = np.arange(len(which))
    order = np.argsort(found)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return found[order], example[order], rank[which]


def words(part: Slice, apart: np.ndarray = WHITE) -> Words:
    starts, stops = spans(part, apart)
    text = np.searchsorted(part.ends, starts, "right")
    return Words(starts, stops, text, span_hashes(part.data, starts, stops),
                 np.bincount(text, minlength=part.n).astype(np.int64))


def grams(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of n words of one text, and the place of its first word."""
    have = len(found.hash) - n + 1
    if have <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        code = np.zeros(have, np.uint64)
        for k in range(n):
            code = code * _ROLL + found.hash[k:k + have]
        whole = np.flatnonzero(found.text[:have] == found.text[n - 1:])
        return mixed(code[whole]), whole
