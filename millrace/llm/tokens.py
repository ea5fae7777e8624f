"""Vectorised words and word hashes of a whole Arrow column, for code that runs inside Spark tasks.

Words are the runs between ASCII white space (space, \\t \\n \\v \\f \\r). Texts are taken as UTF-8 bytes, nulls as empty.
Hashes are sums of per-byte random values times powers of an odd number modulo 2**64, so one cumulative
sum over a stretch of text gives the hash of every word in it; mix() then scatters the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Texts are handled in slices of about so many bytes, and their words in stretches of SEGMENT bytes.
SLICE, SEGMENT = 2 << 20, 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit integers."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


BYTE = mix(np.arange(1, 257, dtype=U) * BASE)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(max(n, SEGMENT * 2), b)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Words(NamedTuple):
    data: np.ndarray  # the bytes of all texts, one after the other
    offsets: np.ndarray  # where each text starts in data; its length is the number of texts + 1
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # the first word of each text; its length is the number of texts + 1

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def column_bytes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and where each starts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return LOWER[data] if lower else data, offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    data, offsets = column_bytes(texts, lower)
    solid = np.concatenate([[False], ~space[data], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | cut))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | cut))
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(w.start), U)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(w.end, w.start[i] + SEGMENT)))
        at, to = w.start[i], w.end[j - 1]
        up, down = powers(int(to - at) + 1)
        total = np.zeros(int(to - at) + 1, U)
        np.cumsum(BYTE[w.data[at:to]] * up[:-1], out=total[1:])
        s, e = w.start[i:j] - at, w.end[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


def windows(h: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """A hash of each k consecutive entries of h (those that run over a text's end are to be left out by the caller)."""
    n = max(0, len(h) - k + 1)
    weight = mix(np.arange(1, k + 1, dtype=U) * U(2 * salt + 1)) | U(1)
    out = np.zeros(n, U)
    for j in range(k):
        out += h[j : j + n] * weight[j]
    return mix(out)


def whole(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n windows of k words lie within one text."""
    ok = np.ones(max(0, n - k + 1), bool)
    for e in range(1, k):
        at = first[1:-1] - e
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """batch in pieces of about SLICE bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE, "right")))
        yield batch.slice(i, j - i)
        i = j


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """An Arrow list column with the given number of values in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
