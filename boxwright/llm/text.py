"""Vectorised words, hashes and shingles over Arrow string columns.

A word is a maximal run of characters other than ``[\\x20\\x09-\\x0D]``. Every helper works on a
whole column at a time with numpy: no Python object is made per word. Null texts count as empty.
Hashes are 64-bit, seeded by fixed constants, and equal on every executor and in every run.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
_LONG = 64  # words of more bytes are hashed one by one


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def coefficients(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def release() -> None:
    """Gives memory back to the system at the end of a task, as idle Python workers stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def column(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.Array:
    """One column as a single string array without nulls (null: empty)."""
    x = batch.column(name)
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks() if x.num_chunks != 1 else x.chunk(0)
    if not pa.types.is_large_string(x.type):
        x = x.cast(pa.large_string())
    return x.fill_null("") if x.null_count else x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``size`` bytes each: what bounds the memory of the numpy steps."""
    if not len(texts):
        return
    _, offsets = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, texts.slice(first, last - first)
        first = last


class Words:
    """The words of a string column: byte spans, hashes, and the first word of each text."""

    def __init__(self, texts: pa.Array, space: np.ndarray = _SPACE, lower: bool = False):
        self.data, self.offsets = buffers(texts)
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        inside = ~space[data] if len(data) else np.zeros(0, bool)
        self.inside = inside
        first = inside.copy()
        last = inside.copy()
        if len(inside):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edges = self.offsets[1:-1]
            edges = edges[(edges > 0) & (edges < len(inside))]
            first[edges] = inside[edges]  # a word does not go on in the next text
            last[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words bounds[i]:bounds[i+1] are text i's
        self.bytes = data

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def eight(self) -> np.ndarray:
        """A view of the eight bytes from each byte on, past the end zero."""
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        return np.ndarray((len(self.bytes) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def hashes(self, limit: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word; limit: of its first bytes only (at most 8)."""
        size = self.ends - self.starts
        if limit is not None:
            size = np.minimum(size, limit)
        if not len(size):
            return np.zeros(0, U64)
        eight = self.eight()
        with np.errstate(over="ignore"):
            h = mix((eight[self.starts] & _MASK[np.minimum(size, 8)]) + size.astype(U64) * U64(0x9E3779B97F4A7C15))
            rest = np.flatnonzero((size > 8) & (size <= _LONG))
            at = 8
            while len(rest):
                left = np.minimum(size[rest] - at, 8)
                h[rest] = mix((h[rest] * U64(0xD6E8FEB86659FD93)) ^ (eight[self.starts[rest] + at] & _MASK[left]))
                at += 8
                rest = rest[size[rest] > at]
        for i in np.flatnonzero(size > _LONG):
            h[i] = int.from_bytes(hashlib.blake2b(self.bytes[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return h


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive entries of h; entry i covers h[i:i+k]. Shorter input: none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = coefficients(k, seed + k)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += h[j : j + n] * c[j]
        return mix(out)


def window_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which a window of k words of one text starts, in order."""
    n = np.maximum(np.diff(bounds) - k + 1, 0)
    total = int(n.sum())
    base = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)
    return np.arange(total) + base


class Shingles:
    """Distinct k-word shingles of each text, sorted within the text.

    A text of fewer than k words has one shingle, of all its words (the empty text too), so equal
    short texts share it and texts never come without any.
    """

    def __init__(self, words: Words, k: int = 5, seed: int = 0):
        h, bounds = words.hashes(), words.bounds
        starts = window_starts(bounds, k)
        values = windows(h, k, seed)[starts] if len(starts) else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(bounds) - 1), np.maximum(np.diff(bounds) - k + 1, 0))
        short = np.flatnonzero(words.counts < k)
        if len(short):
            extra = np.zeros(len(short), U64)
            c = coefficients(k, seed + 7919)
            with np.errstate(over="ignore"):
                for j in range(k - 1):
                    have = words.counts[short] > j
                    extra[have] += h[bounds[short[have]] + j] * c[j]
                extra = mix(extra + (words.counts[short].astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
            values, owner = np.concatenate([values, extra]), np.concatenate([owner, short])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        self.all, self.all_owner = values, owner
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[keep], owner[keep]
        self.bounds = np.searchsorted(self.owner, np.arange(len(bounds)))
        self.weights = np.diff(np.append(np.flatnonzero(keep), len(values)))
