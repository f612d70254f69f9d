"""Vectorised hashing of words and word shingles over the buffers of Arrow text columns.

A text never becomes Python strings here: words are found on the UTF-8 bytes (the separators are ASCII), each
word gets a 64-bit polynomial hash from a prefix sum, and shingles fold the hashes of neighbouring words.
Working memory is a few blocks of `BLOCK` bytes beside 16 bytes per word, whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
PRIME = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out)


POW = _powers(PRIME, 2 * BLOCK)
INV = _powers(pow(PRIME, -1, 1 << 64), 2 * BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the input reaches every bit of the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the number of words) of maximal runs of bytes that are no separators."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~space[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _long_word(seg: np.ndarray) -> int:
    h = 0
    for a in range(0, len(seg), BLOCK):
        part = (seg[a : a + BLOCK].astype(U) + U(1)) * POW[: len(seg[a : a + BLOCK])]
        h = (h + int(part.sum(dtype=U)) * pow(PRIME, a, 1 << 64)) & MASK
    return h


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word's bytes after `table` (A-Z in lower case by default)."""
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(ends, starts[a] + 2 * BLOCK, "right"))
        if b <= a:
            out[a] = _long_word(table[buf[starts[a] : ends[a]]])
            a += 1
            continue
        b = min(b, max(a + 1, int(np.searchsorted(starts, starts[a] + BLOCK))))
        s0 = starts[a]
        seg = (table[buf[s0 : ends[b - 1]]].astype(U) + U(1)) * POW[: ends[b - 1] - s0]
        c = np.empty(len(seg) + 1, U)
        c[0] = 0
        np.cumsum(seg, out=c[1:])
        out[a:b] = (c[ends[a:b] - s0] - c[starts[a:b] - s0]) * INV[starts[a:b] - s0]
        a = b
    return mix(out + U(len(table)))


def fold(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k neighbouring words, also those that cross texts (slice them away)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    acc = words[:n] * U(3) + U(k)
    for i in range(1, k):
        acc = mix(acc) * U(5) + words[i : n + i]
    return mix(acc)


def whole(words: np.ndarray) -> int:
    """The hash of a text of fewer words than a shingle has."""
    h = len(words)
    for w in words.tolist():
        h = ((h ^ w) * PRIME + 0x1234567) & MASK
        h ^= h >> 29
    return h


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text, one array after the other; none for texts without a word."""
    buf, offs = text_buffers(column)
    starts, ends, first = word_spans(buf, offs)
    h = word_hashes(buf, starts, ends)
    f = fold(h, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(f[a : b - k + 1])
        elif b > a:
            yield np.array([whole(h[a:b])], U)
        else:
            yield np.zeros(0, U)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Parts of a batch with about `most` bytes of text each, one row at least."""
    n = batch.num_rows
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
    a, total = 0, 0
    for i in range(n):
        if i > a and total + sizes[i] > most:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += int(sizes[i])
    if n > a:
        yield batch.slice(a, n - a)
    pa.default_memory_pool().release_unused()  # workers live on between stages; what a batch needed goes back
