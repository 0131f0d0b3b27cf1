"""Vectorised byte and word work on blocks of documents inside Arrow tasks.

A block is a bounded slice of one Arrow batch: the documents' UTF-8 bytes laid
end to end, their offsets, and their ids. A block never exceeds ``limit``
bytes unless a single document does, so memory follows the block, not the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
#: Odd multiplier of the polynomial fingerprint and the seed of the byte table.
BASE = 0x9E3779B97F4A7C15
TABLE_SEED = 20240229


def byte_table() -> np.ndarray:
    return np.random.default_rng(TABLE_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit fingerprint over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Fingerprints:
    """Constant-time polynomial fingerprints (mod 2^64) of any byte range of a block."""

    def __init__(self) -> None:
        self.table = byte_table()
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n + 1:
            size = max(n + 1, 1 << 16)
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 2**64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((prefix[end] - prefix[start]) * self.inverse[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Fingerprint of the ``k`` bytes from every position that has them."""
        n = len(prefix) - 1
        return mix64((prefix[k:] - prefix[: n + 1 - k]) * self.inverse[: n + 1 - k]) if n >= k else np.empty(0, np.uint64)


def text_arrays(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # several chunks stay when empty
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if column.type in (pa.large_string(), pa.large_binary()) else np.int32
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES,
           text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) slices of at most ``limit`` bytes (a longer document stands alone)."""
    for batch in batches:
        data, offsets = text_arrays(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each document) of the runs ``[^\\x20\\x09-\\x0D]+``."""
    n = len(data)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    solid = ~SPACES[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length) laid end to end."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def word_prints(prints: Fingerprints, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of each lower-case word, start, end, words before each document)."""
    start, end, first = words(data, offsets)
    return prints.of(prints.prefix(lower_ascii(data)), start, end), start, end, first


def shingles(word: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, document) of every run of ``k`` words; a shorter document has one run of all its words."""
    n = np.diff(first)
    powers = [pow(BASE, j, 2**64) for j in range(k)]
    doc = np.repeat(np.arange(len(n)), n)
    acc = np.zeros(len(word), np.uint64)
    for j in range(k):
        if j < len(word):
            part = word[j:] * np.uint64(powers[j])
            acc[: len(word) - j] += np.where(doc[j:] == doc[: len(word) - j], part, np.uint64(0))
    at = np.arange(len(word)) - first[doc]
    keep = (at + k <= n[doc]) | (at == 0)
    return mix64(acc[keep]), doc[keep]
