"""Vectorised text helpers shared by the Arrow-batched operators.

A *chunk* is a run of whole documents laid end to end: ``data`` (uint8) holds their UTF-8 bytes and
``offs`` (int64, one more than there are documents) their borders. Null texts are empty documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, so few that their arrays stay in a core's cache; one longer document
#: still is a chunk of its own.
CHUNK_BYTES = 128 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, values = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, data, offs) for runs of rows of at most ``limit`` bytes, or one longer row."""
    if not batch.num_rows:
        return
    data, offs = binary_column(batch.column(batch.schema.get_field_index(text)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


@dataclass
class Words:
    """Words of a chunk in order: 64-bit hash, document index, and place in the chunk's bytes."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    lowered: np.ndarray

    def first_of_doc(self, n_docs: int) -> np.ndarray:
        """Index of each document's first word, with the number of all words at the end."""
        return np.searchsorted(self.doc, np.arange(n_docs + 1))


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Lower-case A-Z, cut at 0x20 and 0x09-0x0D and at document borders, hash each word."""
    low = _LOWER[data]
    solid = ~_SPACE[low]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    begin[inner] = solid[inner]
    start = np.flatnonzero(begin)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, z, low)
    letters = low[solid]
    rank = np.cumsum(solid)[start] - 1
    length = np.diff(rank, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(rank, length)
    powers = np.multiply.accumulate(np.full(int(length.max()), _BASE, np.uint64))
    h = np.add.reduceat(_BYTE_VALUE[letters] * powers[place], rank)
    doc = np.searchsorted(offs, start, "right") - 1
    return Words(mix(h + length.astype(np.uint64)), doc, start, length, low)


def ngrams(h: np.ndarray, doc: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of the word groups at ``gaps`` from each word that stay in one document."""
    last = max(gaps)
    n = len(h) - last
    if n <= 0:
        return h[:0], doc[:0]
    out = np.zeros(n, np.uint64)
    for g in gaps:
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[g : g + n]
    inside = doc[:n] == doc[last:]
    return mix(out + np.uint64(sum(gaps) * 31 + len(gaps)))[inside], doc[:n][inside]


def spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Strings at the given places of a chunk's bytes."""
    ends = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
    at = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[at])))


class HashIndex:
    """Positions of distinct 64-bit keys, by linear probing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for those that aren't there."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys) or not len(keys):
            return out
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slots[at]
        todo = np.flatnonzero(got >= 0)
        at, got = at[todo], got[todo]
        while len(todo):
            same = self.keys[got] == keys[todo]
            out[todo[same]] = got[same]
            todo, at = todo[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            todo, at, got = todo[got >= 0], at[got >= 0], got[got >= 0]
        return out
