"""Words of Arrow string columns as numpy arrays, without a Python object per word.

Separators are ASCII bytes, so words can be cut from UTF-8 bytes as they lie in the
Arrow buffer.  Every word gets a 64-bit hash that depends on its bytes alone.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes between words: white space of ASCII.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All of ASCII but digits and small letters.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[:0x80] = True
SYMBOLS[0x30:0x3A] = False
SYMBOLS[0x61:0x7B] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes beyond which a word is hashed by the standard library instead of lane by lane.
_LONG = 1024
_STEP = 0xD6E8FEB86659FD93
_SEED = 0x9E3779B97F4A7C15
#: Keeps the first 0 to 8 bytes of a little-endian lane.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _give_back() -> None:
    """Let large freed arrays go back to the system, so that reused workers stay small."""
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError, TypeError):
        pass  # another C library


_give_back()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """``first[d]:first[d + 1]`` are the words of document d."""

    data: np.ndarray  # bytes of all documents, folded if asked for
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def split(texts: pa.Array, separators: np.ndarray = SPACE, fold: bool = False, hashes: bool = True, seed: int = 0) -> Words:
    """Maximal runs of bytes that are no separators; never across documents."""
    raw, off = text_bytes(texts)
    n = len(raw)
    data = LOWER[raw] if fold else raw
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64), np.zeros(0, np.uint64) if hashes else None)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    return Words(data, start, end, first, span_hashes(data, start, end, seed) if hashes else None)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number; zeros follow the end."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", wide, strides=(1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Eight bytes at a time go through a bijection of the state, so spans of equal length
    that differ in one such lane alone never collide, and others do by chance alone:
    there is no sum of powers whose structure a text could meet.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(_STEP) + np.uint64((seed + 1) * _SEED & (1 << 64) - 1))
    if not len(out):
        return out
    lanes, left = _lanes(data), size.copy()
    long = np.flatnonzero(size > _LONG)
    left[long] = 0
    active, at, k = None, start, left
    while True:
        x = lanes[at] & _FIRST[np.minimum(k, 8)]
        if active is None:
            out = mix(out ^ x)
        else:
            out[active] = mix(out[active] * np.uint64(_STEP) ^ x)
        more = np.flatnonzero(k > 8)
        if not len(more):
            break
        active, at, k = more if active is None else active[more], at[more] + 8, k[more] - 8
    for i in long:
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def same(data: np.ndarray, start: np.ndarray, other: np.ndarray, other_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of the given sizes hold the same bytes."""
    out = np.ones(len(start), bool)
    if not len(out):
        return out
    a, b = _lanes(data), _lanes(other)
    long = np.flatnonzero(size > _LONG)
    active = np.flatnonzero(size <= _LONG)
    x, y, k = start[active], other_start[active], size[active]
    while len(active):
        out[active] &= (a[x] ^ b[y]) & _FIRST[np.minimum(k, 8)] == 0
        more = np.flatnonzero(k > 8)
        active, x, y, k = active[more], x[more] + 8, y[more] + 8, k[more] - 8
    for i in long:
        out[i] = data[start[i] : start[i] + size[i]].tobytes() == other[other_start[i] : other_start[i] + size[i]].tobytes()
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by where it starts (length n - k + 1).

    Windows are doubled, so k words cost log k passes; each pass mixes.
    """
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, size, base = None, 0, 1, h
    while True:
        if k & size:
            if out is None:
                out, have = base, size
            else:  # base covers size words, then out covers have words
                n = len(h) - size - have + 1
                out = mix(base[:n] * np.uint64(_STEP) + out[size : size + n])
                have += size
        if have == k:
            return out if k > 1 else mix(out)
        n = len(h) - 2 * size + 1
        base = mix(base[:n] * np.uint64(_STEP) + base[size : size + n])
        size *= 2


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``most`` bytes together, or one row."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
