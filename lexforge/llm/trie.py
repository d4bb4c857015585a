"""Compact tries of words over a small alphabet, as flat arrays, and their words at distance one of others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import words as K

#: Labels: a to z, then the code points from A0 below (two bytes in UTF-8) by their last six bits.
_FIRST_WIDE = 26
#: States of the automaton that are expanded at a time: exact ones branch.
_EXACT, _EDITED = 1 << 11, 1 << 17


def labels(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A label per code point of words of a-z and À-ÿ; n + 1 offsets."""
    data, off = K.text_bytes(words)
    lead = data == 0xC3
    before = np.concatenate([[0], np.cumsum(lead)])
    out = np.where(data >= 0x80, _FIRST_WIDE + (data & 0x3F), data - np.uint8(0x61)).astype(np.uint8)
    return out[~lead], off - before[off]


class Trie:
    """A trie in breadth-first order: the children of a node are neighbours, by label.

    Which labels a node has is a bitmap of two words; a child is found by counting bits.
    ``end`` is the word that ends at a node, as its place in the sorted words, or -1.
    """

    _ARRAYS = (("low", np.uint64), ("high", np.uint64), ("first", np.int32), ("end", np.int32), ("n", np.int64), ("off", np.int64), ("pool", np.uint8))

    @classmethod
    def build(cls, words: pa.Array, n: np.ndarray) -> Trie:
        """Of distinct words in ascending order of bytes."""
        out = cls()
        label, off = labels(words)
        size = np.diff(off)
        low, high, first, end = [], [], [], []
        active, node, made = np.arange(len(size)), np.zeros(len(size), np.int64), 1
        width, depth = 1, 0  # nodes of this level
        while width:
            ends, level = np.full(width, -1, np.int32), made - width
            done = size[active] == depth
            ends[node[done]] = active[done]
            active, node = active[~done], node[~done]
            x = label[off[active] + depth].astype(np.int64)
            key = node * 128 + x
            new = np.flatnonzero(np.diff(key, prepend=-1))
            parent, mark = node[new], x[new]
            count = np.bincount(parent, minlength=width)
            start = np.concatenate([[0], np.cumsum(count)[:-1]])
            a, b = np.zeros(width, np.uint64), np.zeros(width, np.uint64)
            if len(new):
                some = np.flatnonzero(count)
                one = np.uint64(1)
                a[some] = np.bitwise_or.reduceat(np.where(mark < 64, one << (mark & 63).astype(np.uint64), np.uint64(0)), start[some])
                b[some] = np.bitwise_or.reduceat(np.where(mark >= 64, one << (mark & 63).astype(np.uint64), np.uint64(0)), start[some])
            low.append(a), high.append(b), first.append((level + width + start).astype(np.int32)), end.append(ends)
            node = np.cumsum(np.diff(key, prepend=-1) != 0) - 1 if len(key) else node
            width, depth, made = len(new), depth + 1, made + len(new)
        out.low, out.high, out.first, out.end = map(np.concatenate, (low, high, first, end))
        out.pool, out.off = K.text_bytes(words)
        out.n = n.astype(np.int64)
        return out

    def pack(self) -> dict[str, bytes]:
        return {k: getattr(self, k).tobytes() for k, _ in self._ARRAYS}

    @classmethod
    def unpack(cls, held: dict[str, bytes]) -> Trie:
        out = cls()
        for k, kind in cls._ARRAYS:
            setattr(out, k, np.frombuffer(held[k], kind))
        return out

    def words(self, at: np.ndarray) -> pa.Array:
        size = self.off[at + 1] - self.off[at]
        ends = np.cumsum(size)
        take = np.repeat(self.off[at] - ends + size, size) + np.arange(size.sum())
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(self.pool[take].tobytes()))

    def _has(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.where(x < 64, self.low[v], self.high[v]) >> (x & np.uint8(63)).astype(np.uint64) & np.uint64(1) == 1

    def _child(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The child by a label that is there."""
        low, below = self.low[v], (np.uint64(1) << (x & np.uint8(63)).astype(np.uint64)) - np.uint64(1)
        rank = np.where(x < 64, np.bitwise_count(low & below), np.bitwise_count(low) + np.bitwise_count(self.high[v] & below))
        return self.first[v] + rank

    def near(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All (word of ``words``, word of the trie) that differ by exactly one edit, each once.

        The automaton reads the trie depth first.  An exact state (e = 0) has read what the
        word begins with; it spends the edit only on a letter that is not the word's next, so
        that an edit is found at one place alone.  Edited states follow the rest of the word.
        """
        label, off = labels(words)
        size = np.diff(off)
        label = np.concatenate([label, np.zeros(2, np.uint8)])  # read beyond the end, never used
        total = np.bitwise_count(self.low) + np.bitwise_count(self.high)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack: list[tuple[bool, np.ndarray, np.ndarray, np.ndarray]] = []

        def push(edited: bool, q: np.ndarray, v: np.ndarray, i: np.ndarray) -> None:
            most = _EDITED if edited else _EXACT
            stack.extend((edited, q[a : a + most], v[a : a + most], i[a : a + most]) for a in range(0, len(q), most))

        def edit(q: np.ndarray, v: np.ndarray, i: np.ndarray) -> None:
            """Edited states at nodes v whose next letter is the word's i-th: accept them, or keep those that can go on."""
            over = i == size[q]
            good = over & (self.end[v] >= 0)
            if good.any():
                found.append((q[good], self.end[v[good]]))
            more = ~over
            q, v, i = q[more], v[more], i[more]
            ok = self._has(v, label[off[q] + i])
            push(True, q[ok], v[ok], i[ok])

        push(False, np.arange(len(size)), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64))
        while stack:
            edited, q, v, i = stack.pop()
            x, room = label[off[q] + i], size[q] - i
            if edited:  # the letter is known to be there
                edit(q, self._child(v, x), i + 1)
                continue
            last = (room == 1) & (self.end[v] >= 0)
            if last.any():  # without its last letter
                found.append((q[last], self.end[v[last]]))
            y = label[off[q] + i + 1]
            ok = (room > 1) & (x != y)
            ok[ok] = self._has(v[ok], y[ok])  # without this letter
            edit(q[ok], self._child(v[ok], y[ok]), i[ok] + 2)
            go = room > 0
            go[go] = self._has(v[go], x[go])
            same = np.full(len(q), -1, np.int64)
            same[go] = self._child(v[go], x[go])
            push(False, q[go], same[go], i[go] + 1)
            many = total[v].astype(np.int64)
            row = np.repeat(np.arange(len(q)), many)
            kid = np.repeat(self.first[v] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            other = kid != same[row]
            row, kid = row[other], kid[other]
            edit(q[row], kid, i[row])  # one letter more
            row, kid = row[room[row] > 0], kid[room[row] > 0]
            edit(q[row], kid, i[row] + 1)  # another letter
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)
