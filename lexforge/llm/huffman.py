"""Canonical length-limited Huffman codes over integer symbols, in numpy."""

from __future__ import annotations

import numpy as np

#: Longest code; more symbols than fit get as many bits as they need.
MAX_BITS = 16
#: Symbols between two checkpoints.
BLOCK = 512


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for unused symbols."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    bits = max(max_bits, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        kinds.append(rank < n)
    length, most = np.zeros(n, np.int64), 2 * n - 2
    for kind in reversed(kinds):  # how many leaves the cheapest ``most`` coins of each level hold
        single = int(kind[:most].sum())
        length[:single] += 1
        most = 2 * (most - single)
    out[order] = length
    return out


class Code:
    """Canonical codes of the given lengths, with a table for decoding."""

    def __init__(self, lengths: np.ndarray):
        self.length = lengths.astype(np.int64)
        self.bits = int(self.length.max(initial=1))
        symbols = np.flatnonzero(self.length)
        symbols = symbols[np.argsort(self.length[symbols], kind="stable")]
        step = np.int64(1) << (self.bits - self.length[symbols])
        first = np.cumsum(step) - step
        self.code = np.zeros(len(lengths), np.uint32)
        self.code[symbols] = first >> (self.bits - self.length[symbols])
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        filled = np.repeat(symbols, step)
        self.symbol[: len(filled)] = filled
        self.step = self.length[self.symbol]

    def encode(self, ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
        """(bits, checkpoints): the codes of ids, and the bit at which each block begins."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        size = self.length[ids]
        total = np.cumsum(size)
        at = total - size
        value = self.code[ids].astype(np.uint64) << (np.uint64(40) - size.astype(np.uint64) - (at & 7).astype(np.uint64))
        byte, n = at >> 3, int(total[-1] + 7) // 8
        out = np.zeros(n + 5)
        for j in range(5 if self.bits > 25 else 4 if self.bits > 17 else 3):
            out += np.bincount(byte + j, ((value >> np.uint64(32 - 8 * j)) & np.uint64(255)).astype(np.float64), n + 5)
        return out[:n].astype(np.uint8).tobytes(), at[::block]

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
        """The n ids again.  All blocks advance together, a table look-up for each id."""
        if not n:
            return np.zeros(0, np.uint32)
        b = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint64)
        window = (b[:-4] << np.uint64(32)) | (b[1:-3] << np.uint64(24)) | (b[2:-2] << np.uint64(16)) | (b[3:-1] << np.uint64(8)) | b[4:]
        at, k = checkpoints.astype(np.int64), len(checkpoints)
        out = np.zeros((block, k), np.uint32)
        mask, shift, last = np.uint64((1 << self.bits) - 1), 40 - self.bits, n - (k - 1) * block
        for i in range(min(block, n)):
            if i == last:  # the last block is shorter
                at = at[:-1]
                if not len(at):
                    break
            x = (window[at >> 3] >> (shift - (at & 7)).astype(np.uint64)) & mask
            out[i, : len(at)] = self.symbol[x]
            at = at + self.step[x]
        return out.T.reshape(-1)[:n]
