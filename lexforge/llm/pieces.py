"""Encoding of texts by a tokenizers library, one distinct piece of text at a time.

A text is cut where the tokenizer provably cuts too, and what the library gives for a
piece is kept; so frequent words are encoded once per worker and not once per place.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np

from . import words as K

#: Pieces that a worker remembers, and bytes of them; beyond either, it starts anew.
REMEMBERED, REMEMBERED_BYTES = 800_000, 32 << 20


class PieceCache:
    """Token ids by piece.  Pieces are found by a hash and told apart by their bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.text_start, self.text_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 18, np.uint8), 0

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For each piece, where ``self.start`` and ``self.size`` have its ids (until the next call)."""
        if len(self.start) > self.most or self.text_used > REMEMBERED_BYTES:
            self.clear()
        size = end - start
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        found = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), bool)
        place = np.full(len(unique), -1, np.int64)
        place[found] = self.place[at[found]]
        known = found.copy()
        known[found] = self._is(place[found], data, start[first[found]], size[first[found]])
        new = np.flatnonzero(~known)
        if len(new):
            place[new] = self._add(data, start[first[new]], size[first[new]])
            fresh = new[~found[new]]  # a piece whose hash another one holds is not found again, but encoded anew
            where = np.searchsorted(self.keys, unique[fresh])
            self.place = np.insert(self.place, where, place[fresh])
            self.keys = np.insert(self.keys, where, unique[fresh])
        out = place[back]
        odd = np.flatnonzero(~self._is(out, data, start, size))  # an equal hash in this very call
        if len(odd):
            out[odd] = self._add(data, start[odd], size[odd])
        return out

    def _is(self, place: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        ok = self.text_size[place] == size
        ok[ok] = K.same(data, start[ok], self.text[: self.text_used], self.text_start[place[ok]], size[ok])
        return ok

    def _add(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encode pieces and remember what they are; returns their places."""
        raw = [data[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
        ids = self.encode([x.decode("utf-8", "replace") for x in raw])
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(n.sum()))
        self.ids = _room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(n) - n])
        self.size = np.concatenate([self.size, n])
        self.used += len(flat)
        text = np.frombuffer(b"".join(raw), np.uint8)
        self.text = _room(self.text, self.text_used + len(text))
        self.text[self.text_used : self.text_used + len(text)] = text
        self.text_start = np.concatenate([self.text_start, self.text_used + np.cumsum(size) - size])
        self.text_size = np.concatenate([self.text_size, size])
        self.text_used += len(text)
        return np.arange(len(self.start) - len(raw), len(self.start))

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other."""
        size = self.size[places].astype(np.int64)
        total = np.cumsum(size)
        if not len(total) or not total[-1]:
            return np.zeros(0, np.uint32)
        return self.ids[np.arange(total[-1]) + np.repeat(self.start[places] - (total - size), size)]


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def tiles(off: np.ndarray, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): pieces that tile all texts, each a run of white space and a word.

    White space at the end of a text is a piece of its own.
    """
    end = np.unique(np.concatenate([word_end, off[1:]]))
    end = end[end > 0]
    start = np.concatenate([np.zeros(1, np.int64), end[:-1]]) if len(end) else end
    return start, end, np.searchsorted(end, off, "right")


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoding as the library does it, a list of texts at a time."""
    tok = library(path)

    def encode(texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [e.ids for e in tok.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    return encode


_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
# The steps of a tokenizer for which a word of Latin letters is lower-cased,
# one pre-token, and spelt in byte letters; a full stop or comma after it is another one.
_LOWER_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


@lru_cache(maxsize=4)
def lowers(path: str) -> bool:
    """Whether a tokenizer has _LOWER_STEPS, and no added token that is a word with a stop."""
    steps = json.loads(Path(path).read_text(encoding="utf-8"))
    return {k: steps.get(k) for k in _LOWER_STEPS} == _LOWER_STEPS and all("<" in t["content"] for t in steps["added_tokens"])


def split_lower(texts, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, first): the words of texts as pieces whose ids, one after the other, are the text's.

    For tokenizers that :func:`lowers`, words of ASCII without "<" (which begins the added
    tokens) are lower-cased here, and a full stop or comma after a letter or digit is a
    piece of its own: both are steps of the tokenizer, and so fewer pieces are new.
    """
    w = K.split(texts, hashes=False)
    if not lowers(path) or not len(w.start):
        return w.data, w.start, w.end, w.first
    data, start, end = w.data, w.start, w.end
    odd = np.concatenate([[0], np.cumsum((data >= 0x80) | (data == 0x3C))])
    plain = odd[end] == odd[start]
    step = np.zeros(len(data) + 1, np.int8)
    step[start[~plain]] += 1
    step[end[~plain]] -= 1  # words don't touch
    data = np.where(np.cumsum(step[:-1]) > 0, data, K.LOWER[data])
    before = data[np.maximum(end - 2, 0)]
    stop = (data[end - 1] == 0x2E) | (data[end - 1] == 0x2C)
    cut = plain & stop & (end - start > 1) & ((before >= 0x61) & (before <= 0x7A) | (before >= 0x30) & (before <= 0x39))
    more = np.cumsum(cut)
    at = np.arange(len(start)) + more - cut
    out_start, out_end = np.empty(len(start) + int(cut.sum()), np.int64), np.empty(len(start) + int(cut.sum()), np.int64)
    out_start[at], out_end[at] = start, end - cut
    out_start[at[cut] + 1], out_end[at[cut] + 1] = end[cut] - 1, end[cut]
    return data, out_start, out_end, w.first + np.concatenate([[0], more])[w.first]


def lower_words(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Like :func:`plain`, with a short way for tokenizers that :func:`lowers`.

    Words of Latin letters, with a full stop or comma at most, go to the library's
    merge model directly, which skips its per-text bookkeeping: those steps do nothing
    else to them, and no added token is made of such characters alone.  Anything else,
    and every text of another tokenizer, takes the whole library.
    """
    tok, whole = library(path), plain(path)
    if not lowers(path):
        return whole
    merge = tok.model.tokenize
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}

    def short(m: re.Match) -> list[int]:
        word, stop = m[1].lower(), m[2]
        if not word.isascii():
            word = "".join(letter[b] for b in word.encode())
        ids = [t.id for t in merge(word)]
        return ids + [t.id for t in merge(stop)] if stop else ids

    def encode(texts: list[str]) -> list[list[int]]:
        found = [_SIMPLE.fullmatch(t) for t in texts]
        out = [short(m) if m else None for m in found]
        rest = [i for i, m in enumerate(found) if not m]
        for i, ids in zip(rest, whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    return encode
