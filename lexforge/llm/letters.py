"""Texts as numpy arrays of lower-cased letters, words fenced by one boundary mark."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Code point that stands for whatever lies between words.
GAP = 0x5F


@lru_cache(maxsize=1)
def _letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, n + 1 offsets): each non-empty text is GAP word GAP word GAP.

    Null texts and texts without letters are empty.
    """
    low = [(t or "").lower() for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    off = np.concatenate([[0], np.cumsum(sizes)])
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return cp, np.zeros(len(low) + 1, np.int64)
    is_letter = _letter()[cp]
    first = np.zeros(len(cp), bool)
    first[off[:-1][sizes > 0]] = True
    opens = is_letter.copy()  # a letter that begins a word
    opens[1:] &= ~is_letter[:-1] | first[1:]
    doc = np.repeat(np.arange(len(low)), sizes)
    # a word of k letters takes k + 1 places, and a text with words one more
    some = np.bincount(doc[is_letter], minlength=len(low)) > 0
    n = np.bincount(doc[is_letter], minlength=len(low)) + np.bincount(doc[opens], minlength=len(low)) + some
    out_off = np.concatenate([[0], np.cumsum(n)])
    out = np.full(out_off[-1], GAP, np.uint32)
    nth = np.arange(int(is_letter.sum())) + np.cumsum(opens[is_letter])  # letters and gaps before
    docs_before = np.cumsum(some)[doc[is_letter]] - 1  # closing gaps of earlier texts
    out[nth + docs_before] = cp[is_letter]
    return out, out_off


def alphabet(cp: np.ndarray) -> np.ndarray:
    """The distinct code points, ascending."""
    return np.flatnonzero(np.bincount(cp, minlength=1)).astype(np.uint32) if len(cp) else np.zeros(0, np.uint32)
