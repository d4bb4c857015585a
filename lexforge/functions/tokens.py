"""Sizes of texts in tokens: the byte estimate by default, or a tokenizer of the tokenizers library."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from ..session import ship
from . import text as T

#: Tokens of a byte, as estimate_tokens counts them.
A_BYTE = 0.7


class Estimate:
    """Tokens by the length in bytes; all of it runs inside Spark."""

    def of(self, c: Column) -> Column:
        """Tokens of a text."""
        return T.estimate_tokens(c)

    def of_each(self, c: Column) -> Column:
        """Tokens of each text of an array."""
        return F.transform(c, T.estimate_tokens)

    def size(self, text: str) -> int:
        n = len(text.encode("utf-8", "surrogatepass"))
        return max(int(n * A_BYTE), 1) if n else 0

    def weights(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each word where a part begins with it, and where it follows another."""
        n = np.fromiter((len(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        return n, n + 1

    def room(self, most: int) -> int:
        """Bytes of the longest text of ``most`` tokens."""
        n = int((most + 1) / A_BYTE) + 1
        while int(n * A_BYTE) > most:
            n -= 1
        return n

    def pieces(self, text: str, most: int) -> list[str]:
        """A text without words to cut at, by characters."""
        n = max(1, int(len(text) * most / max(self.size(text), 1)))
        return [text[i : i + n] for i in range(0, len(text), n)]


class Library:
    """Tokens of a tokenizer file; for tokenizers that cut before the blank in front of a word."""

    def __init__(self, path: str):
        self.path = path

    def of(self, c: Column) -> Column:
        ship()
        path = self.path

        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            return pd.Series(_counts(path, [t or "" for t in texts]))

        return count(c)

    def of_each(self, c: Column) -> Column:
        ship()
        path = self.path

        @F.pandas_udf("array<long>")
        def count(rows: pd.Series) -> pd.Series:
            n = _counts(path, [t or "" for r in rows if r is not None for t in r])
            ends = np.cumsum([0 if r is None else len(r) for r in rows])
            return pd.Series([None if r is None else n[e - len(r) : e] for r, e in zip(rows, ends, strict=True)])

        return count(c)

    def size(self, text: str) -> int:
        return _counts(self.path, [text])[0]

    def weights(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone, after = _counts(self.path, words), _counts(self.path, [" " + w for w in words])
        return np.array(alone, np.int64), np.array(after, np.int64)

    def room(self, most: int) -> int:
        return most

    def pieces(self, text: str, most: int) -> list[str]:
        tok = _open(self.path)
        ids = tok.encode(text, add_special_tokens=False).ids
        return [tok.decode(ids[i : i + most], skip_special_tokens=False) for i in range(0, len(ids), most)]


@lru_cache(maxsize=4)
def _open(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _counts(path: str, texts: list[str]) -> list[int]:
    tok, out = _open(path), []
    for i in range(0, len(texts), 1024):
        out += [len(e.ids) for e in tok.encode_batch(texts[i : i + 1024], add_special_tokens=False)]
    return out


ESTIMATE = Estimate()
