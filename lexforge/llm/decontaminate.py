"""Operator 4: benchmark decontamination by a broadcast set of test n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as K
from .common import release, ship, stored

#: Words of a window; hit words of a document, as one in so many, that contaminate it.
WINDOW, ONE_IN = 13, 20
#: The n-grams of a benchmark are broadcast up to so many words of it (some 30 bytes a
#: word); a larger one is cut into blocks of that size, and documents pass each in turn.
BLOCK_WORDS = 1_000_000

_FOUND = "n_words long, n_hit long, hits binary, items array<string>"


class Grams:
    """Windows of benchmark items, by their exact words, packed into arrays.

    Words become numbers of a vocabulary of the benchmark's own words, so equal
    windows of numbers are equal windows of words: a hash of numbers finds a
    candidate, the numbers themselves verify it, and the bytes of its words verify these.
    Items without id have windows like others, but no name.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        names = sorted({i for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(names)}
        self.names = np.array(names, object)
        item = np.array([-1 if i is None else place[i] for i, _ in items], np.int32)
        texts = pa.array([t or "" for _, t in items], pa.string())
        self.seed = -1
        while True:  # a seed under which no two of these words share a hash
            self.seed += 1
            w = K.split(texts, K.SYMBOLS, fold=True, seed=self.seed)
            self.known, one, number = np.unique(w.hash, return_index=True, return_inverse=True)
            size, like = w.end - w.start, one[number.reshape(-1)]
            if (size == size[like]).all() and K.same(w.data, w.start, w.data, w.start[like], size).all():
                break
        self.number = number.reshape(-1).astype(np.int32)
        self.spelling, self.begin, self.size = w.data, w.start[one], size[one]
        n = w.count
        doc = w.doc
        left = w.first[doc + 1] - np.arange(len(doc))
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.minimum(n[n > 0], window)).tolist():
            at = np.flatnonzero((left >= k) & (np.minimum(n[doc], window) == k))
            h = _row_hash(np.lib.stride_tricks.sliding_window_view(self.number, k)[at])
            order = np.argsort(h, kind="stable")
            self.by_size[k] = h[order], at[order].astype(np.int32), item[doc[at[order]]]

    def scan(self, texts: pa.Array) -> tuple[K.Words, np.ndarray, dict[int, set[str]]]:
        """The words of the documents, which of them lie inside windows, and the items that own these, by document."""
        w = K.split(texts, K.SYMBOLS, fold=True, seed=self.seed)
        hit, items = np.zeros(len(w.hash), bool), {}
        if not len(self.known) or not len(w.hash):
            return w, hit, items
        at = np.minimum(np.searchsorted(self.known, w.hash), len(self.known) - 1)
        number = np.where(self.known[at] == w.hash, at, -1).astype(np.int32)
        alien = np.concatenate([[0], np.cumsum(number < 0)])
        doc = w.doc
        room = w.first[doc + 1] - np.arange(len(doc))
        for size, (hashes, place, owner) in self.by_size.items():
            n = len(doc) - size + 1
            if n <= 0:
                continue
            start = np.flatnonzero((alien[size:] == alien[:n]) & (room[:n] >= size))
            if not len(start):
                continue
            rows = np.lib.stride_tricks.sliding_window_view(number, size)
            r = _row_hash(rows[start])
            low, high = np.searchsorted(hashes, r), np.searchsorted(hashes, r, "right")
            many = high - low
            start, entry = np.repeat(start, many), np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            same = (rows[start] == np.lib.stride_tricks.sliding_window_view(self.number, size)[place[entry]]).all(1) if len(start) else np.zeros(0, bool)
            start, entry = start[same], entry[same]
            words = np.unique((np.unique(start)[:, None] + np.arange(size)).reshape(-1))
            wrong = words[~self._spelt(w, number, words)]
            if len(wrong):  # a word of another spelling under the hash of one of the benchmark's
                fine = np.searchsorted(wrong, start) == np.searchsorted(wrong, start + size)
                start, entry = start[fine], entry[fine]
            for j in range(size):
                hit[start + j] = True
            named = owner[entry] >= 0
            for d, i in set(zip(doc[start[named]].tolist(), owner[entry[named]].tolist(), strict=True)):
                items.setdefault(d, set()).add(self.names[i])
        return w, hit, items

    def _spelt(self, w: K.Words, number: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = w.end[j] - w.start[j]
        ok = size == self.size[number[j]]
        ok[ok] = K.same(w.data, w.start[j[ok]], self.spelling, self.begin[number[j[ok]]], size[ok])
        return ok


def _row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = K.mix(out * np.uint64(K._STEP) + rows[:, j].astype(np.uint64) + np.uint64(1))
    return out


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[str | None, str]], bool]]:
    """The benchmark's items in blocks of some BLOCK_WORDS words (or one item), and whether more follow."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text", size.alias("size"))
    rows, held = [], 0
    for r in items.toLocalIterator():
        if rows and held + r["size"] > BLOCK_WORDS:
            yield rows, True
            rows, held = [], 0
        rows.append((r["item_id"], r["text"]))
        held += r["size"]
    yield rows, False


def _scanner(grams, text: int, names: list[str], keep: list[int]):
    """Adds what a block of the benchmark hits to what earlier blocks did."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grams.value
        for batch in batches:
            for part in K.slices(batch, batch.schema.names[text]):
                w, hit, items = g.scan(part.column(text))
                if part.num_columns > len(names):  # hits and items so far
                    for d, (bits, old) in enumerate(zip(part.column(len(names) + 2).to_pylist(), part.column(len(names) + 3).to_pylist(), strict=True)):
                        a, b = w.first[d], w.first[d + 1]
                        hit[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                        if old:
                            items.setdefault(d, set()).update(old)
                upto = np.concatenate([[0], np.cumsum(hit)])[w.first]
                bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                found = [pa.array(w.count, pa.int64()), pa.array(np.diff(upto), pa.int64()), pa.array(bits, pa.binary()), pa.array([sorted(items.get(d, ())) for d in range(part.num_rows)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *found], [*(names[i] for i in keep), "n_words", "n_hit", "hits", "items"])

    return scan


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, keep: list[int]) -> DataFrame:
    """Columns ``keep`` of ``docs`` (as c0, c1 ...), n_words, n_hit, hits and items of every row."""
    spark = docs.sparkSession
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows, text, before = docs.toDF(*names), docs.columns.index("text"), None
    types = dict(zip(names, (t for _, t in docs.dtypes), strict=True))
    for items, more in _blocks(benchmark):
        out = list(range(len(names))) if more else keep
        schema = ", ".join([*(f"{names[i]} {types[names[i]]}" for i in out), _FOUND])
        rows = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(Grams(items, window)), text, names, out), schema)
        if more:  # a table for each block: nothing is shuffled, whatever the benchmark's size
            rows, old = stored(rows, "decontamination"), before
            before = rows
            release(*filter(None, [old]))
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Find the words of ``docs`` that lie inside windows of ``benchmark``.

    Words: A-Z lower-cased, then runs of digits, small letters and all beyond ASCII.
    A window is ``window`` consecutive words of an item, or the whole of a shorter
    item.  Returns doc_id, n_words, n_hit, hits (a bit per word) and items (ids as
    strings, sorted), one row per document.

    The windows are broadcast in blocks of bounded size; documents are never shuffled,
    and pass the blocks one after the other.

    Null text: no words, not hit.  Items without words take no part; windows of items
    without id hit like others, but name no item; items that repeat an id count as one
    item with all their windows.  Rows that repeat a document give a row each; an empty
    table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _scanned(rows, benchmark, window, [0]).withColumnRenamed("c0", "doc_id")


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.lit(ONE_IN) * F.col("n_hit") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns; without items the hash of an empty string."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated documents; all columns kept.

    Rows are judged as :func:`scan` judges them: null and empty texts stay.
    """
    names = docs.columns
    out = _scanned(docs, benchmark, window, list(range(len(names)))).where(~contaminated())
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
