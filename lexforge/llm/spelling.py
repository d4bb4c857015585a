"""Operator 12: groups of spelling variants, by words at distance one in broadcast shards of a trie."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import scan
from . import words as K
from .common import partitions, release, ship, stored
from .trie import Trie

#: Least code points and occurrences of a word; times that a form is more frequent than a word.
LEAST, OFTEN, TIMES = 5, 3, 2
#: One in so many (document, word) loses a letter.
ONE_IN = 97
#: Words of a shard: some 100 bytes each when broadcast.
SHARD = 1 << 18
#: Bytes of text that are cut at a time; words up to so many bytes have tables for their hashes.
SLICE, SHORT = 4 << 20, 64

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC3] = True


def _crc_step() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_STEP = _crc_step()


def _shifts() -> np.ndarray:
    """[size, k, b]: the register (b << 8 k) after so many zero bytes; crc32 is linear."""
    now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [now]
    for _ in range(SHORT):
        now = _STEP[now & 255] ^ now >> 8
        out.append(now)
    return np.stack(out)


_SHIFT = _shifts()


def _registers(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 registers of short spans, from a register of zero."""
    out = np.zeros(len(start), np.uint32)
    on = np.arange(len(start))
    for j in range(int(size.max(initial=0))):
        on = on[size[on] > j]
        out[on] = _STEP[(out[on] ^ data[start[on] + j]) & 255] ^ out[on] >> 8
    return out


def runs(texts: pa.Array) -> K.Words:
    """Maximal runs of A-Z, a-z and À-ÿ; A-Z lower-cased.  These À-ÿ are the bytes C3 and one more."""
    raw, off = K.text_bytes(texts)
    inside = _LETTER[raw]
    inside[1:] |= raw[:-1] == 0xC3
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1 : len(raw)]
    ends[:-1] &= ~inside[1:] | edge[1 : len(raw)]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    data = K.LOWER[raw]
    return K.Words(data, start, end, np.searchsorted(start, off), None)


def _distinct(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct word, number of the word at each place)."""
    seed = 0
    while True:  # a seed under which no two of these words share a hash
        _, one, number = np.unique(K.span_hashes(w.data, w.start, w.end, seed), return_index=True, return_inverse=True)
        number = number.reshape(-1)
        size, like = w.end - w.start, one[number]
        if (size == size[like]).all() and K.same(w.data, w.start, w.data, w.start[like], size).all():
            return one, number
        seed += 1


def _strings(w: K.Words, at: np.ndarray) -> pa.Array:
    size = w.end[at] - w.start[at]
    ends = np.cumsum(size)
    take = np.repeat(w.start[at] - ends + size, size) + np.arange(size.sum())
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(w.data[take].tobytes()))


def counts(names: list[str], texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words, how often) in texts of documents of these names; some words have lost a letter, as their hash says."""
    w = runs(texts)
    one, number = _distinct(w)
    size, doc = w.end - w.start, w.doc
    begun = np.array([zlib.crc32(f"{x}:".encode()) ^ 0xFFFFFFFF for x in names], np.uint32)[doc]
    short = size <= SHORT
    own = np.zeros(len(one), np.uint32)
    few = short[one]
    own[few] = _registers(w.data, w.start[one[few]], size[one[few]])
    s = np.minimum(size, SHORT)
    h = _SHIFT[s, 0, begun & 255] ^ _SHIFT[s, 1, begun >> 8 & 255] ^ _SHIFT[s, 2, begun >> 16 & 255] ^ _SHIFT[s, 3, begun >> 24] ^ own[number] ^ np.uint32(0xFFFFFFFF)
    for j in np.flatnonzero(~short):
        h[j] = zlib.crc32(w.data[w.start[j] : w.end[j]].tobytes(), int(begun[j]) ^ 0xFFFFFFFF)
    lost = np.flatnonzero(h % ONE_IN == 0)
    n = np.bincount(number, minlength=len(one)) - np.bincount(number[lost], minlength=len(one))
    changed: dict[str, int] = {}
    for j, k in zip(lost.tolist(), h[lost].tolist(), strict=True):
        x = w.data[w.start[j] : w.end[j]].tobytes().decode()
        k %= len(x)
        if len(x) > LEAST:
            x = x[:k] + x[k + 1 :]
            changed[x] = changed.get(x, 0) + 1
    wide = np.concatenate([[0], np.cumsum(w.data == 0xC3)])
    points = size[one] - (wide[w.end[one]] - wide[w.start[one]])
    keep = (n > 0) & (points >= LEAST)
    return pa.concat_arrays([_strings(w, one[keep]), pa.array(list(changed), pa.string())]), np.concatenate([n[keep], np.fromiter(changed.values(), np.int64, len(changed))])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in K.slices(batch, "text", SLICE):
            words, n = counts(rows.column("name").to_pylist(), rows.column("text"))
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of whole texts that are long and frequent enough."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text").where("text IS NOT NULL")
    return rows.mapInArrow(_counter, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {OFTEN}")


def _builder(group: pa.Table) -> pa.Table:
    """One shard: a trie of a range of the sorted words."""
    rows = group.sort_by("place").combine_chunks()
    packed = Trie.build(rows.column("word").combine_chunks(), rows.column("n").to_numpy()).pack()
    return pa.table({"shard": rows.column("shard")[:1], **{k: pa.array([v], pa.binary()) for k, v in packed.items()}})


def shards(words: DataFrame, size: int = SHARD) -> DataFrame:
    """Tries of ``size`` words each: ranges of the words in order of their bytes."""
    ranged = words.repartitionByRange(partitions(words.sparkSession), "word").sortWithinPartitions("word")
    ranged = stored(ranged.withColumn("uid", F.monotonically_increasing_id()), "spelling-order")
    part, i = F.shiftright("uid", 33).cast("int"), F.col("uid").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("part")).first()[0] or 0
    moved = scan.before(sizes, [], "part", ["n"], top).select("part", F.col("before_n").alias("moved"))
    placed = ranged.select("word", "n", part.alias("part"), i.alias("i")).join(moved, "part").select("word", "n", (F.col("i") + F.col("moved")).alias("place"))
    placed = placed.withColumn("shard", F.floor(F.col("place") / size).cast("long"))
    packed = ", ".join(f"{k} binary" for k, _ in Trie._ARRAYS)
    return stored(placed.groupBy("shard").applyInArrow(_builder, f"shard long, {packed}"), "spelling-tries")


def _finder(trie):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Trie.unpack(trie.value)
        for batch in batches:
            words = batch.column("word")
            q, x = t.near(words)
            order = np.lexsort((x, -t.n[x], q))
            q, x = q[order], x[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(q[first])), pa.array(np.diff(np.append(first, len(q)))), pa.array(t.n[x[first]]), t.words(x[first])], ["word", "n_near", "form_n", "form"]
            )

    return find


def near(words: DataFrame, size: int = SHARD) -> DataFrame:
    """(word, n_near, form_n, form): how many words are near each word, and the most frequent of them.

    A shard at a time is broadcast, and meets all words; what it finds is summed up by word
    before the next.  Words without near words have no row.
    """
    spark = words.sparkSession
    tries, found = shards(words, size), []
    for r in tries.select("shard").orderBy("shard").toLocalIterator():
        held = tries.where(F.col("shard") == r["shard"]).first().asDict()
        shard = spark.sparkContext.broadcast({k: bytes(held[k]) for k, _ in Trie._ARRAYS})
        found.append(stored(words.select("word").mapInArrow(_finder(shard), "word string, n_near long, form_n long, form string"), "spelling-near"))
        shard.destroy()
    release(tries)
    if not found:
        return spark.createDataFrame([], "word string, n_near long, form_n long, form string")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, in steps that double."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while not now.where("open").isEmpty():
        step = now.select(F.col("word").alias("at"), F.col("root").alias("to"))
        old, now = now, stored(now.join(step, now["root"] == step["at"], "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("open")), "spelling-roots")
        release(old)
    return now.select("word", "root")


def variants(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """Groups words of whole texts with the forms of which they are variants.

    ``docs`` has doc_id and text.  Words are runs of letters (A-Z lower-cased, and À-ÿ); some
    occurrences have lost a letter, chosen by a hash of document and word.  Two words of at
    least LEAST code points and OFTEN occurrences are near if one code point inserted,
    deleted or replaced makes one the other.  A word's form is its most frequent near word
    (ties: least in code point order) if that is at least TIMES as frequent; its root is
    the last form reached.

    Returns word, form, root, n, n_near and form_n.  Null texts have no words; a null id is
    an empty name; repeated rows count as often as they are there; without words there are no rows.
    """
    words = stored(vocabulary(docs), "spelling-words")
    found = near(words, size).select(F.col("word").alias("near_word"), "n_near", "form_n", "form")
    good = F.col("form_n") >= TIMES * F.col("n")
    rows = words.join(found, words["word"] == found["near_word"], "left")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form_n")).alias("form_n"), F.when(good, F.col("form")).alias("form")), "spelling-forms")
    last = roots(rows.where("form IS NOT NULL")).select(F.col("word").alias("root_word"), "root")
    return rows.join(last, rows["word"] == last["root_word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
