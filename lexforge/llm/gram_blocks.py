"""Word 3-grams of a corpus in packed blocks: the model of :mod:`kneser_ney` and what texts cost under it.

No table of 3-grams is written.  A text's cost is a sum over its words: what a word costs
alone, what the word before adds, and what the two before add.  Each word goes packed with
the words beside it, dealt by word, to where its counts and those of the words that follow
it are, some at a time (``COUNT_PASSES``, ``COST_PASSES``: fixed numbers, by hash), so that
the disk that one pass takes is free before the next; each pass reads the texts again.
Three models are counted at once: of all trusted texts and of each half; a trusted text is
also scored by the model of the half that it is not in.

Words are told apart by their 64-bit hashes.  Within a block or a group each kind gets a
number, and n-grams of numbers are exact keys; what an n-gram costs is found once for each
kind, not for each place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as K
from .common import partitions, release, scratch_path, ship, stored

#: Parts of the trusted 3-grams, by a hash of the last word, that are counted one after the other.
COUNT_PASSES = 2
#: Parts of all words, by a hash of a word and the one before, that are looked up one after the other.
COST_PASSES = 6
#: Bytes of text whose n-grams a task packs at a time.
SLICE = 16 << 20
#: Bytes of text that a task cuts into words at a time.
PIECE = 3 << 20
#: Of all trusted texts, and of either half.
MODELS = 3

_BLOCK = "shard int, slice long, blob binary"
_COUNTED = "kind int, shard int, blob binary"
_SUMS = "slice long, shard int, blob binary"
_STEP = np.uint64(K._STEP)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as compressed bytes: lengths, types, then each array's bytes by place."""
    codec = pa.Codec("zstd", compression_level=1)
    head = np.array([[len(a), "uifb".index(a.dtype.kind), a.dtype.itemsize] for a in arrays], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    raw = b"".join([np.array([len(arrays)], np.int64).tobytes(), head.tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3), 8 + 24 * n, []
    for size, kind, width in head.tolist():
        planes = np.frombuffer(raw, np.uint8)[at : at + size * width].reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{'uifb'[kind]}{width}"))
        at += size * width
    return out


def _gaps(a: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, which take fewer bytes."""
    return np.diff(a, prepend=np.uint64(0))


def _small(a: np.ndarray) -> np.ndarray:
    most = int(a.max(initial=0))
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """In which of ``parts`` ranges each hash is."""
    return (h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _numbers(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the kinds of ``a``, the number of each row's kind), kinds by where they first are."""
    d = pc.dictionary_encode(pa.array(a), memory_pool=pa.system_memory_pool())  # its freed memory goes back to the system
    return d.dictionary.to_numpy(), d.indices.to_numpy()


def _in(a: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The number of each row's kind among ``kinds``, which are all different; -1 if it is none of them."""
    at = pc.index_in(pa.array(a), value_set=pa.array(kinds), memory_pool=pa.system_memory_pool())
    return at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _key(a: np.ndarray, kinds: int, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, the second of which is below ``kinds``."""
    return a.astype(np.int64) * kinds + b


def _join(arrays: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays]).astype(kind, copy=False)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where rows of sorted keys differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sum(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, at) if len(at) else x[:0]


class _Parts:
    """Slices of the texts of a task: number, words, and each document's role (-1, or the half it is in)."""

    def __init__(self, trusted: Callable, only_trusted: bool = False):
        self.trusted, self.only = trusted, only_trusted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            role = self.trusted(batch)
            if self.only:
                batch, role = batch.filter(pa.array(role >= 0)), role[role >= 0]
            at = 0
            for part in K.slices(batch, "text", SLICE):
                # the number says which rows these are, too: passes that cut slices apart would not meet
                mark = int(K.mix(part.column("key").to_numpy().view(np.uint64) + np.arange(part.num_rows, dtype=np.uint64)).sum() & np.uint64(0xFFFFFF)) if part.num_rows else 0
                yield (task << 44 | nth << 24) + mark, part, role[at : at + part.num_rows]
                at, nth = at + part.num_rows, nth + 1


def _pieces(part: pa.RecordBatch, hashes: bool = True) -> Iterator[tuple[int, K.Words]]:
    """(rows before, words) of the texts of a slice, some at a time."""
    at = 0
    for piece in K.slices(part, "text", PIECE):
        yield at, K.split(piece.column("text"), hashes=hashes)
        at += piece.num_rows


def _beside(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after each one in the same text; 0 where there is none."""
    before, after = np.zeros(len(w.hash), np.uint64), np.zeros(len(w.hash), np.uint64)
    before[1:], after[:-1] = w.hash[:-1], w.hash[1:]
    some = w.count > 0
    before[w.first[:-1][some]] = after[w.first[1:][some] - 1] = 0
    return before, after


def _dealt(number: int, shards: int, words: tuple[np.ndarray, ...], by: np.ndarray, mark: np.ndarray, ascends: bool = False) -> pa.RecordBatch:
    """A block for each shard: its kinds of words, the numbers of ``words`` among them, and ``mark`` (its steps, if it ascends)."""
    shard = _part_of(by, shards).astype(np.uint16 if shards < 1 << 16 else np.uint32)
    o = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[o], np.arange(shards + 1))
    words, mark, rows = [x[o] for x in words], mark[o], []
    for s in np.flatnonzero(np.diff(cut)).tolist():
        i = slice(cut[s], cut[s + 1])
        kinds, at = _numbers(np.concatenate([x[i] for x in words]))
        o = np.argsort(kinds)
        place = np.empty(len(o), np.int64)
        place[o] = np.arange(len(o))
        at = _small(place[at])
        rows.append((s, number, pack(_gaps(kinds[o]), *np.split(at, len(words)), _small(np.diff(mark[i], prepend=0) if ascends else mark[i]))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "slice", "blob"])


def _together(blobs: pa.ChunkedArray, n: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(kinds of words, the numbers of the ``n`` words of each row among them, the marks of each block)."""
    kinds, columns, marks, at = [], [[] for _ in range(n)], [], 0
    for b in blobs:
        own, *numbers, mark = unpack(b.as_py())
        kinds.append(np.cumsum(own))
        for c, x in zip(columns, numbers):
            c.append(x.astype(np.int32) + np.int32(at))
        marks.append(mark)
        at += len(own)
    kinds, of = _numbers(_join(kinds, np.uint64))
    return kinds, [of[_join(c, np.int32)] for c in columns], marks


def _to_count(trusted: Callable, nth: int, shards: int):
    parts = _Parts(trusted, True)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, role in parts(batches):
            found = []
            for at, w in _pieces(part):
                place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.count)
                own = np.flatnonzero(((w.hash >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(COUNT_PASSES) == nth) & (place >= 2))
                found.append((w.hash[own - 2], w.hash[own - 1], w.hash[own], role[at + w.doc[own]]))
            w1, w2, w3, half = (np.concatenate(x) for x in zip(*found))
            if len(w3):
                yield _dealt(number, shards, (w1, w2, w3), w3, half)

    return grams


def _counts_of(c: np.ndarray) -> list[int]:
    """How many there are, their sum, and how many are 1, 2, 3 and 4."""
    c = c[c > 0]
    return [len(c), int(c.sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4))]


def _count(shards: int):
    def count(table: pa.Table) -> pa.Table:
        hashes, (a1, a2, a3), half = _together(table.column("blob"), 3)
        half, kinds = np.concatenate(half), len(hashes)
        pairs, of = _numbers(_key(a3, kinds, a2))
        grams, of = _numbers(_key(of, kinds, a1))
        c = np.bincount(of, minlength=len(grams))
        of1 = np.bincount(of, half, len(grams)).astype(np.int64)
        counts = [c, c - of1, of1]
        before = [np.bincount(grams // kinds, x > 0, len(pairs)).astype(np.int64) for x in counts]
        w3, w2 = np.divmod(pairs, kinds)
        words = [np.bincount(w3, x > 0, kinds).astype(np.int64) for x in before]
        stats = np.array([_counts_of(x) for x in (*words, *before, *counts)], np.int64)
        order = np.argsort(hashes)
        place = np.empty(kinds, np.int64)
        place[order] = np.arange(kinds)
        last = order[words[0][order] > 0]
        own = int(table.column("shard")[0].as_py())
        out = [(0, own, pack(stats.reshape(-1))), (1, own, pack(_gaps(hashes[last]), *(_small(x[last]) for x in words)))]
        o = np.argsort(place[w2], kind="stable")
        w2, w3, before = place[w2[o]], place[w3[o]], [x[o] for x in before]
        hashes, words = hashes[order], [x[order] for x in words]
        cut = np.searchsorted(_part_of(hashes[w2], shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            i = slice(cut[s], cut[s + 1])
            at = _starts(w2[i])
            names, of = np.unique(w3[i], return_inverse=True)
            out.append((2, s, pack(_gaps(hashes[w2[i][at]]), _small(np.diff(np.append(at, cut[s + 1] - cut[s]))), _gaps(hashes[names]), _small(of), *(_small(x[i]) for x in before), *(_small(x[names]) for x in words))))
        return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["kind", "shard", "blob"])

    return count


class Law:
    """What counts lose and what that frees, of each order and model, from the sums of all shards."""

    def __init__(self, stats: np.ndarray):
        self.stats = stats.reshape(3, MODELS, 6)
        self.loses = [[self._discounts(x[2:].tolist()) for x in y] for y in self.stats]
        self.kinds = [float(self.stats[0, m, 0] + 1) for m in range(MODELS)]
        self.total = [float(self.stats[0, m, 1]) for m in range(MODELS)]
        self.freed = []
        for m in range(MODELS):
            kinds, _, *n = self.stats[0, m].tolist()
            most = [1.0, 2.0, 3.0, np.inf]
            d = self.loses[0][m]
            lost = sum(k * min(d[min(i, 2)], most[i]) for i, k in enumerate(n)) + (kinds - sum(n)) * d[2]
            self.freed.append(round(lost, 9) / self.total[m] if self.total[m] else 0.0)

    @staticmethod
    def _discounts(n: list[int]) -> tuple[float, float, float]:
        if not n[0] or not n[1]:
            return 0.5, 0.75, 0.9
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))

    def has(self, m: int) -> bool:
        return self.total[m] > 0

    def lose(self, order: int, m: int, c: np.ndarray) -> np.ndarray:
        return np.minimum(np.array([0.0, *self.loses[order - 1][m]])[np.minimum(c, 3)], c)

    def alone(self, m: int, c: np.ndarray) -> np.ndarray:
        """Probabilities of words with the counts ``c``, 0 for one that the model does not have."""
        return (c - self.lose(1, m, c)) / self.total[m] + self.freed[m] / self.kinds[m]

    def after(self, order: int, m: int, c: np.ndarray, of: np.ndarray, histories: int) -> tuple[np.ndarray, np.ndarray]:
        """(own share of each n-gram in its history, what each history frees, 0 for one without n-grams)."""
        lose = self.lose(order, m, c)
        total = np.bincount(of, c, histories)
        some = np.maximum(total, 1)
        return (c - lose) / some[of], np.round(np.bincount(of, lose, histories), 9) / some


def _logs(x: np.ndarray) -> np.ndarray:
    return np.log(x, out=np.zeros(len(x)), where=x > 0)


def _to_look_up(trusted: Callable, nth: int, shards: int):
    parts = _Parts(trusted)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, role in parts(batches):
            found = []
            for at, w in _pieces(part):
                before, after = _beside(w)
                own = np.flatnonzero(_part_of((w.hash ^ before * np.uint64(K._SEED)) * _STEP, COST_PASSES) == nth)
                found.append((before[own], w.hash[own], after[own], (at + w.doc[own]).astype(np.int32)))
            w1, w2, w3, doc = (np.concatenate(x) for x in zip(*found))
            if len(w2):
                yield _dealt(number, shards, (w1, w2, w3), w2, doc * 3 + role[doc].astype(np.int32) + 1, ascends=True)

    return words


class _Counted:
    """The counts of a shard: its words, and the pairs that begin with them."""

    def __init__(self, table: pa.Table):
        kind = table.column("kind").to_numpy()
        blobs = [[unpack(table.column("blob")[i].as_py()) for i in np.flatnonzero(kind == k).tolist()] for k in (1, 2)]
        self.word = _join([np.cumsum(t[0]) for t in blobs[0]], np.uint64)
        self.of_word = [_join([t[1 + m] for t in blobs[0]]) for m in range(MODELS)]
        #: first words, and of each pair the number of its first word, its last word, and its counts and those of its last word
        self.first, at = _numbers(_join([np.cumsum(t[0]) for t in blobs[1]], np.uint64))
        self.begins = np.repeat(at, _join([t[1] for t in blobs[1]]))
        self.last, at = _numbers(_join([np.cumsum(t[2]) for t in blobs[1]], np.uint64))
        off = np.cumsum([0, *(len(t[2]) for t in blobs[1])]).tolist()
        self.ends = at[_join([t[3].astype(np.int64) + k for t, k in zip(blobs[1], off)])]
        self.before = [_join([t[4 + m] for t in blobs[1]]) for m in range(MODELS)]
        self.of_last = [_join([t[7 + m][t[3]] for t in blobs[1]]) for m in range(MODELS)]


def _costs_of(law: Law, hashes: np.ndarray, a1: np.ndarray, a2: np.ndarray, a3: np.ndarray, role: np.ndarray, table: _Counted) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """(number of each row's 3-gram, what each 3-gram costs by each model)."""
    kinds = len(hashes)
    none = int(_in(np.zeros(1, np.uint64), hashes)[0])
    pairs, of = _numbers(_key(a2, kinds, a3))
    grams, row = _numbers(_key(of, kinds, a1))
    del of
    of, g1 = np.divmod(grams, kinds)
    p2, p3 = np.divmod(pairs, kinds)
    two, three = (p3 != none)[of], (p3 != none)[of] & (g1 != none)
    histories, h = _numbers(_key(p2[of], kinds, g1))
    seen = role >= 0
    c = np.bincount(row[seen], minlength=len(grams)) * three
    of1 = np.bincount(row[role == 1], minlength=len(grams)) * three
    counts = [c, c - of1, of1]
    known = np.flatnonzero(c)
    own = np.flatnonzero(np.bincount(p2, minlength=kinds))
    at = _in(hashes[own], table.word)
    begins, ends = _in(table.first, hashes)[table.begins], _in(table.last, hashes)[table.ends]
    some = np.flatnonzero((begins >= 0) & (ends >= 0))
    found = _in(pairs, _key(begins[some], kinds, ends[some]))
    in_table = np.flatnonzero(found >= 0)
    pair = some[found[in_table]]
    first = np.full(kinds, -1)
    first[own] = _in(hashes[own], table.first)
    out = []
    for m in range(MODELS):
        if not law.has(m):
            out.append(np.zeros(len(grams)))
            continue
        alone = np.zeros(kinds)
        alone[own] = np.log(law.alone(m, np.append(table.of_word[m], 0)[at]))
        share, freed = law.after(2, m, table.before[m], table.begins, len(table.first))
        e2 = np.append(_logs(freed), 0)[first[p2]]
        last = law.alone(m, table.of_last[m][pair])
        below = np.zeros(len(pairs))
        below[in_table] = share[pair] + freed[table.begins[pair]] * last
        has = table.before[m][pair] > 0
        e2[in_table[has]] = np.log(below[in_table[has]] / last[has])
        share, freed = law.after(3, m, counts[m][known], h[known], len(histories))
        e3 = _logs(freed)[h]
        has = counts[m][known] > 0
        g = known[has]
        e3[g] = np.log((share[has] + freed[h[g]] * below[of[g]]) / below[of[g]])
        out.append(alone[p2[of]] + np.where(two, e2[of], 0) + np.where(three, e3, 0))
    return row, out


def _costs(law):
    def cost(blocks: pa.Table, counted: pa.Table) -> pa.Table:
        hashes, words, marks = _together(blocks.column("blob"), 3)
        cut = np.cumsum([0, *map(len, marks)]).tolist()
        mark = _join([np.cumsum(x) for x in marks])
        role = mark % 3 - 1
        one, other = np.zeros(len(mark)), np.zeros(len(mark))
        if len(mark):
            row, by = _costs_of(law.value, hashes, *words, role, _Counted(counted))
            one = by[0][row]
            for half in (0, 1):  # by the model of the half that a text is not in
                at = np.flatnonzero(role == half)
                other[at] = by[2 - half][row[at]]
        blobs, shard = [], int(blocks.column("shard")[0].as_py()) if blocks.num_rows else 0
        for i, j in zip(cut, cut[1:]):  # documents ascend in a block
            doc = mark[i:j] // 3
            at = _starts(doc)
            blobs.append(pack(_small(doc[at]), _sum(one[i:j], at), _sum(other[i:j], at)))
        return pa.table([pa.array(blocks.column("slice").to_numpy(), pa.int64()), pa.array([shard] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "shard", "blob"])

    return cost


def _added(table: pa.Table) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """Of a slice: its number, its documents, and their sums, added in the order of shards."""
    docs, sums = [], [[], []]
    for k in np.argsort(table.column("shard").to_numpy(), kind="stable").tolist():
        doc, *cost = unpack(table.column("blob")[k].as_py())
        docs.append(doc.astype(np.int64))
        for s, c in zip(sums, cost):
            s.append(c)
    docs = np.concatenate(docs)
    kinds = np.flatnonzero(np.bincount(docs))
    return table.column("slice")[0].as_py(), kinds, [np.bincount(docs, np.concatenate(s))[kinds] for s in sums]


def _gather(table: pa.Table) -> pa.Table:
    """One row for a slice: its documents and sums."""
    number, docs, sums = _added(table)
    return pa.table([pa.array([number], pa.int64()), pa.array([0], pa.int32()), pa.array([pack(_small(docs), *sums)], pa.binary())], names=["slice", "shard", "blob"])


def _by_document(table: pa.Table) -> pa.Table:
    """A row for each document of a slice.

    Made where the sums are added: a second Python step in that stage would take a second worker for each core, which
    stays and keeps its memory.
    """
    number, docs, (one, other) = _added(table)
    return pa.table([pa.array(np.full(len(docs), number)), pa.array(docs.astype(np.int32)), pa.array(one), pa.array(other)], names=["slice", "nth", "logp", "other_logp"])


def _measured(trusted: Callable):
    parts = _Parts(trusted)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, role in parts(batches):
            chars = [len(" ".join(t.as_py().split())) if t.is_valid else 0 for t in part.column("text")]
            words = np.concatenate([w.count for _, w in _pieces(part, False)])
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), part.column("doc_id"), part.column("lang"), pa.array(role, pa.int32()), pa.array(chars, pa.int64()), pa.array(words, pa.int64())], ["slice", "nth", "doc_id", "lang", "half", "n_chars", "n_words"])

    return measured


@contextmanager
def _files_of_shuffles_go(spark: SparkSession):
    """Inside, what a job has shuffled goes when the job ends, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scores(rows: DataFrame, trusted: Callable) -> tuple[DataFrame, Law]:
    """doc_id, lang, half, n_chars, n_words, logp and other_logp of each row of ``rows``, and the law of the models.

    ``rows`` has doc_id, lang, text, key (long) and what ``trusted`` needs: a function
    of a batch that says which half of the trusted texts each is in, or -1.
    """
    spark = rows.sparkSession
    ship(spark)
    shards = partitions(spark)
    with _files_of_shuffles_go(spark):
        each = stored(rows.mapInArrow(_measured(trusted), "slice long, nth int, doc_id long, lang string, half int, n_chars long, n_words long"), "kn-texts")
        path = scratch_path(spark, "kn-counts")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        for nth in range(COUNT_PASSES):
            counted = rows.mapInArrow(_to_count(trusted, nth, shards), _BLOCK).groupBy("shard").applyInArrow(_count(shards), _COUNTED)
            counted.repartition(shards, "shard").write.mode("append").bucketBy(shards, "shard").option("path", path).option("compression", "none").saveAsTable(name)
        counts = spark.table(name)
        stats = np.zeros(3 * MODELS * 6, np.int64)
        for r in counts.where("kind = 0").select("blob").toLocalIterator():
            stats += unpack(bytes(r[0]))[0]
        law = Law(stats)
        sent = spark.sparkContext.broadcast(law)
        sums = []
        for nth in range(COST_PASSES if law.has(0) else 0):
            blocks = rows.mapInArrow(_to_look_up(trusted, nth, shards), _BLOCK)
            found = blocks.groupBy("shard").cogroup(counts.where("kind > 0").groupBy("shard")).applyInArrow(_costs(sent), _SUMS)
            sums.append(stored(found.groupBy("slice").applyInArrow(_gather, _SUMS), "kn-sums"))
        total = spark.createDataFrame([], "slice long, nth int, logp double, other_logp double")
        for k, s in enumerate(sums):
            part = s.withColumn("shard", F.lit(k))
            whole = part if k == 0 else whole.unionByName(part)
        if sums:
            total = whole.groupBy("slice").applyInArrow(_by_document, total.schema)
        out = each.join(total, ["slice", "nth"], "full")
        lost = F.col("n_words").isNull() | ((F.col("n_words") > 0) & F.col("logp").isNull() & F.lit(bool(sums)))
        logp = F.when(lost, F.raise_error(F.lit("the table of texts came in another order in another pass")).cast("double")).otherwise(F.coalesce("logp", F.lit(0.0)))
        out = stored(out.select("doc_id", "lang", "half", "n_chars", "n_words", logp.alias("logp"), F.coalesce("other_logp", F.lit(0.0)).alias("other_logp")), "kn-scores")
        counts._scratch, counts._table = path, name
        release(counts)
        release(each, *sums)
    return out, law
