"""Operator 9: exact Jaccard join of documents by adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bitset, words as K
from .common import release, ship, stored
from .components import components

#: Words of a shingle; two sets link at SHARE hundredths of their union.
SHINGLE, SHARE = 3, 90
#: Hash functions that are tried should two different sets get the same fingerprint.
SEEDS = 8
#: Longest extension of a prefix; what verifying a pair costs, in pairs looked at.
LONGEST, VERIFY = 4, 8
#: Counters of the frequency sketch, however large the input is, summed in CHUNKS pieces.
COUNTERS, CHUNKS = 1 << 20, 64
#: Documents that share a prefix token are first compared to one of them if they are
#: more than so many.
CROWD = 8
#: Bytes of text whose shingles a task holds at a time.
SLICE = 1 << 20

_SUMMARY = "chunk int, doc_id long, tag long, n long, fp long, fp2 long, blob binary"
_POSTING = "h long, fp long, n long, i long, ell long"
_SET = "fp long, words string"
_SALT = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class How:
    """Words of a shingle, hundredths of the union, and which hash function is used."""

    shingle: int = SHINGLE
    share: int = SHARE
    seed: int = 0


def shingles(texts: pa.Array, size: int = SHINGLE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets): the distinct shingles of each document, ascending.

    A document with words, but fewer than ``size``, has all of them as one shingle.
    """
    w = K.split(texts, K.SPACE, fold=True, seed=seed)
    n, doc = w.count, w.doc
    h = K.windows(w.hash, size)
    inside = np.flatnonzero(doc[: len(h)] == doc[size - 1 :]) if len(h) else np.zeros(0, np.int64)
    h, of = h[inside], doc[inside]
    for few in range(1, size):
        short = np.flatnonzero(n == few)
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(few):
                own = K.mix(own * np.uint64(K._STEP) + w.hash[w.first[short] + j] + _SALT)
            h, of = np.concatenate([h, own]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(n) + 1))


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
    return total[off[1:]] - total[off[:-1]]


def _prints(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A fingerprint of each set."""
    return _sums(K.mix(h + _SALT), off).view(np.int64)


def _summarise(how: How):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        names = ["chunk", "doc_id", "tag", "n", "fp", "fp2", "blob"]
        for batch in batches:
            for rows in K.slices(batch, "text", SLICE):
                h, off = shingles(rows.column("text"), how.shingle, how.seed)
                np.add.at(counters, (h & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                fp2 = _prints(*shingles(rows.column("text"), how.shingle, SEEDS + how.seed))  # by hashes of their own
                none = pa.nulls(rows.num_rows, pa.int32()), pa.nulls(rows.num_rows, pa.binary())
                columns = [none[0], rows.column("doc_id"), rows.column("tag"), pa.array(np.diff(off), pa.int64()), pa.array(_prints(h, off)), pa.array(fp2), none[1]]
                yield pa.RecordBatch.from_arrays(columns, names)
        for k, x in enumerate(counters.reshape(CHUNKS, -1)):
            if x.any():
                blob = x.astype("<i4" if x.max() < 1 << 31 else "<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(5)), pa.array([blob], pa.binary())], names)

    return summarise


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    size, total = COUNTERS // CHUNKS, np.zeros(COUNTERS // CHUNKS, np.int64)
    for b in pdf["blob"]:
        total += np.frombuffer(b, "<i4" if len(b) == 4 * size else "<i8")
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "blob": [total.astype("<i8").tobytes()]})


def _least(n: np.ndarray, share: int) -> np.ndarray:
    """Tokens that a set of n shares with any set it links to, at least."""
    return -(-share * n // 100)


def _poster(sketch, noise: int, how: How):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for rows in K.slices(batch, "text", SLICE):
                h, off = shingles(rows.column("text"), how.shingle, how.seed)
                n = np.diff(off)
                fp = _prints(h, off)
                _, one = np.unique(fp, return_index=True)  # copies are one set
                use = np.zeros(len(n), bool)
                use[one] = n[one] + 1 >= 100 / (100 - how.share)  # smaller sets link to equal ones alone
                doc = np.repeat(np.arange(len(n)), n)
                own = use[doc]
                h, doc = h[own], doc[own]
                if not len(h):
                    continue
                often = counts[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((h, often, doc))  # rarest first, the same order everywhere
                h, doc, often = h[order], doc[order], often[order]
                docs = np.flatnonzero(use)
                size = n[docs]
                off = np.concatenate([[0], np.cumsum(size)])
                others = np.concatenate([[0], np.cumsum(np.maximum(often - noise - 1, 0))])
                cost = np.empty((LONGEST, len(docs)))
                for ell in range(1, LONGEST + 1):
                    prefix = np.minimum(size - _least(size, how.share) + ell, size)
                    cost[ell - 1] = (others[off[:-1] + prefix] - others[off[:-1]]) * (1 + VERIFY / ell)
                ell = cost.argmin(0) + 1
                length = np.minimum(size - _least(size, how.share) + ell, size)
                at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                place = np.repeat(off[:-1], length) + at
                of = [np.repeat(x, length) for x in (fp[docs], size, ell)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[place].view(np.int64), of[0], of[1], at, of[2])], ["h", "fp", "n", "i", "ell"])

    return post


def _setter(wanted, how: How):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            for rows in K.slices(batch, "text", SLICE):
                texts = rows.column("text")
                h, off = shingles(texts, how.shingle, how.seed)
                fp = _prints(h, off)
                _, one = np.unique(fp, return_index=True)
                use = one[bitset.has(bits, fp[one]) & (np.diff(off)[one] > 0)]
                yield pa.RecordBatch.from_arrays([pa.array(fp[use]), texts.take(pa.array(use))], ["fp", "words"])

    return sets


def exact_shingles(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each document's distinct shingles as numbers, equal among ``texts`` for equal words alone."""
    seed, w = 0, K.split(texts, K.SPACE, fold=True)
    while True:
        _, one, number = np.unique(w.hash, return_index=True, return_inverse=True)
        length, like = w.end - w.start, one[number]
        if (length == length[like]).all() and K.same(w.data, w.start, w.data, w.start[like], length).all():
            break
        seed += 1  # two words of one hash: take another
        w = K.split(texts, K.SPACE, fold=True, seed=seed)
    n, total = w.count, len(w.hash)
    none = len(one)  # stands for a word beyond the end of a short document
    padded = np.concatenate([number.reshape(-1), np.full(size - 1, none)])
    doc = w.doc
    first = np.arange(total) if total else np.zeros(0, np.int64)
    left = w.first[doc + 1] - first
    begins = first[(left >= size) | (n[doc] < size) & (first == w.first[doc])]
    key = padded[begins]
    for j in range(1, size):
        word = np.where(left[begins] > j, padded[begins + j], none)
        _, key = np.unique(key.astype(np.int64) * (none + 1) + word, return_inverse=True)
    of = doc[begins]
    return [np.unique(x) for x in np.split(key, np.searchsorted(of, np.arange(1, len(n))))]


def _overlaps(how: How):
    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in "ab")
            sizes = [K.text_bytes(batch.column(f"words_{c}"))[1] for c in "ab"]
            both = np.diff(sizes[0]) + np.diff(sizes[1])
            upto = np.concatenate([[0], np.cumsum(both)])
            i, ok = 0, np.zeros(len(a), bool)
            while i < len(a):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] + SLICE, "right")) - 1)
                ids, one, at = np.unique(np.concatenate([a[i:j], b[i:j]]), return_index=True, return_inverse=True)
                texts = pa.concat_arrays([batch.column(f"words_{c}").slice(i, j - i) for c in "ab"]).take(pa.array(one))
                sets = exact_shingles(texts, how.shingle)
                at = at.reshape(-1)
                for k in range(j - i):
                    s, t = sets[at[k]], sets[at[j - i + k]]
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    ok[i + k] = 100 * shared >= how.share * (len(s) + len(t) - shared)
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return overlaps


class _Join:
    """The join of the distinct sets of ``docs`` (doc_id, tag, text)."""

    def __init__(self, docs: DataFrame, how: How):
        self.docs, self.how, self.spark = docs, how, docs.sparkSession
        self.summary = stored(docs.mapInArrow(_summarise(how), _SUMMARY), "near-summary")
        self.members = self.summary.where("chunk is null").select("doc_id", "tag", "n", "fp", "fp2")

    def ambiguous(self) -> bool:
        """Whether different sets got the same fingerprint: their second ones, of other hashes, differ."""
        return bool(self.members.groupBy("fp").agg((F.min("fp2") != F.max("fp2")).alias("odd")).where("odd").take(1))

    def postings(self) -> DataFrame:
        """Prefix tokens that two different sets have in their prefixes, with the sets."""
        sketch = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.int64)
        for r in self.summary.where("chunk is not null").select("chunk", "blob").groupBy("chunk").applyInPandas(_add, "chunk int, blob binary").collect():
            sketch[r["chunk"]] = np.frombuffer(r["blob"], np.int64)
        sketch = sketch.reshape(-1)
        noise = int(sketch.sum() // COUNTERS)
        send = self.spark.sparkContext.broadcast(sketch.astype(np.int32) if sketch.max() < 1 << 31 else sketch)
        every = stored(self.docs.select("text").mapInArrow(_poster(send, noise, self.how), _POSTING), "near-postings")
        shared = every.groupBy("h").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("h")
        out = every.join(shared, "h").groupBy("h", "fp").agg(*(F.max(c).alias(c) for c in ("n", "i", "ell")))
        out = stored(out, "near-shared")
        release(every)
        return out

    def pairs_with_one(self, posts: DataFrame) -> DataFrame:
        """Where many sets share a token: each with the set that has fewest rarer tokens."""
        pivot = posts.groupBy("h").agg(F.count("*").alias("many"), F.min(F.struct("i", "fp", "n")).alias("p")).where(F.col("many") > CROWD)
        pivot = pivot.select("h", F.col("p.fp").alias("b"), F.col("p.n").alias("n_b"), F.col("p.i").alias("i_b"))
        both = posts.join(pivot, "h").where((F.col("fp") != F.col("b")) & _possible(F.col("n"), F.col("i"), F.col("n_b"), F.col("i_b"), self.how.share))
        return self._counted(posts, both.select(F.col("fp").alias("a"), "b"))

    def pairs_across(self, posts: DataFrame, roots: DataFrame) -> DataFrame:
        """All pairs that are not connected yet and that share enough of their prefixes."""
        rows = posts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        rows = stored(rows, "near-rooted")
        token = rows.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.struct("i", "fp", "root")).alias("p")).where("r0 != r1")
        rows = rows.join(token.select("h", F.col("p.root").alias("main")), "h")

        def side(s: str) -> DataFrame:
            return rows.select("h", "main", *(F.col(c).alias(f"{c}_{s}") for c in ("fp", "n", "i", "root")))

        odd, all_ = side("a").where("root_a != main"), side("b").drop("main")
        once = (F.col("root_b") == F.col("main")) | (F.col("fp_a") < F.col("fp_b"))
        both = odd.join(all_, "h").where((F.col("root_a") != F.col("root_b")) & once & _possible(F.col("n_a"), F.col("i_a"), F.col("n_b"), F.col("i_b"), self.how.share))
        return self._counted(posts, both.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))

    def _counted(self, posts: DataFrame, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose prefixes share enough tokens for a link.

        At the smaller ell of the two, a set's prefix has n - least(n) + ell tokens.
        All that two sets share up to the end of the prefix that ends first is seen
        here, and no more than the rest of that set can follow.
        """
        ell = F.least("ell_a", "ell_b")

        def prefix(s: str) -> Column:
            n = F.col(f"n_{s}")
            return F.least(n - _least_col(n, self.how.share) + ell, n)

        def side(s: str) -> DataFrame:
            return posts.select("h", F.col("fp").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "i", "ell")))

        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        both = pairs.join(side("a"), "a").join(side("b"), ["b", "h"])
        seen = both.where((F.col("i_a") < prefix("a")) & (F.col("i_b") < prefix("b")))
        groups = seen.groupBy("a", "b").agg(F.count("*").alias("shared"), *(F.max(c).alias(c) for c in ("n_a", "n_b", "ell_a", "ell_b")))
        after = F.greatest(F.col("n_a") - prefix("a"), F.col("n_b") - prefix("b"))
        return groups.where((F.col("shared") >= ell) & (F.col("shared") + after >= _needed(F.col("n_a"), F.col("n_b"), self.how.share))).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose whole sets link."""
        pairs = stored(pairs, "near-pairs")
        wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        send = self.spark.sparkContext.broadcast(bitset.gather(wanted))
        sets = self.docs.select("text").mapInArrow(_setter(send, self.how), _SET).join(wanted, "fp", "left_semi").dropDuplicates(["fp"])
        sets = stored(sets, "near-sets")
        a, b = (sets.select(F.col("fp").alias(s), F.col("words").alias(f"words_{s}")) for s in "ab")
        # the side that most pairs share goes last, so that its text is not sent with each pair
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "words_a", "words_b")
        out = stored(both.mapInArrow(_overlaps(self.how), "a long, b long"), "near-links")
        release(sets, pairs)
        return out


def _needed(n: Column, m: Column, share: int) -> Column:
    """Tokens that sets of n and m share if they link."""
    return F.ceil(F.lit(share) * (n + m) / F.lit(100.0 + share))


def _least_col(n: Column, share: int) -> Column:
    return F.ceil(F.lit(share) * n / F.lit(100.0))


def _possible(n: Column, i: Column, m: Column, j: Column, share: int) -> Column:
    """Whether two sets may link whose first shared token stands at i and j.

    None of the rarer tokens before it is shared then.  Rows of later shared tokens
    may fail this, but that of the first never does if the sets link.
    """
    return F.least(n - i, m - j) >= _needed(n, m, share)


def groups(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs`` (doc_id, text).

    Two documents link when their sets of ``shingle``-word shingles share ``share``
    hundredths of their union.  Copies (equal sets) collapse by fingerprint first; a
    second fingerprint, of other hashes, tells whether different sets share one.  Tokens are ordered by a
    frequency sketch over all documents, rarest first; a set's prefix is so long that
    linked sets share at least ell tokens of theirs, and ell is chosen by each set's
    estimated cost.  Sets that share a prefix token with many others are compared to
    one of them first, and all sets that this connects need no comparison with each
    other; every other pair that shares enough is verified on its words.  No pair that
    might connect anything is left out.

    Null and empty texts, and texts of white space, have no shingles and are their own
    component.  Null ids are never a component's id unless it has no other.  Rows that
    repeat an id give a row each and are judged by their texts.
    """
    return _groups(docs, shingle, share).drop("tag")


def _tag() -> Column:
    """Tells rows of the same id apart by their texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _groups(docs: DataFrame, shingle: int, share: int) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag().alias("tag"), "text")
    for seed in range(SEEDS):
        join = _Join(rows, How(shingle, share, seed))
        if not join.ambiguous():
            break
        release(join.summary)
    else:
        raise RuntimeError("different sets share fingerprints under every hash function")
    posts = join.postings()
    near = join.verified(join.pairs_with_one(posts))
    roots = stored(components(near), "near-roots")
    far = join.verified(join.pairs_across(posts, roots))
    top = far.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    tops = components(top.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    tops = stored(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "near-tops")
    sets = join.members.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    sets = sets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sets = sets.join(tops, "root", "left").withColumn("top", F.coalesce("top", "root"))
    ids = sets.groupBy("top").agg(F.min("least").alias("component_id"))
    sets = stored(sets.join(ids, "top").select("fp", "component_id"), "near-components")
    release(posts, near, far, roots, tops)
    out = join.members.join(sets.withColumnRenamed("component_id", "of_set"), "fp", "left")
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("of_set")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id; all columns kept.

    Documents without words are groups of their own.  Documents without id go if
    their group has one with an id, else each different text of theirs stays.  Rows
    that repeat both id and text are one document.
    """
    kept = _groups(docs, shingle, share).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept_id"), F.col("tag").alias("kept_tag"))
    kept = stored(kept.groupBy("kept_id", "kept_tag").agg(F.count("*").alias("kept_times")), "near-kept")
    repeats = bool(kept.where("kept_times > 1").take(1))
    same = docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["kept_tag"])
    out = docs.join(kept, same, "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if repeats else out
