"""Operator 3: language identification by rank-order profiles of n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import words as K
from .common import ship, stored
from .letters import GAP, alphabet, letters

#: Longest n-gram (of letters within words, fenced by gaps); n-grams of a profile.
LONGEST, PROFILE = 3, 400
#: Languages that are compared at once; more are compared in groups of so many.
GROUP = 1000
#: Bytes of text that a task looks at at a time; n-grams that it counts before it sends them.
SLICE, HELD = 256 << 10, 200_000
#: A packed n-gram holds a code point in each 21 bits.
_BITS = 21
#: What a document without letters gets.
UNKNOWN = "und"


class Grams:
    """All n-grams of some texts, as numbers that ascend with (length, code points)."""

    def __init__(self, texts: pa.Array):
        cp, self.off = letters(texts)
        self.alphabet = alphabet(cp)
        a = len(self.alphabet)
        if a:
            to = np.zeros(int(self.alphabet[-1]) + 1, np.int64)
            to[self.alphabet] = np.arange(a)
            code = to[cp]
        else:
            code = np.zeros(0, np.int64)
        gap = cp == GAP
        doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))
        grams, docs, base = [], [], 0
        for n in range(1, LONGEST + 1):
            m = len(cp) - n + 1
            if m > 0:
                g = np.zeros(m, np.int64)
                for j in range(n):
                    g = g * a + code[j : j + m]
                ok = doc[:m] == doc[n - 1 :]
                for j in range(n):  # gaps only fence; a gap alone is no n-gram
                    if n == 1 or 0 < j < n - 1:
                        ok &= ~gap[j : j + m]
                if n == 2:
                    ok &= ~(gap[:m] & gap[1:])
                grams.append(g[ok] + base)
                docs.append(doc[:m][ok])
            base += a**n
        self.size = base
        self.gram = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        docs = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        order = np.argsort(docs, kind="stable")
        self.gram = self.gram[order]
        self.first = np.searchsorted(docs[order], np.arange(len(self.off)))

    def pack(self, gram: np.ndarray) -> np.ndarray:
        """The same n-grams for any alphabet: code points in 21 bits each, ascending alike."""
        a, out, base = len(self.alphabet), np.zeros(len(gram), np.int64), 0
        for n in range(1, LONGEST + 1):
            own = (gram >= base) & (gram < base + a**n)
            g, packed = gram[own] - base, np.zeros(int(own.sum()), np.int64)
            for j in range(n):
                packed |= self.alphabet[g % a].astype(np.int64) << (_BITS * j)
                g //= a
            out[own] = packed
            base += a**n
        return out


def _learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language and n-gram, summed over slices while they are not too many."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    fresh: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def settle() -> None:
        for name, some in fresh.items():
            keys, counts = zip(*some, *([total[name]] if name in total else []), strict=True)
            both, back = np.unique(np.concatenate(keys), return_inverse=True)
            total[name] = both, np.bincount(back, np.concatenate(counts), len(both)).astype(np.int64)
        fresh.clear()

    def send() -> Iterator[pa.RecordBatch]:
        for name, (keys, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
        total.clear()

    held = 0
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            g = Grams(part.column("text"))
            lang = np.array(part.column("lang").to_pylist(), object)
            of = np.repeat(lang, np.diff(g.first))
            for name in set(lang):
                gram, n = np.unique(g.gram[of == name], return_counts=True)
                fresh.setdefault(name, []).append((g.pack(gram), n))
                held += len(gram)
            if held > HELD:
                settle()
                held = 0
                if sum(len(keys) for keys, _ in total.values()) > HELD:
                    yield from send()
    settle()
    yield from send()


def learn(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """Profiles (lang, gram, rank from 0) of the ``size`` most frequent n-grams.

    ``labelled`` has text and lang; every row counts.  Each task sums before anything
    is shuffled, so a language that holds most rows weighs no more than another.
    Ties go to shorter n-grams, then by code points.  Null langs and texts take no
    part, nor does a label that equals UNKNOWN.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UNKNOWN)).select("text", "lang")
    sums = rows.mapInArrow(_learner, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return sums.withColumn("rank", place - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs = sorted({r[0] for r in rows})
        self.gram = np.unique(np.array([r[1] for r in rows], np.int64))
        self.size = size
        of = {x: i for i, x in enumerate(self.langs)}
        #: rank by n-gram and language; an n-gram outside a profile is as far as can be
        self.rank = np.full((len(self.gram) + 1, len(self.langs)), 10 * size, np.int32)
        for lang, gram, rank in rows:
            self.rank[np.searchsorted(self.gram, gram), of[lang]] = rank

    def guess(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        g = Grams(texts)
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return out, score
        penalty = self.size
        for d in range(len(texts)):
            gram = g.gram[g.first[d] : g.first[d + 1]]
            if not len(gram):
                continue
            kinds, n = np.unique(gram, return_counts=True)
            top = kinds[np.argsort(-n, kind="stable")[: self.size]]
            packed = g.pack(top)
            at = np.minimum(np.searchsorted(self.gram, packed), len(self.gram) - 1)
            ranks = self.rank[np.where(self.gram[at] == packed, at, len(self.gram))]
            far = np.minimum(np.abs(ranks - np.arange(len(top))[:, None]), penalty).sum(0)
            best = int(np.argmin(far))
            out[d], score[d] = self.langs[best], 1 - far[best] / (penalty * len(top))
        return out, score


def _guesser(profiles, columns: list[str]):
    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = profiles.value
        for batch in batches:
            for part in K.slices(batch, "__text", SLICE):
                lang, score = p.guess(part.column(part.schema.get_field_index("__text")))
                kept = [part.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*columns, "lang_pred", "score"])

    return guess


def _guessed(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score after its columns."""
    spark = docs.sparkSession
    ship(spark)
    profiles = stored(profiles, "profiles")
    langs = [r["lang"] for r in profiles.select("lang").distinct().orderBy("lang").collect()]
    columns = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*columns)
    rows = rows.withColumn("__text", F.col(columns[docs.columns.index("text")]))
    types = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1]) + ", lang_pred string, score double"
    groups = [langs[i : i + GROUP] for i in range(0, len(langs), GROUP)] or [[]]
    if len(groups) == 1:
        p = spark.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.collect()], size))
        return rows.mapInArrow(_guesser(p, columns), types).toDF(*docs.columns, "lang_pred", "score")
    source, text = rows, columns[docs.columns.index("text")]
    for k, some in enumerate(groups):  # a pass for each group, keeping the nearest so far
        p = spark.sparkContext.broadcast(Profiles([tuple(r) for r in profiles.where(F.col("lang").isin(some)).collect()], size))
        names = source.columns[:-1]
        found = source.mapInArrow(_guesser(p, names), ", ".join(f"{c} {t}" for c, t in source.dtypes[:-1]) + ", lang_pred string, score double")
        if k:
            old = F.col("score_0") >= F.col("score")
            lang, score = F.when(old, F.col("lang_0")).otherwise(F.col("lang_pred")), F.greatest("score", "score_0")
        else:
            lang, score = F.col("lang_pred"), F.col("score")
        found = found.select(*columns, lang.alias("lang_0"), score.alias("score_0"))
        source = found.withColumn("__text", F.col(text))
    return found.toDF(*docs.columns, "lang_pred", "score")


def learned(doc_id: Column) -> Column:
    """Which documents profiles are learned from; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of each row of ``docs``.

    Learns from the labelled two thirds of ``docs`` that are not held out, then
    compares each whole text: its n-grams by falling frequency, each so far out of
    place as its rank differs from the profile's (as far as the profile is long where
    the profile lacks it).  The nearest language wins, ties go to the smaller name;
    the score is one less the distance as a share of the largest possible.

    Null texts and texts without letters: UNKNOWN, score 0; the same where nothing was
    learned.  A null doc_id is neither learned from nor held out.  Repeated rows give
    a row each; an empty table gives none.
    """
    profiles = learn(docs.where(learned(F.col("doc_id"))), size)
    rows = docs.select("doc_id", F.coalesce(~learned(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return _guessed(rows, profiles, size).drop("text")


def known(docs: DataFrame, size: int = PROFILE, least: float = 0.0) -> DataFrame:
    """``docs`` without the rows whose language can't be told; all columns kept.

    Those are rows without letters, and rows whose score is not above ``least``:
    at 0, texts none of whose n-grams is anywhere near its place in any profile.
    """
    profiles = learn(docs.where(learned(F.col("doc_id"))).select("text", "lang"), size)
    out = _guessed(docs, profiles, size)
    n = len(docs.columns)
    out = out.toDF(*[f"c{i}" for i in range(n)], "lang_pred", "score").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > least))
    return out.drop("lang_pred", "score").toDF(*docs.columns)
