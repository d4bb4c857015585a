"""Operator 1: quality by perplexity under an interpolated modified Kneser-Ney model.

The model is one of words.  Its n-grams grow with the corpus, so it never goes to the
driver: a document's n-grams meet the model in joins dealt by n-gram, and what they
cost is summed by document.  A word is its 64-bit hash, an n-gram the 8 n bytes of its
words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import bitset, gram_blocks, words as K
from .common import release, ship, stored

#: Words of the longest n-gram.
ORDER = 3
#: Share of the trusted texts of a language that its threshold lets pass.
QUANTILE = 0.99
#: Rows of an order of a model that joins broadcast; a larger one is dealt by n-gram.
BROADCAST_ROWS = 10_000
#: Parts of the trusted texts; each is scored by a model of the others for thresholds.
FOLDS = 2
#: Steps of a unit of log perplexity that thresholds are counted in.
STEPS = 2000
#: Bytes of text that a task looks at at a time.
SLICE = 1 << 20

_SCORED = "doc_id long, lang string, key long, n_chars long, n_words long"


def _grams_of(w: K.Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the ``order`` words that end at each word, how many of them its text has)."""
    n = len(w.hash)
    room = np.arange(n) - np.repeat(w.first[:-1], w.count)
    grams = np.zeros((n, order), np.uint64)
    for j in range(min(order, n)):
        grams[j:, order - 1 - j] = w.hash[: n - j]
    size = np.minimum(room + 1, order)
    grams[np.arange(order)[None, :] < order - size[:, None]] = 0
    return grams, size


def _distinct(grams: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, count) of each kind of row of ``grams``, told apart by ``of`` too."""
    h = K.mix(of.astype(np.uint64))
    for j in range(grams.shape[1]):
        h = K.mix(h * np.uint64(K._STEP) + grams[:, j])
    _, first, n = np.unique(h, return_index=True, return_counts=True)
    return first, n


def _binary(grams: np.ndarray, size: np.ndarray) -> pa.Array:
    """The last ``size`` hashes of each row as bytes."""
    order = grams.shape[1]
    own = np.arange(order)[None, :] >= order - size[:, None]
    off = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(grams[own].astype("<u8").tobytes())])


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", SLICE):
                grams, size = _grams_of(K.split(part.column("text")), order)
                grams = grams[size == order]
                first, n = _distinct(grams, np.zeros(len(grams), np.uint64))
                yield pa.RecordBatch.from_arrays([_binary(grams[first], np.full(len(first), order)), pa.array(n, pa.int64())], ["gram", "c"])

    return count


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What counts of 1, 2 and more lose, from how many n-grams have counts of 1 to 4."""
    r = counts.agg(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n = [float(x) for x in r]
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def train(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """The model of the texts of ``trusted``: n, gram, logp and backoff, a row per n-gram.

    Counts are summed in each task, then by n-gram; lower orders count the distinct
    words that stand before an n-gram.  An n-gram's probability is its discounted
    share among those of its history plus what the discounts free there, spread as
    the next lower order has it; each order is two joins of count tables, dealt by
    n-gram.  ``backoff`` is the log of what a history frees (0 where it is none);
    that of the empty n-gram is the log probability of a word that no trusted text has.
    """
    ship(trusted.sparkSession)
    top = trusted.where("text is not null").select("text").mapInArrow(_counter(order), "gram binary, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    counts = {order: stored(top, "kn-counts")}
    for n in range(order - 1, 0, -1):
        counts[n] = stored(counts[n + 1].groupBy(F.expr("substring(gram, 9)").alias("gram")).agg(F.count("*").alias("c")), "kn-counts")
    kinds = float(counts[1].count() + 1)
    lower, tables, freed_of = None, [], {}
    for n in range(1, order + 1):
        d1, d2, d3 = _discounts(counts[n])
        c = F.col("c")
        lose = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
        history = F.substring("gram", 1, 8 * (n - 1)) if n > 1 else F.lit("").cast("binary")
        rows = counts[n].withColumn("history", history).withColumn("lose", F.least(lose, c.cast("double")))
        sums = rows.groupBy("history").agg(F.sum("c").alias("total"), F.round(F.sum("lose"), 9).alias("freed"))
        sums = stored(sums.withColumn("freed", F.col("freed") / F.col("total")), "kn-histories")
        rows = rows.join(sums, "history").withColumn("own", (c - F.col("lose")) / F.col("total"))
        if n == 1:
            p = rows.select("gram", (F.col("own") + F.col("freed") / kinds).alias("p"))
        else:
            below = lower.select(F.col("gram").alias("end"), F.col("p").alias("below"))
            p = rows.withColumn("end", F.expr("substring(gram, 9)")).join(below, "end", "left").select("gram", (F.col("own") + F.col("freed") * F.coalesce("below", F.lit(0.0))).alias("p"))
        lower = stored(p, "kn-probabilities")
        tables.append(lower)
        freed_of[n - 1] = sums
    out = freed_of[0].select(F.lit(0).alias("n"), F.lit("").cast("binary").alias("gram"), F.lit(0.0).alias("logp"), F.log(F.col("freed") / kinds).alias("backoff"))
    for n in range(1, order + 1):
        rows = tables[n - 1].select(F.lit(n).alias("n"), "gram", F.log("p").alias("logp"))
        if n < order:  # a history may be no n-gram of its own order, at a text's beginning
            freed = freed_of[n].select(F.col("history").alias("gram"), F.log("freed").alias("backoff"))
            rows = rows.join(freed, "gram", "full").select(F.lit(n).alias("n"), "gram", "logp", F.coalesce("backoff", F.lit(0.0)).alias("backoff"))
        else:
            rows = rows.withColumn("backoff", F.lit(0.0))
        out = out.unionByName(rows)
    out = stored(out, "kn-model")
    release(*counts.values(), *tables, *freed_of.values())
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "text", SLICE):
            chars = [len(" ".join(t.split())) if t else 0 for t in part.column("text").to_pylist()]
            words = K.split(part.column("text"), hashes=False).count
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "key")), pa.array(chars, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "lang", "key", "n_chars", "n_words"])


def _grams(order: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", SLICE):
                w = K.split(part.column("text"))
                found, size = _grams_of(w, order)
                doc = w.doc
                first, n = _distinct(found, doc)
                key = part.column("key").to_numpy()[doc[first]]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), _binary(found[first], size[first]), pa.array(n, pa.int64())], ["key", "gram", "times"])

    return grams


def scores(docs: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, n_chars, n_words and logp of every row of ``docs``.

    The n-grams of each text, counted, are joined with each order of the model from the
    lowest up, dealt by n-gram, and summed by a hash of id and text; rows that share
    both share the mean of a word.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    each = rows.mapInArrow(_measured, _SCORED)
    sizes = {r.n: r["count"] for r in model.groupBy("n").count().collect()}
    if not sizes:  # nothing was trusted
        return each.drop("key").withColumn("logp", F.lit(0.0))

    def of(n: int, value: str, name: str) -> DataFrame:
        own = model.where(F.col("n") == n).where(F.col(value).isNotNull()).select(F.col("gram").alias("end"), F.col(value).alias(name))
        return F.broadcast(own) if sizes.get(n, 0) <= BROADCAST_ROWS else own

    out = rows.select("key", "text").mapInArrow(_grams(order), "key long, gram binary, times long")
    out = out.withColumn("lp", F.lit(model.where("n = 0").select(F.max("backoff")).first()[0]))
    for n in range(1, order + 1):
        has, lp = F.octet_length("gram") >= 8 * n, F.col("lp")
        if n > 1:
            out = out.withColumn("end", F.when(has, F.expr(f"substring(gram, {-8 * n}, {8 * (n - 1)})"))).join(of(n - 1, "backoff", "b"), "end", "left").drop("end")
            lp = lp + F.coalesce("b", F.lit(0.0))
        out = out.withColumn("end", F.when(has, F.expr(f"substring(gram, {-8 * n}, {8 * n})"))).join(of(n, "logp", "p"), "end", "left").drop("end")
        out = out.withColumn("lp", F.coalesce("p", lp)).drop("p", "b")
    sums = out.groupBy("key").agg((F.sum(F.col("times") * F.col("lp")) / F.sum("times")).alias("mean"))
    return each.join(sums, "key", "left").select("doc_id", "lang", "n_chars", "n_words", (F.col("n_words") * F.coalesce("mean", F.lit(0.0))).alias("logp"))


def _thresholds(trusted: DataFrame, quantile: float) -> DataFrame:
    """(lang, limit): by language and, as null, over all: the step up to which ``quantile`` lie."""
    hist = trusted.groupBy("lang", "step").agg(F.count("*").alias("n"))
    hist = hist.where("lang is not null").unionByName(hist.groupBy("step").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "step", "n"))
    by = W.partitionBy("lang")
    upto = F.sum("n").over(by.orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow))
    return hist.withColumn("upto", upto).withColumn("all", F.sum("n").over(by)).where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(F.min("step").alias("step"))


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity (per word), threshold and keep of each row.

    Trusted are the texts of documents that ``labels`` (doc_id, quality, toxic) calls
    good and not toxic; all of them train the model.  A language's threshold is the
    ``quantile`` of its trusted texts' perplexities, each under a model of the FOLDS - 1
    parts of the trusted texts that it is not in (a model of words knows its own texts
    too well), rounded up to a step of exp(1 / STEPS); where all trusted texts are one and the
    same, it is scored by its own model; parts are ranges of a hash of the text, cut where
    as many trusted texts are below as above, so any choice of labels has them; a language without trusted texts, and null, has that of all
    trusted texts.  A text is kept when its perplexity does not exceed its threshold.

    Null, empty and blank texts: null perplexity, not kept.  Without any trusted text
    nothing has a perplexity and nothing is kept.  Null ids are never trusted; an id
    with differing labels is trusted if one of them is good and none toxic.

    Models of ORDER are counted and asked in packed blocks (:mod:`gram_blocks`), others
    by joins of :func:`train` and :func:`scores`; both give the same.
    """
    spark = docs.sparkSession
    ship(spark)
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("good_id")).agg(F.max(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    good = stored(good.where("q = 1 and t = 0").select("good_id"), "trusted")
    each, unseen = (_in_blocks if order == ORDER and FOLDS == 2 else _by_joins)(docs, good, order)
    ppl = F.when((F.col("n_words") > 0) & (F.col("logp") < 0), F.exp(-F.col("logp") / F.col("n_words")))
    step = F.ceil(F.round(F.log("perplexity") * STEPS, 6))
    each, unseen = (x.withColumn("perplexity", F.round(ppl, 9)).withColumn("step", step) for x in (each, unseen))
    limits = stored(_thresholds(unseen.where("perplexity is not null"), quantile), "kn-thresholds")
    of_all = limits.where("lang is null").select(F.col("step").alias("any_limit"))
    own = limits.where("lang is not null").select(F.col("lang").alias("own_lang"), F.col("step").alias("own_limit"))
    everywhere = F.lit((of_all.first() or [None])[0]).cast("long")
    out = each.join(own, each["lang"] == own["own_lang"], "left").withColumn("limit", F.coalesce("own_limit", everywhere))
    return out.select("doc_id", "lang", "n_chars", "perplexity", F.round(F.exp(F.col("limit") / STEPS), 9).alias("threshold"), F.coalesce(F.col("step") <= F.col("limit"), F.lit(False)).alias("keep"))


def _cuts(trusted: DataFrame, of_text: Column) -> list[int]:
    """Hashes of texts that cut the trusted ones into FOLDS parts of equal numbers; equal texts are in one part."""
    return trusted.where("text is not null").agg(F.percentile_approx(of_text, F.array(*(F.lit(k / FOLDS) for k in range(1, FOLDS))), 10_000)).first()[0] or []


def _in_blocks(docs: DataFrame, good: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Scores of all texts, and of the trusted ones under a model of the other part."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitset.gather(good))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", F.xxhash64("text").alias("of_text")).withColumn("key", F.xxhash64("doc_id", "of_text"))
    # ids that the filter of fixed size lets pass and that no label calls good: few, and so no text meets a join
    passed = rows.where("doc_id is not null").select("doc_id").mapInArrow(_passing(bits), "doc_id long")
    wrong = passed.join(good, passed["doc_id"] == good["good_id"], "left_anti").distinct()
    wrong = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in wrong.collect()], np.int64)))
    hashes = rows.where("doc_id is not null and text is not null").select("doc_id", "of_text").mapInArrow(_trusted_only(_halves(bits, wrong, 0)), "doc_id long, of_text long")
    cuts = hashes.agg(F.percentile_approx("of_text", F.array(F.lit(0.5)), 10_000)).first()[0] or [0]
    each, law = gram_blocks.scores(rows, _halves(bits, wrong, cuts[0]))
    unseen = each.where("half >= 0")
    if law.has(1) and law.has(2):
        unseen = unseen.withColumn("logp", F.col("other_logp"))
    return each, unseen


def _halves(bits, wrong, cut: int):
    """Which half of the trusted texts each row is in, or -1."""

    def halves(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(wrong.value, ids), max(len(wrong.value) - 1, 0))
        barred = wrong.value[at] == ids if len(wrong.value) else np.zeros(len(ids), bool)
        return np.where(known & bitset.has(bits.value, ids) & ~barred, batch.column("of_text").to_numpy(zero_copy_only=False) > cut, -1).astype(np.int64)

    return halves


def _trusted_only(halves):
    def trusted_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(halves(batch) >= 0))

    return trusted_only


def _by_joins(docs: DataFrame, good: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """The same for a model of any order, by joins of n-grams."""
    bits = docs.sparkSession.sparkContext.broadcast(bitset.gather(good))
    # a filter of fixed size first, so that few other texts meet the exact join
    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(_passing(bits), "doc_id long, lang string, text string")
    trusted = some.join(good, some["doc_id"] == good["good_id"], "left_semi")
    model = train(trusted, order)
    each = stored(scores(docs, model, order), "perplexity")
    release(model)
    of_text = F.xxhash64("text")
    fold = sum(((of_text > c).cast("int") for c in _cuts(trusted, of_text)), F.lit(0))
    others = [train(trusted.where(fold != f), order) for f in range(FOLDS)]
    if all(m.count() for m in others):
        unseen = stored(reduce(DataFrame.unionByName, (scores(trusted.where(fold == f), m, order) for f, m in enumerate(others))), "perplexity")
    else:
        unseen = each.join(good, each["doc_id"] == good["good_id"], "left_semi")
    release(*others)
    return each, unseen


def _passing(bits):
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitset.has(bits.value, batch.column("doc_id").to_numpy(zero_copy_only=False))))

    return passing
