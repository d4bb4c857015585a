"""Operator 10: mix sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

#: Weights by rank of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words wanted, as a share of all words; most that a document may be taken.
SHARE, MOST = 1.5, 2
#: The hash key has 48 bits; each histogram looks at 12 of them.
KEY_BITS, LEVEL_BITS = 48, 12
#: Tables with a row per source are broadcast up to so many rows, else joined by shuffle.
FEW_SOURCES = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key(doc_id: Column, text: Column) -> Column:
    """48 bits of an MD5: of the id, or of the text of a row without one."""
    of = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(of), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> + target, by filling up to the caps.

    The sources rank by code point, null last.  A level per weight is sought such
    that the targets min(MOST * size, level * weight) share SHARE of all words: with
    the sources in order of size / weight, the capped ones are a prefix, and the first
    source that its level does not cap ends it.  One row per source is all that meets
    in one task here.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    by_ratio = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy("ratio", "rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("ratio", F.col("source_size").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(after))
        .withColumn("level", (F.lit(SHARE) * F.col("total") - F.lit(MOST) * F.col("before")) / F.col("weights"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.lit(MOST) * F.col("source_size"))
        .withColumn("place", F.row_number().over(W.orderBy("ratio", "rank")))
        .withColumn("ends", F.min(F.when(F.col("fits"), F.col("place"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("place") == F.col("ends"), F.col("level"))).over(everything))
    )
    capped = F.col("ends").isNull() | (F.col("place") < F.col("ends"))
    full = (F.lit(MOST) * F.col("source_size")).cast("double")
    return out.select("source", "source_size", F.when(capped, full).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a stored table with a row per source, if it is as small as one would think."""
    return F.broadcast(df) if df.count() <= FEW_SOURCES else df


def _boundary(rows: DataFrame, budgets: DataFrame, shift: int) -> DataFrame:
    """The bucket of 2**shift keys in which each source's budget runs out.

    rows (source, key, size) are summed by source and bucket first; what meets by
    source is a histogram of 2**LEVEL_BITS buckets at most.
    """
    order = W.partitionBy("source").orderBy("bucket")
    hist = rows.groupBy(F.col("source").alias("s"), F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("size"))
    return (
        hist.join(budgets, hist["s"].eqNullSafe(budgets["source"]))
        .withColumn("after", F.col("skipped") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .where(F.col("after") > F.col("budget"))
        .withColumn("nth", F.row_number().over(order))
        .where("nth = 1")
        .select("source", "budget", (F.col("after") - F.col("size")).alias("skipped"), "bucket")
    )


def cuts(base: DataFrame, budgets: DataFrame) -> DataFrame:
    """The largest key that each source's budget still takes; no row where it takes every key.

    Histograms by source and leading hash bits find the bucket in which the budget
    runs out; only that bucket is looked at again, with the next bits, and its last
    remainder by single keys.  A key is taken when at least half of it fits.
    """
    k = base.select(F.col("source").alias("s"), "key", "size")

    def inside(found: DataFrame, shift: int) -> DataFrame:
        same = k["s"].eqNullSafe(found["source"]) & (F.shiftright(k["key"], shift) == found["bucket"])
        return k.join(_small(found), same).select("source", "budget", "skipped", "bucket", "key", "size")

    one, two = KEY_BITS - LEVEL_BITS, KEY_BITS - 2 * LEVEL_BITS
    budgets = budgets.withColumn("skipped", F.lit(0).cast("long"))
    first = stored(_boundary(base, budgets, one), "mix-boundary")
    second = stored(_boundary(inside(first, one).select("source", "key", "size"), first.drop("bucket"), two), "mix-boundary")
    last = inside(second, two).groupBy("source", "budget", "skipped", "bucket", "key").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    taken = F.col("skipped") + before + F.col("size") / 2 <= F.col("budget")
    return (
        last.withColumn("taken", taken)
        .groupBy("source", "bucket")
        .agg(F.max(F.when(F.col("taken"), F.col("key"))).alias("cut"))
        .select("source", F.coalesce("cut", F.shiftleft("bucket", two) - 1).alias("cut"))
    )


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, plan): doc_id, source, size and key of each row; thresholds of each source.

    Both are stored tables, so that the text is read and hashed once.
    """
    base = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), key(F.col("doc_id"), F.col("text")).alias("key")), "mix")
    goal = stored(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    once = F.col("target") >= F.col("source_size")
    budgets = goal.select("source", (F.col("target") - F.when(once, F.col("source_size")).otherwise(0)).alias("budget"))
    cut = cuts(base, budgets).withColumnRenamed("source", "cs")
    out = goal.join(cut, goal["source"].eqNullSafe(F.col("cs")), "left")
    return base, stored(out.select(F.col("source").alias("mix_source"), "source_size", "target", once.cast("int").alias("mix_once"), F.col("cut").alias("mix_cut")), "mix-plan")


def _copies(rows: DataFrame, thresholds: DataFrame, k: Column) -> DataFrame:
    under = F.when(F.col("mix_cut").isNull() | (k <= F.col("mix_cut")), 1).otherwise(0)
    return rows.join(_small(thresholds), rows["source"].eqNullSafe(thresholds["mix_source"])).withColumn("copies", F.col("mix_once") + under)


def mix(docs: DataFrame) -> DataFrame:
    """Decide how many words the mix takes of each document.

    ``docs`` has doc_id, text and source; more columns are ignored.  Returns doc_id,
    size, source_size, target, copies (0, 1 or 2) and taken = copies * size, one row
    per input row.  A source whose target is under its size takes the documents whose
    hash lies under a threshold; a target between one and two times its size takes
    every document once and those under a threshold again.  Documents are taken whole,
    so a source misses its target by half of one document at most.

    Null text: size 0.  Null source: a source of its own, ranked last.  Null doc_id:
    its text decides its hash.  Rows that repeat an id share a hash and are taken or
    left together.  An empty table gives an empty result.
    """
    base, thresholds = plan(docs)
    out = _copies(base, thresholds, F.col("key"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, all columns kept.

    Rows without words are left out, as they add nothing to a mix.
    """
    _, thresholds = plan(docs)
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever the columns are called
    of = {n: rows[f"c{i}"] for i, n in enumerate(names)}
    rows = rows.withColumns({"source": of["source"], "mix_key": key(of["doc_id"], of["text"]), "mix_words": words(of["text"])})
    out = _copies(rows, thresholds, F.col("mix_key")).where("copies > 0 and mix_words > 0")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
