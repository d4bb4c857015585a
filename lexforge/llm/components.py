"""Connected components of a graph of links, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import release, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b), the smallest node it reaches.

    Alternates two steps until nothing changes: each node hands its larger neighbours,
    then its smaller ones, to the least node it knows.  Each doubles the distance that
    is spanned.  Sums are taken before rows meet by node, and every round is a stored
    table, so that neither hubs nor lost executors matter.
    """
    now = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, now = now, stored(small.where("u != v").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(old)
        if state == seen:
            break
        seen = state
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
