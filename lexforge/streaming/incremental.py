"""Streams: documents indexed as they land, and costs in windows of time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking


def index_arrivals(documents: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Chunk each arriving document, and add the chunks of each micro-batch to the table at ``path``.

    A micro-batch writes what it has (of each id the last by ``added_at``) to a folder of
    its own and touches no other, so its cost is that of its documents however large the
    table is, and a batch that runs twice leaves the same table.  :func:`indexed` reads
    each document's latest chunks; a document without new chunks keeps its old ones.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("document_id").agg(F.max_by("text", F.coalesce("added_at", F.lit("1970-01-01").cast("timestamp"))).alias("text"))
        chunking.chunk_documents(latest, **how).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of each document as its latest micro-batch made them."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("document_id").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["document_id", "epoch"], "left_semi").drop("epoch")


def compact(spark: SparkSession, path: str, out: str) -> None:
    """Write the current chunks as one table, beside that of the stream."""
    indexed(spark, path).write.mode("errorifexists").parquet(out)


def cost_windows(usage: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Costs of answers in tumbling windows; what is later than ``late`` is left out."""
    rows = usage.withWatermark("created_at", late).where(F.col("role") == "assistant")
    return rows.groupBy(F.window("created_at", size)).agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("messages")).select(F.col("window.start").alias("start"), "cost", "messages")


def to_memory(df: DataFrame, name: str, mode: str = "append", each: Callable | None = None) -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
