"""Streams of answer events to answers, each given once, when its stream is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files

#: Micro-batches without an event of its own after which a stream counts as broken off.
IDLE = 1000
#: The error of a stream that was broken off.
BROKEN_OFF = "broken off"
#: Events that close a stream.
CLOSING = ("done", "error")
_STATE = "id string, events array<struct<nth: bigint, type: string, text: string>>, since long, closed boolean, answer struct<text: string, error: string, usage: string, events: bigint>"


def _merged(old: DataFrame, lines: DataFrame, epoch: int) -> DataFrame:
    """id, events and since of all streams that are open: what was there, and what came."""
    kept = old.where("not closed").select("id", "since", F.lit(0).alias("p"), F.inline("events"))
    came = files.events(lines.select(F.col("id").cast("string").alias("id"), F.col("nth").cast("long").alias("nth"), "line").where("id is not null and nth >= 0"))
    came = came.join(old.where("closed").select("id"), "id", "left_anti").select("id", F.lit(epoch).cast("long").alias("since"), F.lit(1).alias("p"), "nth", "type", "text")
    each = kept.unionByName(came).groupBy("id", "nth").agg(F.max("since").alias("since"), F.min(F.struct("p", "type", "text")).alias("e"))
    return each.groupBy("id").agg(F.max("since").alias("since"), F.array_sort(F.collect_list(F.struct("nth", "e.type", "e.text"))).alias("events"))


def _step(old: DataFrame, lines: DataFrame, epoch: int, idle: int) -> DataFrame:
    """The state after a micro-batch, with the answers that it completes."""
    rows = _merged(old, lines, epoch)
    rows = rows.withColumn("last", F.array_min(F.transform(F.filter("events", lambda e: e["type"].isin(*CLOSING)), lambda e: e["nth"])))
    whole = F.filter("events", lambda e: F.col("last").isNull() | (e["nth"] <= F.col("last")))
    rows = rows.withColumn("said", whole)
    done = F.coalesce(F.size("said") == F.col("last") + 1, F.lit(False))
    broken = ~done & (F.lit(epoch) - F.col("since") >= idle)
    of = lambda kind: F.transform(F.filter("said", lambda e: e["type"] == kind), lambda e: e["text"])
    error = F.when(broken, BROKEN_OFF).when(F.element_at("said", -1)["type"] == "error", F.coalesce(F.element_at("said", -1)["text"], F.lit(files.NO_MESSAGE)))
    answer = F.struct(F.array_join(of("text"), "").alias("text"), error.alias("error"), F.try_element_at(of("usage"), F.lit(-1)).alias("usage"), F.size("said").cast("long").alias("events"))
    over = done | broken
    rows = rows.select("id", F.when(~over, F.col("events")).alias("events"), F.when(over, F.lit(epoch)).otherwise(F.col("since")).cast("long").alias("since"), over.alias("closed"), F.when(over, answer).alias("answer"))
    known = old.where(F.col("closed") & (F.lit(epoch) - F.col("since") < idle)).select("id", "events", "since", "closed", F.lit(None).cast("struct<text: string, error: string, usage: string, events: bigint>").alias("answer"))
    return rows.unionByName(known)


def answers(lines: DataFrame, path: str, checkpoint: str, idle: int = IDLE) -> StreamingQuery:
    """Answers out of a stream of rows (id, nth, line); :func:`answered` reads them.

    ``nth`` counts the events of a stream from 0, as its source sent them.  A stream is
    closed by its first ``done`` or ``error`` event; its answer comes in the micro-batch in
    which the last event up to that arrives, whatever the order of arrival, and once:
    repeated events (of two different ones the one that came first), and events after the answer, change nothing.  Lines that are
    no events count as events without text.  Rows without id or nth, or with a negative one, are left
    out.  A stream in which nothing happens for ``idle`` micro-batches is given as it is, with the error
    ``BROKEN_OFF``; an answered one is forgotten after as many.

    A micro-batch reads the state of the one before and writes its own, and its answers, to folders of its
    own: one that runs twice leaves the same tables, and a query that starts again goes on where it was.
    The state is the events of open streams, and ids of those just closed; a stream's events are
    told apart by number before they are put together, so repeats don't meet in one task.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(_STATE).parquet(f"{path}/state/epoch={epoch - 1}") if epoch else spark.createDataFrame([], _STATE)
        _step(old, batch, epoch, idle).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")
        now = spark.read.schema(_STATE).parquet(f"{path}/state/epoch={epoch}")
        now.where("answer is not null").select("id", "answer.*").write.mode("overwrite").parquet(f"{path}/answers/epoch={epoch}")
        past = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state/epoch={epoch - 2}")
        past.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(past, True)

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answered(spark: SparkSession, path: str) -> DataFrame:
    """id, text, error, usage and events (how many) of the answers so far."""
    return spark.read.schema("id string, text string, error string, usage string, events long").parquet(f"{path}/answers/epoch=*")
