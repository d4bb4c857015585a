"""Conversations, logs, costs and totals."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def first_questions(messages: DataFrame) -> DataFrame:
    """The first user message of each conversation."""
    return messages.where("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "id").alias("first_question"))


def last_questions(messages: DataFrame) -> DataFrame:
    """The last user message of each whole conversation."""
    return messages.where("role = 'user'").groupBy("conversation_id").agg(F.max_by("content", "id").alias("question"))


def conversation_list(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with first question and number of messages, newest first.

    One pass over the messages gives both, summed in each task before it is joined.
    """
    per = messages.groupBy("conversation_id").agg(F.min_by("content", F.when(F.col("role") == "user", F.col("id"))).alias("q"), F.count_if(F.col("role") == "user").alias("asked"), F.count("*").alias("n"))
    out = conversations.join(per, conversations["id"] == per["conversation_id"], "left")
    return out.select("id", "session_id", "started_at", F.when(F.col("asked") > 0, F.col("q")).alias("first_question"), F.coalesce("n", F.lit(0)).alias("message_count")).orderBy(F.desc("started_at"), F.desc("id"))


def history(messages: DataFrame) -> DataFrame:
    """Role and content of all but a conversation's last message."""
    last = messages.groupBy("conversation_id").agg(F.max("id").alias("last_id"))
    return messages.join(last, "conversation_id").where("id < last_id").select("conversation_id", "id", "role", "content")


def conversation(messages: DataFrame, conversation_id: int) -> DataFrame:
    """H04, T02"""
    return messages.where(F.col("conversation_id") == conversation_id).orderBy("id")


def question_before(messages: DataFrame) -> DataFrame:
    """Each answer with the latest user message before it."""
    before = W.partitionBy("conversation_id").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before)
    return messages.withColumn("question", asked).where("role = 'assistant'").select("conversation_id", "id", "question")


def log_filter(created_at: Column, date_from: str | None, date_to: str | None) -> Column:
    """Whole days, both included, compared as text to the second.

    Dates are compared as times, which goes down to the files; other texts by their letters.
    """
    t = F.date_format(created_at, "yyyy-MM-dd HH:mm:ss")
    out = F.lit(True)
    if date_from:
        out = out & (created_at >= F.lit(date_from) if _day(date_from) else t >= date_from)
    if date_to:
        day = _day(date_to)
        out = out & (created_at < F.lit(str(day + timedelta(days=1))) if day else t <= date_to + " 23:59:59")
    return out


def _day(x: str) -> date | None:
    try:
        return date.fromisoformat(x) if len(x) == 10 else None
    except ValueError:
        return None


def logs(messages: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Answers in a range of days, each with the last question of its conversation."""
    rows = messages.where(F.col("role") == "assistant").where(log_filter(F.col("created_at"), date_from, date_to))
    if not date_from and not date_to:
        return rows.join(last_questions(messages), "conversation_id", "left")
    wanted = rows.select("conversation_id").distinct()  # of other conversations no question is sought
    return rows.join(last_questions(messages.join(wanted, "conversation_id", "left_semi")), "conversation_id", "left")


def page(rows: DataFrame, number: int, size: int = 20) -> DataFrame:
    """One page, newest first.

    Counts by day, then by second, tell which rows a page can be among, so only these are
    ordered: the last page costs what the first does.
    """
    skip = (number - 1) * size
    for seconds in (86_400, 1):
        at = F.coalesce(F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / seconds), F.lit(-(1 << 62)))  # null is last
        counts = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before).where((F.col("before") < skip + size) & (F.col("before") + F.col("n") > skip))
        first, last, passed = counts.agg(F.max("at"), F.min("at"), F.min("before")).first()
        if first is None:  # a page behind the last
            return rows.limit(0)
        rows, skip = rows.where(at.between(F.lit(last), F.lit(first))), skip - passed
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(size)


def page_count(rows: DataFrame, size: int = 20) -> DataFrame:
    """A04, T08"""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def export(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """The newest rows for a file, questions cut to 100 characters, nulls empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    at = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")
    return out.select(at, F.substring(F.coalesce("question", F.lit("")), 1, 100).alias("question"), *(empty(c).alias(c) for c in ("confidence", "response_time_ms", *TOKENS, "cost_usd")))


def costs_daily(usage: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Sums of the answers of each day, from ``days`` days before ``as_of`` on."""
    rows = usage.where((F.col("role") == "assistant") & (F.col("created_at") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    return rows.groupBy(F.to_date("created_at").alias("date")).agg(F.sum("cost_usd").alias("cost"), *(F.sum(c).alias(c) for c in TOKENS), F.count("*").alias("messages")).orderBy(F.desc("date"))


def costs_summary(usage: DataFrame, as_of: str) -> DataFrame:
    """Cost of today, of this month and of all time."""
    day = F.lit(as_of).cast("date")
    at = F.to_date("created_at")
    cost = lambda when: F.coalesce(F.sum(F.when(when, F.col("cost_usd"))), F.lit(0.0))
    rows = usage.where(F.col("role") == "assistant")
    return rows.agg(cost(at == day).alias("today"), cost(at >= F.trunc(day, "month")).alias("month"), cost(F.lit(True)).alias("total"))


def bars(daily: DataFrame) -> DataFrame:
    """A height in percent for each day, 4 at least."""
    top = F.greatest(F.max("cost").over(W.partitionBy()), F.lit(0.001))
    return daily.withColumn("height", F.greatest(F.col("cost") / top * 100, F.lit(4.0)))


def total_tokens(documents: DataFrame) -> DataFrame:
    """A01"""
    return documents.where("is_active").agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def document_stats(documents: DataFrame, chunks: DataFrame, warn: int = 500_000) -> DataFrame:
    """Numbers of documents, tokens and chunks (orphans too), and whether tokens are many."""
    d = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    return d.crossJoin(chunks.agg(F.count("*").alias("chunks"))).withColumn("warning", F.col("tokens") > warn)


def version(chunks: DataFrame, name: str) -> DataFrame:
    """The version that runs, and how many chunks there are."""
    return chunks.agg(F.lit(name).alias("version"), F.count("*").alias("total_chunks"))


def tiles(documents: DataFrame) -> DataFrame:
    """A10: the dashboard's numbers; a ready document without chunks counts as ready and as failed."""
    none = F.coalesce("chunk_count", F.lit(0)) == 0
    status = T.index_status(F.col("index_status"), F.col("chunk_count"))
    return documents.agg(
        F.count_if("is_active").alias("active"), F.count_if(status == "ready").alias("ready"), F.count_if((status == "failed") | none).alias("failed"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"),
    )


def documents_list(documents: DataFrame, active_only: bool = True) -> DataFrame:
    """S01, P01, T01"""
    rows = documents.where("is_active") if active_only else documents
    return rows.orderBy(F.desc("added_at"), F.desc("id"))
