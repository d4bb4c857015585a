"""Health of a corpus (E12: J02, P04, P08, A06 to A08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..scratch import stored

#: Columns of a document that the report repeats, where the table has them.
DESCRIPTION = ("title", "source_type", "source_ref", "token_count", "valid_until", "superseded_by", "topic", "document_type", "lifecycle_status")


def documents(docs: DataFrame, chunks: DataFrame, as_of: str) -> DataFrame:
    """One row per document with its chunks counted, its status and its issues; text null means a missing file."""
    live = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("live"))
    joined = docs.join(live, "id", "left").withColumn("live_chunk_count", F.coalesce("live", F.lit(0)))
    issues = F.array_compact(F.array(
        F.when(F.col("text").isNull(), "missing_text_file").when(F.length("text") == 0, "empty_extraction"),
        F.when(F.col("is_active") & (F.col("live_chunk_count") == 0), "no_chunks"),
    ))
    status = T.validity(F.col("superseded_by"), F.col("valid_until"), F.lit(as_of))
    has = [c for c in DESCRIPTION if c in docs.columns]
    return joined.select(
        "id", "is_active", F.col("chunk_count").alias("stored_chunk_count"), "live_chunk_count", F.coalesce(F.length("text"), F.lit(0)).alias("extraction_chars"),
        F.col("text").isNotNull().alias("text_file_exists"), "effective_date", status.alias("validity_status"), issues.alias("issues"), *has,
    )


def issue_histogram(audited: DataFrame) -> DataFrame:
    """A07"""
    return audited.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("documents")).orderBy("issue")


def summary(audited: DataFrame) -> DataFrame:
    """All numbers in one aggregation."""
    active = F.col("is_active")
    has = F.col("live_chunk_count") > 0
    status = F.col("validity_status")
    return audited.agg(
        F.count("*").alias("documents"), F.count_if(active).alias("active"), F.count_if(active & has).alias("indexed"), F.count_if(active & ~has).alias("unindexed"),
        F.count_if(F.array_contains("issues", "missing_text_file")).alias("missing_text"), F.coalesce(F.sum("live_chunk_count"), F.lit(0)).alias("chunks"),
        *(F.count_if(active & (status == s)).alias(s) for s in ("current", "superseded", "expired")),
        F.count_if(active & (F.coalesce("effective_date", F.lit("")) == "")).alias("undated"),
    )


_NULLS = {"ignoreNullFields": "false"}


def _json(c: Column) -> Column:
    return F.to_json(c, _NULLS)


def report_head(audited: DataFrame) -> DataFrame:
    """(summary, issues) of the report, as JSON."""
    s = summary(audited)
    validity = F.struct("current", "superseded", "expired", "undated")
    whole = F.struct(
        "documents", F.col("active").alias("active_documents"), F.col("indexed").alias("indexed_documents"), F.col("unindexed").alias("unindexed_documents"),
        F.col("missing_text").alias("missing_text_files"), F.col("chunks").alias("total_chunks"), validity.alias("validity"),
    )
    issues = issue_histogram(audited).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue", "documents")))).alias("issues"))
    return s.select(_json(whole).alias("summary")).crossJoin(issues.select(_json(F.col("issues")).alias("issues")))


def report_documents(audited: DataFrame) -> DataFrame:
    """(id, document) of the report: each document with its state and issues, as JSON."""
    text = lambda c: F.col(c) if c in audited.columns else F.lit(None).cast("string")
    row = F.struct(
        "id", *(text(c).alias(c) for c in ("title", "source_type", "source_ref")), "is_active", F.coalesce(text("token_count").cast("long"), F.lit(0)).alias("token_count"),
        F.col("live_chunk_count").alias("chunk_count"), "text_file_exists", "extraction_chars", "effective_date", *(text(c).alias(c) for c in ("valid_until", "superseded_by", "topic", "document_type")),
        F.coalesce(T.blank_to_null(text("lifecycle_status")), F.lit("current")).alias("lifecycle_status"), "validity_status", "issues",
    )
    return audited.select("id", _json(row).alias("document"))


def report(audited: DataFrame) -> DataFrame:
    """(nth, line): the lines of one JSON object with summary, issues and documents, in order.

    A line per document, so that a report of any size can be written as text by many tasks.
    ``audited`` is read several times, so it is made once; it has no texts.
    """
    audited = stored(audited, "audited")
    head = report_head(audited).select(F.lit(-1).cast("long").alias("nth"), F.concat(F.lit('{"summary": '), "summary", F.lit(', "issues": '), "issues", F.lit(', "documents": [')).alias("line"))
    docs = report_documents(audited)
    last = docs.agg(F.max("id").alias("last"))
    lines = docs.crossJoin(F.broadcast(last)).select(F.col("id").alias("nth"), F.concat("document", F.when(F.col("id") == F.col("last"), "").otherwise(",")).alias("line"))
    end = head.select(F.lit((1 << 63) - 1).alias("nth"), F.lit("]}").alias("line"))
    return head.unionByName(lines).unionByName(end).orderBy("nth")
