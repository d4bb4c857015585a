"""Changes to tables as pure functions, and versions of tables on disk.

Each takes a table and a table of changes and returns the new table; ids in the
changes are distinct.  Changes are joined on the key, so both may be of any size.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rules as R, text as T
from ..schemas import DOCUMENT_DEFAULTS, DOCUMENTS, migrate
from ..scratch import stored
from . import chunking

STATUSES = ("indexing", "ready", "failed")
LIFECYCLES = ("current", "superseded", "repealed", "draft", "historical")


def add_documents(documents: DataFrame, new: DataFrame) -> DataFrame:
    """New documents, status indexing."""
    rows = migrate(new.withColumn("index_status", F.lit("indexing")), DOCUMENTS, DOCUMENT_DEFAULTS)
    return documents.unionByName(rows.select(*[c for c in rows.columns if c in documents.columns]), allowMissingColumns=True)


def add_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    """M13"""
    return table.unionByName(new, allowMissingColumns=True)


def _changed(base: DataFrame, changes: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """``base`` with ``columns`` where ``changes`` (whose other columns begin with new_) has the key."""
    side = changes.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != key], F.lit(True).alias("hit"))
    joined = base.join(side, key, "left")
    out = [F.when(F.col("hit"), columns[c]).otherwise(F.col(c)).cast(dict(base.dtypes)[c]).alias(c) if c in columns else F.col(c) for c in base.columns]
    return joined.select(*out)


def _valid(c: Column, allowed: tuple[str, ...], what: str) -> Column:
    """The value, or an error of the job if it is none of ``allowed``."""
    return F.when(c.isNull() | c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)))


def set_status(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, index_status, index_error, chunk_count, at)."""
    status = _valid(F.col("new_index_status"), STATUSES, "status")
    ready = F.col("new_index_status") == "ready"
    return _changed(documents, changes, "id", {
        "index_status": status, "index_error": F.col("new_index_error"), "chunk_count": F.coalesce("new_chunk_count", "chunk_count"),
        "indexed_at": F.when(ready, F.col("new_at")).otherwise(F.col("indexed_at")),
    })


def set_validity(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, effective_date, valid_until, superseded_by); null clears."""
    return _changed(documents, changes, "id", {c: F.col(f"new_{c}") for c in ("effective_date", "valid_until", "superseded_by")})


def validity_errors(changes: DataFrame, documents: DataFrame) -> DataFrame:
    """What is wrong with changes of validity: a document by itself, or by none that is there."""
    ids = documents.select(F.col("id").alias("superseded_by"), F.lit(True).alias("there"))
    errors = F.array_compact(F.array(
        F.when(F.col("superseded_by") == F.col("id"), "superseded_by_itself"), F.when(F.col("superseded_by").isNotNull() & F.col("there").isNull(), "replacement_missing")
    ))
    return changes.join(ids, "superseded_by", "left").select("id", errors.alias("errors"))


def metadata_errors(changes: DataFrame) -> DataFrame:
    """What is wrong with changes of metadata: a title of nothing but white space (null keeps the old one)."""
    blank = F.when(T.strip(F.col("title")) == "", "blank_title")
    return changes.select("id", F.array_compact(F.array(blank)).alias("errors"))


def set_metadata(documents: DataFrame, chunks: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes (id, title, topic, document_type, lifecycle_status); null keeps; titles reach the chunks."""
    new = {c: F.coalesce(f"new_{c}", c) for c in ("title", "topic", "document_type")}
    new["lifecycle_status"] = F.coalesce(_valid(F.col("new_lifecycle_status"), LIFECYCLES, "lifecycle"), F.col("lifecycle_status"))
    titles = changes.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return _changed(documents, changes, "id", new), _changed(chunks, titles, "document_id", {"document_title": F.coalesce("new_document_title", "document_title")})


def archive(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """M05"""
    return _changed(documents, ids.select("id"), "id", {"is_active": F.lit(False), "lifecycle_status": F.lit("historical")})


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't there yet."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace those of the same key, but for the columns in ``keep``."""
    a, b = table.withColumn("old", F.lit(True)).alias("a"), new.withColumn("fresh", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = a.join(b, on, "full")
    out = []
    for c in table.columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else None
        if c in keys:
            out.append(F.coalesce(x, y).alias(c))
        elif y is None:
            out.append(x.alias(c))
        elif c in keep:
            out.append(F.when(F.col("old"), x).otherwise(y).alias(c))
        else:
            out.append(F.when(F.col("fresh"), y).otherwise(x).alias(c))
    return joined.select(*out)


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents that ``new`` has chunks of; a document without new chunks keeps its old ones."""
    return chunks.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*chunks.columns).unionByName(new, allowMissingColumns=True)


def delete_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame, cascade: bool = True) -> tuple[DataFrame, DataFrame]:
    """Without the documents and, with ``cascade``, their chunks."""
    gone = ids.select("id")
    left = chunks.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti").select(*chunks.columns) if cascade else chunks
    return documents.join(gone, "id", "left_anti"), left


def set_artifact(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (id, original_path, source_checksum, text, token_count); null keeps."""
    cols = [c for c in ("original_path", "source_checksum", "text", "token_count") if c in changes.columns and c in documents.columns]
    return _changed(documents, changes, "id", {c: F.coalesce(f"new_{c}", c) for c in cols})


def backfill(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Missing columns, counts from the chunks, statuses that follow, dates from titles."""
    d = migrate(documents, DOCUMENTS, DOCUMENT_DEFAULTS)
    n = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("live"))
    live = F.coalesce("live", F.lit(0))
    pending = F.col("index_status") == "pending"
    status = F.when(pending, F.when(live > 0, "ready").otherwise("failed")).otherwise(F.col("index_status"))
    error = F.when(pending & (live == 0), F.coalesce("index_error", F.lit("no chunks"))).otherwise(F.col("index_error"))
    new = {"index_status": status, "index_error": error, "chunk_count": live, "effective_date": F.coalesce("effective_date", T.title_date(F.col("title")))}
    return d.join(n, "id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in d.columns])


def seed_parameters(parameters: DataFrame, first: dict = R.FIRST_PARAMETER) -> DataFrame:
    """The table with its first row, unless the row's key and year are there."""
    types = dict(parameters.dtypes)
    row = parameters.sparkSession.range(1).select(*(F.lit(v).cast(types[c]).alias(c) for c, v in first.items() if c in types))
    return insert_or_ignore(parameters, row, ["parameter_key", "tax_year"])


def set_setting(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (key, value, updated_at); a null value deletes the setting."""
    kept = settings.join(changes.where("value is null").select("key"), "key", "left_anti").select(*settings.columns)
    return upsert(kept, changes.where("value is not null"), ["key"])


def reindex_plan(documents: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """What a new run does with each document: fetch its address again, read its text again, or nothing.

    With ``ids`` (id), the others are skipped.
    """
    url = T.first_url(F.col("source_ref"))
    action = F.when(~F.col("is_active"), "skip").when(url.isNotNull(), "fetch").when(F.length(F.coalesce("text", F.lit(""))) > 0, "reindex").otherwise("skip")
    rows = documents
    if ids is not None:
        rows = documents.join(ids.select("id", F.lit(True).alias("chosen")), "id", "left")
        action = F.when(F.col("chosen"), action).otherwise("skip")
    return rows.select("id", action.alias("action"), url.alias("url"))


def reindex(documents: DataFrame, chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """All active documents chunked anew from their texts: (chunks, outcomes).

    ``outcomes`` has id, title, outcome (succeeded or failed), error and chunks.  A
    document without text fails and keeps its old chunks; the others go on.  Pages are
    used where a document has them.
    """
    active = documents.where("is_active")
    text = F.length(F.coalesce("text", F.lit(""))) > 0
    rows = active.where(text).select(F.col("id").alias("document_id"), "text", "title", *(["pages"] if "pages" in documents.columns else []))
    new = (chunking.chunk if "pages" in documents.columns else chunking.chunk_documents)(rows, keep=("title",), **how).withColumnRenamed("title", "document_title")
    new = chunking.embed(new, embedder) if embedder else new
    counts = new.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    error = F.when(~text, "no text").when(F.col("n").isNull(), "no chunks")
    outcomes = active.join(counts, "id", "left").select("id", "title", F.when(error.isNull(), "succeeded").otherwise("failed").alias("outcome"), error.alias("error"), F.coalesce("n", F.lit(0)).alias("chunks"))
    return replace_chunks(chunks, new.select(*[c for c in new.columns if c in chunks.columns])), outcomes


def reingest(documents: DataFrame, chunks: DataFrame, fetch: Callable[[DataFrame], DataFrame], ids: DataFrame | None = None, apply: bool = False, at: str | None = None, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents from addresses fetched, extracted and chunked again: (documents, chunks, outcomes).

    ``fetch`` takes rows (id, url) and returns rows (id, content, text, pages, kind,
    error), as sources.files.fetch_documents does.  Without ``apply`` nothing changes
    and the outcomes say what would be done.  A document that can't be fetched or has no
    text fails and stays as it is.  With ``at``, statuses, errors, counts and that time are
    set as well.
    """
    urls = documents.where("is_active and source_type = 'url'")
    plan = reindex_plan(urls, ids).select("id", "url")
    if ids is not None:
        plan = plan.join(ids.select("id"), "id", "left_semi")
    if not apply:
        return documents, chunks, plan.select("id", F.when(F.col("url").isNull(), "skipped").otherwise("would be fetched").alias("outcome"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("chunks"))
    got = stored(fetch(plan.where("url is not null")), "fetched")
    good = got.where("error is null")
    artifact = good.select("id", F.sha2("content", 256).alias("source_checksum"), "text", T.estimate_tokens(F.col("text")).alias("token_count"))
    rows = good.select(F.col("id").alias("document_id"), "text", "pages").join(documents.select(F.col("id").alias("document_id"), "title"), "document_id")
    new = chunking.chunk(rows, keep=("title",), **how).withColumnRenamed("title", "document_title")
    counts = new.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    outcomes = plan.join(got.select("id", "error"), "id", "left").join(counts, "id", "left")
    what = F.when(F.col("url").isNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("succeeded")
    outcomes = outcomes.select("id", what.alias("outcome"), "error", F.coalesce("n", F.lit(0)).alias("chunks"))
    out = set_artifact(documents, artifact)
    if at is not None:
        state = outcomes.where("outcome != 'skipped'").select("id", F.when(F.col("outcome") == "succeeded", "ready").otherwise("failed").alias("index_status"), F.col("error").alias("index_error"), F.when(F.col("outcome") == "succeeded", F.col("chunks")).alias("chunk_count"), F.lit(at).cast("timestamp").alias("at"))
        out = set_status(out, state)
    return out, replace_chunks(chunks, new.select(*[c for c in new.columns if c in chunks.columns])), outcomes


def tally(outcomes: DataFrame) -> DataFrame:
    """A18"""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def publish(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones; readers see it when its marker is there.

    A job that dies leaves a version without marker, which nothing reads.  Each writer
    has a folder of its own, named by the number after the last complete version and a
    random part, so two writers never touch each other's; the later name is current.
    """
    done = versions(df.sparkSession, path)
    nth = int(re.search(r"v(\d+)-", done[-1])[1]) + 1 if done else 1
    where = f"{path}/v{nth:09d}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return where


def publish_all(tables: dict[str, DataFrame], path: str) -> str:
    """Write tables as one version: a folder each, seen together when the version's marker is there."""
    spark = next(iter(tables.values())).sparkSession
    done = versions(spark, path)
    nth = int(re.search(r"v(\d+)-", done[-1])[1]) + 1 if done else 1
    where = f"{path}/v{nth:09d}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{where}/{name}")
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(marker).close()
    return where


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a table, oldest first."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    done = [s.getPath().toString() for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(done)


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(versions(spark, path)[-1])
