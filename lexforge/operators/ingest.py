"""Uploads to indexed chunks and statuses, as one operation.

What fails, fails for one document alone: a file that can't be read, or an embedder that
gives up on its texts, leaves that document ``failed`` with the chunks that it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..scratch import stored
from ..session import ship, sliced
from ..sources import files as S, pdf
from . import catalog, chunking

#: Texts of a document that an embedder is asked for at a time.
BATCH = 20


def embed_each(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """K07 with failures kept apart: ``embedding`` and ``embed_error`` of each chunk, asked for by document."""
    ship(chunks.sparkSession)
    schema = ", ".join(f"{c} {t}" for c, t in chunks.dtypes) + ", embedding array<double>, embed_error string"

    def ask(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            some = texts[i : i + batch]
            got = embedder(some)
            if len(got) != len(some):
                raise ValueError(f"{len(some)} texts got {len(got)} embeddings")
            out += got
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches):
            vectors, errors, texts = [None] * rows.num_rows, [None] * rows.num_rows, rows.column("content").to_pylist()
            of: dict[object, list[int]] = {}
            for k, d in enumerate(rows.column("document_id").to_pylist()):
                if d is not None:
                    of.setdefault(d, []).append(k)
            for at in of.values():
                try:
                    for k, v in zip(at, ask([texts[k] for k in at]), strict=True):
                        vectors[k] = v
                except Exception as e:  # noqa: BLE001  the document fails, the job goes on
                    for k in at:
                        errors[k] = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], [*rows.schema.names, "embedding", "embed_error"])

    return chunks.mapInArrow(run, schema)


def ingest(
    documents: DataFrame, chunks: DataFrame, uploads: DataFrame, embedder: Callable[[list[str]], list[list[float]]], at: str,
    pdf_reader: Callable[[bytes], list[str]] | None = None, **how,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Take uploads in: (documents, chunks, outcomes).

    ``uploads`` has id, title and content (bytes), ids being distinct; an id that is there
    already is indexed again.  Files that are too large, of no known kind or without text are
    refused: an outcome, and no document (or the old one, as it was).  Others are extracted
    (PDF by :mod:`lexforge.sources.pdf`), added, cut, embedded and become ``ready`` with
    count and time, or ``failed`` with the error: then a new document has no chunks, and an
    old one keeps what it had.  ``at`` is the time that is written; ``how`` goes to
    :func:`chunking.chunk`.  Outcomes: id, title, status (ready, failed, refused), error, chunks.

    Nothing is changed in place; :func:`catalog.publish_all` makes documents and chunks one version.
    """
    ship(uploads.sparkSession)
    files = uploads.select("id", "title", "content", F.col("title").alias("url"), F.lit(None).cast("string").alias("content_type"))
    known = F.lower(F.regexp_extract("title", r"\.([^.]*)$", 1))
    got = S.extract(files.withColumn("content", F.when(known.isin(*S.UPLOADS) & (F.octet_length("content") <= S.MOST_BYTES), F.col("content"))), between_pages="\n\n", pdf_reader=pdf_reader or pdf.read)
    sizes = uploads.select("id", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("source_checksum"))
    got = got.drop("error").join(sizes, "id").withColumn("errors", S.upload_errors(F.col("title"), F.coalesce("n_bytes", F.lit(0)), F.coalesce("text", F.lit(""))))
    got = stored(got.select("id", "title", known.alias("kind"), "text", "pages", "source_checksum", F.array_join("errors", ",").alias("refused")), "uploads")
    good = got.where("refused = ''")
    rows = good.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "text", "pages")
    cut = chunking.chunk(rows, keep=("document_title",), **how).withColumn("document_ref", F.col("document_title"))
    made = stored(embed_each(cut, embedder), "embedded")
    per = made.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"), F.min("embed_error").alias("error"))
    state = good.join(per, "id", "left").withColumn("error", F.when(F.col("n").isNull(), "no chunks").otherwise(F.col("error")))
    state = stored(state.select("id", "title", "kind", "text", "source_checksum", "error", F.coalesce("n", F.lit(0)).alias("n")), "indexed")
    new = state.join(documents.select("id"), "id", "left_anti")
    added = new.select(
        "id", "title", F.when(F.col("kind") == "pdf", "pdf").otherwise("doc").alias("source_type"), F.col("title").alias("source_ref"), "text", T.estimate_tokens(F.col("text")).alias("token_count"),
        "source_checksum", F.lit(at).cast("timestamp").alias("added_at"),
    )
    out = catalog.add_documents(documents, added)
    ready = F.col("error").isNull()
    artifact = state.where(ready).select("id", "text", "source_checksum", T.estimate_tokens(F.col("text")).alias("token_count"))
    out = catalog.set_artifact(out, artifact)
    out = catalog.set_status(out, state.select("id", F.when(ready, "ready").otherwise("failed").alias("index_status"), F.col("error").alias("index_error"), F.when(ready, F.col("n")).alias("chunk_count"), F.lit(at).cast("timestamp").alias("at")))
    indexed = made.join(state.where(ready).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    kept = catalog.replace_chunks(chunks, indexed.select(*[c for c in indexed.columns if c in chunks.columns]))
    outcomes = state.select("id", "title", F.when(ready, "ready").otherwise("failed").alias("status"), "error", F.when(ready, F.col("n")).otherwise(0).cast("long").alias("chunks"))
    refused = got.where("refused != ''").select("id", "title", F.lit("refused").alias("status"), F.col("refused").alias("error"), F.lit(0).cast("long").alias("chunks"))
    return out, kept, outcomes.unionByName(refused)
