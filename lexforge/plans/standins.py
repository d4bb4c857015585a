"""The engine's tables, made of the test tables; the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "1998-06-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ymd(c: str = "o_orderdate"):
    return F.date_format(c, "yyyy-M-d")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_chunks: all texts, five to a document, with a vector each; vectors go round, as there are fewer."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    i = F.col("doc_id")
    rows = d.join(e, e["vec_id"] == i % e.count()).withColumn("document_id", F.expr("doc_id div 5")).join(o, F.col("document_id") == F.col("o_orderkey"))
    return rows.select(
        i.alias("id"), "document_id", (i % 5).cast("int").alias("chunk_index"),
        F.concat("text", F.lit(" "), (i % 97).cast("string"), F.lit("%")).alias("content"), F.when(i % 7 == 0, F.concat(F.lit("סעיף "), (i % 5).cast("string"))).otherwise("").alias("section_header"),
        F.concat("source", F.lit(" "), _ymd()).alias("document_title"), F.col("source").alias("document_ref"), F.lit(None).cast("string").alias("effective_date"),
        F.when(i % 3 == 0, (i % 5 + 1).cast("int")).alias("page_start"), F.when(i % 3 == 0, (i % 5 + 1 + i % 2).cast("int")).alias("page_end"),
        "embedding",
    )


CHUNKS = """chunks AS (
  SELECT doc_id AS id, doc_id // 5 AS document_id, (doc_id % 5)::INT AS chunk_index, d.text || ' ' || (doc_id % 97)::VARCHAR || '%' AS content, CASE WHEN doc_id % 7 = 0 THEN 'סעיף ' || (doc_id % 5)::VARCHAR ELSE '' END AS section_header,
    d.source || ' ' || strftime(o_orderdate, '%Y-%-m-%-d') AS document_title, d.source AS document_ref, NULL::VARCHAR AS effective_date,
    CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5 + 1)::INT END AS page_start, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5 + 1 + doc_id % 2)::INT END AS page_end,
    embedding::DOUBLE[] AS embedding
  FROM documents d JOIN embeddings e ON e.vec_id = doc_id % (SELECT count(*) FROM embeddings) JOIN orders o ON o_orderkey = doc_id // 5
)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: those of the chunks, with states and dates by their ids."""
    c = chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n"), F.min_by("document_title", "id").alias("title"), F.min_by("document_ref", "id").alias("source_ref"), F.min_by("content", "id").alias("text"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    i = F.col("document_id")
    return c.join(o, i == F.col("o_orderkey")).select(
        i.alias("id"), "title", F.when(i % 6 == 0, "url").otherwise("pdf").alias("source_type"),
        F.when(i % 6 == 0, F.concat(F.lit("see https://example.org/d/"), i.cast("string"), F.lit(" `x`"))).otherwise(F.col("source_ref")).alias("source_ref"),
        F.when(i % 17 == 3, F.lit(None).cast("string")).when(i % 17 == 5, F.lit("")).otherwise(F.col("text")).alias("text"), (i * 37 % 5000).alias("token_count"), (i % 10 != 0).alias("is_active"),
        F.when(i % 9 == 0, "pending").when(i % 9 == 1, "failed").otherwise("ready").alias("index_status"), F.lit(None).cast("string").alias("index_error"), F.when(i % 11 == 0, F.lit(0).cast("long")).otherwise(F.col("n")).alias("chunk_count"),
        F.when(i % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("effective_date"), F.when(i % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(i % 3 == 1, F.lit("")).alias("valid_until"),
        F.when(i % 7 == 0, i + 1).alias("superseded_by"), F.col("o_orderdate").alias("added_at"), F.lit(None).cast("string").alias("topic"), F.when(i % 5 == 0, "חוק").alias("document_type"),
        F.lit("current").alias("lifecycle_status"),
    )


DOCUMENTS = """docs AS (
  SELECT i AS id, title, CASE WHEN i % 6 = 0 THEN 'url' ELSE 'pdf' END AS source_type,
    CASE WHEN i % 6 = 0 THEN 'see https://example.org/d/' || i::VARCHAR || ' `x`' ELSE source_ref END AS source_ref,
    CASE WHEN i % 17 = 3 THEN NULL WHEN i % 17 = 5 THEN '' ELSE text END AS text, i * 37 % 5000 AS token_count, i % 10 <> 0 AS is_active,
    CASE WHEN i % 9 = 0 THEN 'pending' WHEN i % 9 = 1 THEN 'failed' ELSE 'ready' END AS index_status, NULL::VARCHAR AS index_error,
    CASE WHEN i % 11 = 0 THEN 0 ELSE n END AS chunk_count,
    CASE WHEN i % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS effective_date,
    CASE WHEN i % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN i % 3 = 1 THEN '' END AS valid_until,
    CASE WHEN i % 7 = 0 THEN i + 1 END AS superseded_by, o_orderdate AS added_at, NULL::VARCHAR AS topic, CASE WHEN i % 5 = 0 THEN 'חוק' END AS document_type, 'current' AS lifecycle_status
  FROM (SELECT document_id AS i, count(*) AS n, arg_min(document_title, id) AS title, arg_min(document_ref, id) AS source_ref, arg_min(content, id) AS text FROM chunks GROUP BY 1)
  JOIN orders ON o_orderkey = i
)"""


def questions(spark: SparkSession, sf_dir: str, before: str = "''") -> DataFrame:
    """Questions: benchmark items with a date, a percentage and for some a section, after ``before`` (SQL); one or two vectors each."""
    b, e = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "embeddings")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    more = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" מותר סעיף "), (F.col("item_id") % 5).cast("string"))).otherwise("")
    q = F.concat(F.expr(before), "text", F.lit(" "), _ymd(), F.lit(" "), (F.col("item_id") * 11).cast("string"), F.lit("%"), more)
    vectors = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    other = vectors.select(F.col("vec_id").alias("other_id"), F.col("v").alias("w"))
    rows = b.join(vectors, b["item_id"] == vectors["vec_id"]).join(other, F.col("item_id") + 101 == F.col("other_id"), "left").join(o, F.col("item_id") * 3 == F.col("o_orderkey"))
    return rows.select(F.col("item_id").alias("query_id"), q.alias("question"), F.array_compact(F.array("v", "w")).alias("vectors"), q.alias("ranking_question"))


QUESTIONS = """questions AS (
  SELECT item_id AS query_id, {before} || b.text || ' ' || strftime(o_orderdate, '%Y-%-m-%-d') || ' ' || (item_id * 11)::VARCHAR || '%' || CASE WHEN item_id % 3 = 0 THEN ' מותר סעיף ' || (item_id % 5)::VARCHAR ELSE '' END AS question,
    list_filter([e.embedding::DOUBLE[], f.embedding::DOUBLE[]], lambda x: x IS NOT NULL) AS vectors
  FROM benchmark b JOIN embeddings e ON item_id = e.vec_id LEFT JOIN embeddings f ON item_id + 101 = f.vec_id JOIN orders ON o_orderkey = item_id * 3
)""".replace("{before}", "''")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(conv_id % 30 as int), cast(turn as int), 7)").alias("created_at"))


MESSAGES = """messages AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, role, text AS content,
    TIMESTAMP '2024-01-01 00:00:00' + to_days((conv_id % 30)::INT) + to_hours(turn::INT) + to_minutes(7) AS created_at
  FROM conversations
)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with costs: events, purchases being answers."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "assistant").otherwise("user").alias("role"), F.col("ts").alias("created_at"), F.col("value").alias("cost_usd"),
        k.alias("input_tokens"), (k * 2).alias("output_tokens"), (k * 3).alias("cache_read_tokens"), F.when(k % 2 == 0, k).alias("cache_write_tokens"), F.col("user_id").alias("conversation_id"),
    )


USAGE = """usage AS (
  SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'assistant' ELSE 'user' END AS role, ts AS created_at, value AS cost_usd, k AS input_tokens, k * 2 AS output_tokens,
    k * 3 AS cache_read_tokens, CASE WHEN k % 2 = 0 THEN k END AS cache_write_tokens, user_id AS conversation_id
  FROM (SELECT *, (props::JSON->>'$.k')::BIGINT AS k FROM events)
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same cases: labelled documents with scores by their ids."""
    d = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    i = F.col("doc_id")
    one = lambda name, m: d.select(
        F.lit(name).alias("run"), i.alias("id"), F.when(i % 13 != 0, F.col("lang")).alias("category"), (i % m == 0).alias("passed"), F.when(i % 29 == 0, "timeout").alias("error"),
        F.when(i % 29 != 0, (i % 5) / 4).alias("conclusion_score"), ((i % m) / m).alias("required_concepts_score"), ((i % 3) / 2).alias("actionability_score"), F.lit(1.0).alias("clarification_score"),
    )
    return one("base", 4).where(i % 31 != 0).unionByName(one("candidate", 3).where(i % 37 != 0))


RUNS = """runs AS (
  SELECT run, doc_id AS id, CASE WHEN doc_id % 13 <> 0 THEN lang END AS category, doc_id % m = 0 AS passed, CASE WHEN doc_id % 29 = 0 THEN 'timeout' END AS error,
    CASE WHEN doc_id % 29 <> 0 THEN (doc_id % 5) / 4.0::DOUBLE END AS conclusion_score, (doc_id % m) / m::DOUBLE AS required_concepts_score, (doc_id % 3) / 2.0::DOUBLE AS actionability_score,
    1.0::DOUBLE AS clarification_score
  FROM labels JOIN documents USING (doc_id), (VALUES ('base', 4, 31), ('candidate', 3, 37)) AS r(run, m, gap) WHERE doc_id % gap <> 0
)"""
