"""Schemas of the engine's tables, and additive migration to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"BIGINT": LongType(), "INT": IntegerType(), "STRING": StringType(), "BOOLEAN": BooleanType(), "DOUBLE": DoubleType(), "TIMESTAMP": TimestampType()}


def _type(name: str) -> DataType:
    return ArrayType(_type(name[6:-1])) if name.startswith("ARRAY<") else _TYPES[name]


def struct(ddl: str) -> StructType:
    """A schema out of "name TYPE, ..."; unlike Spark's own parser it needs no session."""
    return StructType([StructField(n, _type(t)) for n, t in (f.split() for f in ddl.split(", "))])


DOCUMENTS = struct(
    "id BIGINT, title STRING, source_type STRING, source_ref STRING, text STRING, original_path STRING, source_checksum STRING, token_count BIGINT, "
    "is_active BOOLEAN, index_status STRING, index_error STRING, indexed_at TIMESTAMP, chunk_count BIGINT, effective_date STRING, valid_until STRING, "
    "superseded_by BIGINT, added_at TIMESTAMP, topic STRING, document_type STRING, lifecycle_status STRING"
)
CHUNKS = struct(
    "id BIGINT, document_id BIGINT, content STRING, section_header STRING, chunk_index INT, document_title STRING, document_ref STRING, "
    "effective_date STRING, topic STRING, page_start INT, page_end INT, embedding ARRAY<DOUBLE>"
)
CONVERSATIONS = struct("id BIGINT, session_id STRING, started_at TIMESTAMP")
MESSAGES = struct(
    "id BIGINT, conversation_id BIGINT, role STRING, content STRING, confidence STRING, response_time_ms BIGINT, input_tokens BIGINT, output_tokens BIGINT, "
    "cache_read_tokens BIGINT, cache_write_tokens BIGINT, cost_usd DOUBLE, created_at TIMESTAMP"
)
SETTINGS = struct("key STRING, value STRING, updated_at TIMESTAMP")
PARAMETERS = struct(
    "id BIGINT, parameter_key STRING, tax_year INT, value_text STRING, unit STRING, source_title STRING, source_url STRING, source_page STRING, "
    "source_type STRING, verified_at TIMESTAMP"
)
RETRIEVAL_CASES = struct("id STRING, category STRING, question STRING, relevant_documents ARRAY<STRING>, expected_documents ARRAY<STRING>, distractor_documents ARRAY<STRING>")
ANSWER_CASES = struct(
    "id STRING, category STRING, question STRING, expected_citation_prefixes ARRAY<STRING>, any_citation_prefixes ARRAY<STRING>, must_include ARRAY<STRING>, "
    "must_not_include ARRAY<STRING>, expected_conclusion ARRAY<STRING>, required_concepts ARRAY<STRING>, required_actions ARRAY<STRING>, "
    "requires_clarification BOOLEAN, clarification_terms ARRAY<STRING>"
)

#: Values that columns of documents have where an insert names none.
DOCUMENT_DEFAULTS = {"is_active": True, "index_status": "pending", "chunk_count": 0, "lifecycle_status": "current"}


def migrate(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with all columns of ``schema``: missing ones added, defaults where null."""
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        d = (defaults or {}).get(f.name)
        out.append((F.coalesce(c, F.lit(d).cast(f.dataType)) if d is not None else c).alias(f.name))
    return df.select(*out)
