"""Registered queries of the engine's operators on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules as L, text as T
from ..functions.tokens import ESTIMATE as T_ESTIMATE
from ..operators import analytics as A, audit, catalog as M, chunking as K, context as C, evaluation as E, ranking as R
from ..scratch import scratch_path
from ..session import ship, sliced
from ..sources import files as S, pdf
from . import standins as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A section pattern that occurs in the test tables, in place of the default one.
LINE_START = r"[A-ZÀ-Þ]"
AS_OF = "2024-01-30"
FORCED = {"all": ["the"], "markers": ["thst", " 11%"]}
EXPANSIONS = [
    {"all": ["the"], "groups": [("a", ["inst", "ther"]), ("b", ["erth"]), ("c", ["edon"])], "least": 2, "query": "{label} about the rest"},
    {"all": ["to", "in"], "queries": ["one more", "and another"]},
]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace({0}, '\n{{3,}}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'), '^[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]+|[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]+$', '', 'g')"
_TOKENS = "(CASE WHEN octet_length(encode(coalesce({0}, ''))) = 0 THEN 0 ELSE greatest(floor(octet_length(encode({0})) * 0.7::DOUBLE)::BIGINT, 1) END)"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_\x{{0590}}-\x{{05FF}}]+')"

# -- scalar functions ------------------------------------------------------


@query(rf"SELECT doc_id, {_CLEAN.format('messy')} AS cleaned FROM (SELECT doc_id, E' \t' || replace(replace(text, ' ', '  '), E'\n', E'\n\n\n\n') || E'\n ' AS messy FROM documents)")
def f01_clean_text(spark, sf_dir):
    messy = F.concat(F.lit(" \t"), F.replace(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("\n\n\n\n")), F.lit("\n "))
    return X.read(spark, sf_dir, "documents").select("doc_id", T.clean_text(messy).alias("cleaned"))


@query(f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents")
def f02_estimate_tokens(spark, sf_dir):
    return X.read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def _stop_list() -> str:
    from ..functions.rules import STOP_WORDS

    return "[" + ", ".join("'" + w + "'" for w in STOP_WORDS) + "]"


_TOKENIZED = "list_filter(" + _WORDS + ", lambda w: length(w) > 1 AND NOT list_contains(" + _stop_list().replace("{", "{{").replace("}", "}}") + ", w))"


@query(f"SELECT doc_id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_TOKENIZED.format('text')} AS t FROM documents)")
def f03_tokenize(spark, sf_dir):
    d = X.read(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(rf"SELECT item_id, array_to_string(list_filter({_WORDS.format('text')}, lambda w: length(w) > 2 AND NOT regexp_full_match(w, '\p{{N}}+')), ' ') AS tokens FROM benchmark")
def f04_query_tokens(spark, sf_dir):
    return X.read(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.query_tokens(F.col("text")), " ").alias("tokens"))


@query(r"""SELECT p_partkey, CASE WHEN length(p_name) > 3 AND list_contains(['r', 's', 'b'], p_name[1]) THEN p_name || '|' || p_name[2:] ELSE p_name END AS variants FROM part""")
def f05_variants(spark, sf_dir):
    return X.read(spark, sf_dir, "part").select("p_partkey", F.array_join(T.variants(F.col("p_name"), "rsb"), "|").alias("variants"))


@query(_with(X.CHUNKS) + r"SELECT id, array_to_string(regexp_extract_all(lower(content), '\d+%'), ' ') AS percentages, array_to_string(regexp_extract_all(lower(document_title), '\d{4}-\d+-\d+'), ' ') AS circulars FROM chunks")
def f06_references(spark, sf_dir):
    c = X.chunks(spark, sf_dir)
    return c.select("id", F.array_join(T.references(F.col("content"), r"\d+%"), " ").alias("percentages"), F.array_join(T.references(F.col("document_title"), r"\d{4}-\d+-\d+"), " ").alias("circulars"))


@query(r"SELECT page_id, nullif(regexp_extract('at `' || url || '` and http://b.c', 'https?://[^\s`]+'), '') AS url FROM pages")
def f07_first_url(spark, sf_dir):
    return X.read(spark, sf_dir, "pages").select("page_id", T.first_url(F.concat(F.lit("at `"), "url", F.lit("` and http://b.c"))).alias("url"))


_LINKS = "CASE WHEN p_partkey % 4 = 0 THEN 'https://drive.example/file/d/A_' || p_partkey || '-x/view' WHEN p_partkey % 4 = 1 THEN 'https://drive.example/open?id=B' || p_partkey || '&y' WHEN p_partkey % 4 = 2 THEN 'https://drive.example/d/C' || p_partkey || '/edit' ELSE 'none' END"


@query(rf"SELECT p_partkey, coalesce(nullif(regexp_extract(u, '/file/d/([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(u, 'id=([a-zA-Z0-9_-]+)', 1), ''), nullif(regexp_extract(u, '/d/([a-zA-Z0-9_-]+)', 1), '')) AS file_id FROM (SELECT p_partkey, {_LINKS} AS u FROM part)")
def f08_drive_id(spark, sf_dir):
    return X.read(spark, sf_dir, "part").select("p_partkey", T.drive_id(F.expr(_LINKS)).alias("file_id"))


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  strftime(try_strptime(replace(replace(regexp_extract(t, '(^|[^0-9])(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})([^0-9]|$)', 2), '/', '-'), '.', '-'), '%Y-%m-%d'), '%Y-%m-%d') AS iso
  FROM (SELECT *, 'circular ' || (1990 + l_partkey % 40)::VARCHAR || '/' || (l_suppkey % 15)::VARCHAR || '.' || (l_partkey % 33)::VARCHAR || ' of' AS t FROM lineitem)""")
def f09_title_date(spark, sf_dir):
    t = F.concat(F.lit("circular "), (1990 + F.col("l_partkey") % 40).cast("string"), F.lit("/"), (F.col("l_suppkey") % 15).cast("string"), F.lit("."), (F.col("l_partkey") % 33).cast("string"), F.lit(" of"))
    return X.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.title_date(t).alias("iso"))


@query(r"SELECT o_orderkey, coalesce(try_cast(nullif(regexp_extract('in ' || strftime(o_orderdate, '%Y') || ' or x' || o_orderkey, '\b(20\d{2})\b', 1), '') AS INT), 2024) AS year FROM orders")
def f10_question_year(spark, sf_dir):
    q = F.concat(F.lit("in "), F.date_format("o_orderdate", "yyyy"), F.lit(" or x"), F.col("o_orderkey").cast("string"))
    return X.read(spark, sf_dir, "orders").select("o_orderkey", T.question_year(q, F.lit(2024)).alias("year"))


@query(r"""SELECT p_partkey, coalesce(nullif(regexp_extract(t, '([\d,]+)\s+top deposit', 1), ''), nullif(regexp_extract(t, 'top deposit\s+([\d,]+)', 1), '')) AS amount
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a 12,' || p_partkey || ' top deposit 9' WHEN p_partkey % 3 = 1 THEN 'top deposit ' || p_partkey || ' b' ELSE 'none' END AS t FROM part)""")
def f11_amount(spark, sf_dir):
    t = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'a 12,' || p_partkey || '\\n top  deposit 9' WHEN p_partkey % 3 = 1 THEN 'top deposit\\t' || p_partkey || ' b' ELSE 'none' END")
    return X.read(spark, sf_dir, "part").select("p_partkey", T.amount_by_phrase(t, "top deposit").alias("amount"))


@query(r"""SELECT event_id, upper(nullif(regexp_extract(t, '(?i)CONFIDENCE:\s*(HIGH|MEDIUM|LOW)', 1), '')) AS confidence FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x Confidence:  high y' WHEN 1 THEN 'CONFIDENCE:low' WHEN 2 THEN 'confidence: none medium' ELSE 'a CONFIDENCE: Medium CONFIDENCE: LOW' END AS t FROM events)""")
def f12_confidence(spark, sf_dir):
    t = F.expr("CASE event_id % 4 WHEN 0 THEN 'x Confidence:  high y' WHEN 1 THEN 'CONFIDENCE:low' WHEN 2 THEN 'confidence: none medium' ELSE 'a CONFIDENCE: Medium CONFIDENCE: LOW' END")
    return X.read(spark, sf_dir, "events").select("event_id", T.confidence(t).alias("confidence"))


@query(r"SELECT doc_id, lower(trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g'))) AS normal FROM documents")
def f13_normalize(spark, sf_dir):
    return X.read(spark, sf_dir, "documents").select("doc_id", T.normalize(F.concat(F.lit("\n "), "text", F.lit(" "))).alias("normal"))


_CITE = "'D' || document_id || '-' || CASE WHEN page_start IS NULL OR page_end IS NULL THEN 'C' || (chunk_index + 1) WHEN page_start = page_end THEN 'P' || page_start ELSE 'P' || page_start || '-' || page_end END"


@query(_with(X.CHUNKS) + f"SELECT id, {_CITE} AS citation FROM chunks")
def f14_citation(spark, sf_dir):
    c = X.chunks(spark, sf_dir)
    return c.select("id", T.citation(F.col("document_id"), F.col("chunk_index"), F.col("page_start"), F.col("page_end")).alias("citation"))


_STATUS = f"(CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN coalesce(valid_until, '') <> '' AND valid_until < '{X.AS_OF}' THEN 'expired' ELSE 'current' END)"
_HEADER = "concat_ws(' | ', '=== ' || {t}, nullif({r}, ''), 'תוקף: ' || nullif({e}, ''), CASE {s} WHEN 'superseded' THEN '[הוחלף במסמך עדכני]' WHEN 'expired' THEN '[פג תוקף]' END) || ' ==='"


@query(_with(X.CHUNKS, X.DOCUMENTS) + f"SELECT id, {_HEADER.format(t='title', r='source_ref', e='effective_date', s=_STATUS)} AS header FROM docs")
def f15_header(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    status = T.validity(F.col("superseded_by"), F.col("valid_until"), F.lit(X.AS_OF))
    return d.select("id", T.header(F.col("title"), F.col("source_ref"), F.col("effective_date"), status).alias("header"))


_COSTS = {k: f"coalesce({k}_tokens, 0) * 4000 / 1e6::DOUBLE * {L.PRICES[k]}::DOUBLE" for k in ("input", "output", "cache_read", "cache_write")}


@query(_with(X.USAGE) + f"SELECT id, round({_COSTS['input']} + {_COSTS['output']}, 6) AS cost, {', '.join(f'round({v}, 6) AS {k}_cost' for k, v in _COSTS.items())}, round({' + '.join(_COSTS.values())}, 6) AS total FROM usage")
def f24_f25_costs(spark, sf_dir):
    u = X.usage(spark, sf_dir)
    n = {k: F.col(f"{k}_tokens") * 4000 for k in _COSTS}
    return u.select("id", T.cost(n["input"], n["output"]).alias("cost"), T.cost_parts(n).alias("p")).select("id", "cost", "p.*")


@query("SELECT p_partkey, CASE WHEN contains(f, '.') THEN lower(split_part(f, '.', -1)) ELSE '' END AS ext, coalesce(nullif(regexp_replace(lower(CASE WHEN contains(f, '.') THEN lower(split_part(f, '.', -1)) ELSE '' END), '[^a-z0-9]', '', 'g'), ''), 'bin') AS safe, sha256(f) AS checksum FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '.P-' || p_type END AS f FROM part)")
def s12_original(spark, sf_dir):
    p = X.read(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || '.P-' || p_type END").alias("f"))
    x = S.stored_original(F.encode("f", "utf-8"), T.extension(F.col("f")))
    return p.select("p_partkey", T.extension(F.col("f")).alias("ext"), x["extension"].alias("safe"), x["checksum"].alias("checksum"))


@query(_with(X.CHUNKS, X.DOCUMENTS) + f"SELECT id, {_STATUS} AS validity, CASE WHEN index_status <> '' THEN index_status WHEN chunk_count > 0 THEN 'ready' ELSE 'unknown' END AS status FROM docs")
def p04_validity(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    return d.select("id", T.validity(F.col("superseded_by"), F.col("valid_until"), F.lit(X.AS_OF)).alias("validity"), T.index_status(F.col("index_status"), F.col("chunk_count")).alias("status"))


@query("SELECT conv_id, turn, n >= 2 AND (len(string_split_regex(trim(text), '\\s+')) <= 12 OR starts_with(text, 'The')) AS follow_up FROM conversations JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) USING (conv_id)")
def p12_follow_up(spark, sf_dir):
    c = X.read(spark, sf_dir, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.join(n, "conv_id").select("conv_id", "turn", T.is_follow_up(F.col("text"), F.col("n"), markers=["The"]).alias("follow_up"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short FROM documents")
def f36_shortened(spark, sf_dir):
    return X.read(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text")).alias("short"))


# -- retrieval ---------------------------------------------------------------

_SCORES = """scored AS (
  SELECT * EXCLUDE (sims), list_max(sims) + 0.01::DOUBLE * greatest(len(list_filter(sims, lambda x: x >= 0.35::DOUBLE)) - 1, 0) AS score FROM (
    SELECT query_id, question, c.*, list_transform(vectors, lambda v: list_dot_product(v, embedding) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(embedding, embedding)) + 1e-10::DOUBLE)) AS sims
    FROM questions, (SELECT c.*, validity_status, document_type FROM chunks c JOIN (SELECT id AS did, """ + _STATUS + """ AS validity_status, document_type FROM docs WHERE is_active) d ON document_id = did) c)
)"""  # fmt: skip

_PERCENT = r"regexp_extract_all(lower(question), '\d+%')"
_CIRCULAR = r"regexp_extract_all(lower(question), '\d{4}-\d+-\d+')"
_QTOKENS = rf"list_filter({_WORDS.format('question')}, lambda w: length(w) > 2 AND NOT regexp_full_match(w, '\p{{N}}+'))"
_SECTIONS = r"regexp_extract_all(lower(question), 'סעיף\s+\d+')"
_PREFIXED = "(contains({0}, x) OR length(x) > 3 AND list_contains(['ו', 'ה', 'ב', 'כ', 'ל', 'מ', 'ש'], x[1]) AND contains({0}, x[2:]))"
_LEXICAL = f"""lexed AS (
  SELECT *, list_reduce(list_transform(toks, lambda x: [CASE WHEN {_PREFIXED.format('title_l')} THEN 5.0::DOUBLE ELSE 0 END, CASE WHEN {_PREFIXED.format('ref_l')} THEN 3.0::DOUBLE ELSE 0 END, CASE WHEN {_PREFIXED.format('content_l')} THEN 0.2::DOUBLE ELSE 0 END]),
    lambda a, x: [a[1] + x[1] + x[2] + x[3], 0.0::DOUBLE, 0.0::DOUBLE], [base, 0.0::DOUBLE, 0.0::DOUBLE])[1] AS lexical
  FROM (
    SELECT *, coalesce(list_sum(list_transform({_CIRCULAR}, lambda x: CASE WHEN contains(title_l, x) OR contains(ref_l, x) THEN 100.0::DOUBLE ELSE 0 END)), 0)
      + coalesce(list_sum(list_transform({_SECTIONS}, lambda x: CASE WHEN contains(title_l, x) OR contains(ref_l, x) OR contains(section_header, x) OR contains(content_l, x) THEN 50.0::DOUBLE ELSE 0 END)), 0)
      + coalesce(list_sum(list_transform({_PERCENT}, lambda x: CASE WHEN contains(content_l, x) THEN 20.0::DOUBLE ELSE 0 END)), 0) AS base, {_QTOKENS} AS toks
    FROM (SELECT *, lower(document_title) AS title_l, lower(document_ref) AS ref_l, lower(content) AS content_l FROM scored)
  )
)"""
_FUSED = """fused AS (
  SELECT *, 1 / (60 + dense_rank)::DOUBLE + 1 / (60 + lexical_rank)::DOUBLE + 0.01::DOUBLE * lexical + CASE WHEN contains(question, 'מותר') AND document_type = 'חוק' THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END
    - CASE WHEN validity_status IN ('superseded', 'expired') THEN 0.001::DOUBLE ELSE 0 END AS fused
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS dense_rank, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, document_id, chunk_index) AS lexical_rank FROM lexed)
), capped AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, document_id, chunk_index) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY fused DESC, document_id, chunk_index) AS nth FROM fused) WHERE nth <= 3
)"""
_RETRIEVAL = (X.CHUNKS, X.DOCUMENTS, X.QUESTIONS, _SCORES, _LEXICAL, _FUSED)


def _scored(spark, sf_dir, forced=FORCED):
    return R.scores(X.questions(spark, sf_dir), R.joined(X.chunks(spark, sf_dir), X.documents(spark, sf_dir), X.AS_OF), forced=forced)


def _fused(spark, sf_dir, keep, packed=False):
    chunks = R.joined(X.chunks(spark, sf_dir), X.documents(spark, sf_dir), X.AS_OF)
    return R.fuse(R.score_blocks(X.questions(spark, sf_dir), chunks, forced=FORCED), packed=packed, keep=keep)


def _id():
    return (F.col("document_id") * 5 + F.col("chunk_index")).alias("id")


@query(_with(X.CHUNKS, X.DOCUMENTS, X.QUESTIONS, _SCORES) + "SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index)::INT AS dense_rank FROM scored")
def r02_dense_scores(spark, sf_dir):
    return R.dense_ranked(_scored(spark, sf_dir)).select("query_id", _id(), F.round("score", 6).alias("score"), "dense_rank")


@query(_with(X.CHUNKS, X.DOCUMENTS, X.QUESTIONS, _SCORES, _LEXICAL) + "SELECT query_id, id, round(lexical, 6) AS lexical FROM lexed")
def r03_lexical(spark, sf_dir):
    return _scored(spark, sf_dir).select("query_id", _id(), F.round("lexical", 6).alias("lexical"))


@query(_with(*_RETRIEVAL) + "SELECT query_id, id, dense_rank::INT AS dense_rank, lexical_rank::INT AS lexical_rank, round(fused, 6) AS fused FROM fused")
def r04_fused(spark, sf_dir):
    return _fused(spark, sf_dir, ("dense_rank", "lexical_rank", "fused")).select("query_id", _id(), "dense_rank", "lexical_rank", F.round("fused", 6).alias("fused"))


@query(_with(*_RETRIEVAL) + "SELECT query_id, document_id, chunk_index, place::INT AS rank, round(fused, 6) AS fused FROM capped")
def r05_document_cap(spark, sf_dir):
    return R.cap(_fused(spark, sf_dir, ("fused", "nth"), packed=True)).select("query_id", "document_id", "chunk_index", "rank", F.round("fused", 6).alias("fused"))


def hybrid(spark, sf_dir, questions=None):
    documents = X.documents(spark, sf_dir).withColumn("effective_date", F.lit(None).cast("string"))
    return R.retrieve(questions or X.questions(spark, sf_dir), X.chunks(spark, sf_dir), documents, as_of=X.AS_OF)


_TOP = "SELECT query_id, place::INT AS rank, document_id, chunk_index, document_title, round(score, 6) AS score, round(lexical, 6) AS lexical, round(fused, 6) AS fused FROM capped WHERE place <= "


def _shown(r: DataFrame) -> DataFrame:
    return r.select("query_id", F.col("rank").cast("int").alias("rank"), "document_id", "chunk_index", "document_title", *(F.round(c, 6).alias(c) for c in ("score", "lexical", "fused")))


@query(_with(*_RETRIEVAL) + _TOP + "20")
def hybrid_topk(spark, sf_dir):
    return _shown(hybrid(spark, sf_dir))


@query(_with(*_RETRIEVAL) + _TOP + "3 + query_id % 4")
def r13_own_k(spark, sf_dir):
    return _shown(hybrid(spark, sf_dir, X.questions(spark, sf_dir).withColumn("k", (F.col("query_id") % 4 + 3).cast("int"))))


@query("""SELECT item_id, array_to_string(q, ' / ') AS queries FROM (
  SELECT item_id, [text] || CASE WHEN contains(l, 'the') AND len(h) >= 2 THEN h ELSE [] END || CASE WHEN contains(l, 'to') AND contains(l, 'in') THEN ['one more', 'and another'] ELSE [] END AS q
  FROM (SELECT *, list_filter([CASE WHEN contains(l, 'inst') OR contains(l, 'ther') THEN 'a about the rest' END, CASE WHEN contains(l, 'erth') THEN 'b about the rest' END, CASE WHEN contains(l, 'edon') THEN 'c about the rest' END], lambda x: x IS NOT NULL) AS h
    FROM (SELECT *, lower(text) AS l FROM benchmark)))""")
def r01_expand(spark, sf_dir):
    b = X.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return R.expand(b, EXPANSIONS).select("item_id", F.array_join("queries", " / ").alias("queries"))


_FORCED = """forced AS (
  SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY document_id DESC, chunk_index DESC) AS spot FROM fused f
  WHERE contains(lower(question), 'the') AND (contains(lower(content), 'thst') OR contains(lower(content), ' 11%')) AND NOT EXISTS (SELECT 1 FROM capped c WHERE c.query_id = f.query_id AND c.id = f.id)
), final AS (
  SELECT query_id, document_id, chunk_index, spot AS rank, true AS forced FROM forced
  UNION ALL SELECT c.query_id, document_id, chunk_index, place + coalesce(n, 0), false FROM capped c LEFT JOIN (SELECT query_id, count(*) AS n FROM forced GROUP BY 1) m ON m.query_id = c.query_id
)"""


@query(_with(*_RETRIEVAL, _FORCED) + "SELECT query_id, document_id, chunk_index, rank::BIGINT AS rank, forced FROM final")
def r06_forced(spark, sf_dir):
    return R.cap_and_force(_fused(spark, sf_dir, ("fused", "nth", "marked"), packed=True)).select("query_id", "document_id", "chunk_index", F.col("rank").cast("long").alias("rank"), "forced")


@query(_with(*_RETRIEVAL) + "SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY first)::INT AS position FROM (SELECT query_id, document_id, min(place) AS first FROM capped WHERE place <= 20 GROUP BY ALL)")
def r08_ranked_documents(spark, sf_dir):
    return R.ranked_documents(hybrid(spark, sf_dir)).select("query_id", "document_id", "position")


_NEAR = """near AS (SELECT DISTINCT query_id, document_id, unnest([chunk_index - 1, chunk_index, chunk_index + 1])::INT AS chunk_index FROM capped WHERE place <= 20),
found AS (SELECT n.query_id, c.*, p.place, p.status FROM near n JOIN chunks c USING (document_id, chunk_index) JOIN (SELECT query_id, document_id, min(place) AS place, arg_max(validity_status, place) AS status FROM capped WHERE place <= 20 GROUP BY ALL) p ON p.query_id = n.query_id AND p.document_id = n.document_id)"""


@query(_with(*_RETRIEVAL, _NEAR) + "SELECT query_id, document_id, chunk_index FROM found")
def j08_neighbours(spark, sf_dir):
    return C.expanded(hybrid(spark, sf_dir), X.chunks(spark, sf_dir)).select("query_id", "document_id", "chunk_index")


_BLOCK = f"'[[SOURCE ' || {_CITE} || ' | מסמך: ' || document_title || ' | ' || CASE WHEN page_start IS NULL OR page_end IS NULL THEN 'עמוד לא זמין במאגר הישן' WHEN page_start = page_end THEN 'עמוד ' || page_start ELSE 'עמודים ' || page_start || '-' || page_end END || ' | סעיף: ' || CASE WHEN section_header = '' THEN 'קטע ללא כותרת' ELSE section_header END || ' | URL: ' || document_ref || ']]' || chr(10) || content || chr(10) || '[[/SOURCE ' || {_CITE} || ']]'"
_BLOCKS = f"""blocks AS (
  SELECT query_id, flatten(list(b ORDER BY place)) AS blocks FROM (
    SELECT query_id, place, [arg_min({_HEADER.format(t='document_title', r='document_ref', e='effective_date', s='status')}, chunk_index)] || list({_BLOCK} ORDER BY chunk_index) AS b FROM found GROUP BY query_id, document_id, place)
  GROUP BY query_id
)"""


@query(_with(*_RETRIEVAL, _NEAR, _BLOCKS) + "SELECT query_id, len(blocks)::INT AS n, array_to_string(blocks, chr(10) || chr(10)) AS blocks FROM blocks")
def r10_blocks(spark, sf_dir):
    b = C.blocks(C.expanded(hybrid(spark, sf_dir), X.chunks(spark, sf_dir)))
    return b.select("query_id", F.size("blocks").alias("n"), F.array_join("blocks", "\n\n").alias("blocks"))


@query(_with(*_RETRIEVAL, _NEAR, _BLOCKS) + f"""SELECT query_id, array_to_string(list_reduce(list_transform(blocks, lambda x: {{'used': 0::BIGINT, 'kept': [x]}}),
  lambda a, x: CASE WHEN a.used + {_TOKENS.format('x.kept[1]')} <= 9000 THEN {{'used': a.used + {_TOKENS.format('x.kept[1]')}, 'kept': a.kept || x.kept}} ELSE a END, {{'used': 0::BIGINT, 'kept': []::VARCHAR[]}}).kept, chr(10) || chr(10)) AS context FROM blocks""")
def r11_budget(spark, sf_dir):
    return C.context(hybrid(spark, sf_dir), X.chunks(spark, sf_dir), budget=9000)


@query(_with(*_RETRIEVAL, _NEAR, _BLOCKS) + rf"""SELECT query_id, 'Answer.' || chr(10) || chr(10) || '---' || chr(10) || 'מקורות שנשלפו:' || chr(10) || array_to_string(list_transform(range(1, least(8, len(ids)) + 1), lambda i: '* [' || ids[i] || '] ' || txt[list_position(alls, ids[i])]), chr(10)) AS answer FROM (
  SELECT query_id, list_filter(alls, lambda x, i: list_position(alls, x) = i) AS ids, alls, txt FROM (
    SELECT query_id, regexp_extract_all(c, '\[\[SOURCE (D[^|\s]+) \| ([^\]]+)\]\]', 1) AS alls, regexp_extract_all(c, '\[\[SOURCE (D[^|\s]+) \| ([^\]]+)\]\]', 2) AS txt FROM (SELECT query_id, array_to_string(blocks, chr(10) || chr(10)) AS c FROM blocks)))""")
def r15_sources(spark, sf_dir):
    b = C.blocks(C.expanded(hybrid(spark, sf_dir), X.chunks(spark, sf_dir)))
    return b.select("query_id", C.with_sources(F.lit("Answer. \n"), F.array_join("blocks", "\n\n")).alias("answer"))


_TF = f"""tf AS (
  SELECT query_id, doc_id AS document_id, round(sum(times * (c / n::DOUBLE) * least(length(word) / 3.0::DOUBLE, 2.0::DOUBLE)), 9) AS score
  FROM (SELECT doc_id, n, word, count(*) AS c FROM (SELECT doc_id, len(t) AS n, unnest(t) AS word FROM (SELECT doc_id, {_TOKENIZED.format('text')} AS t FROM documents)) GROUP BY ALL)
  JOIN (SELECT query_id, word, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENIZED.format('text')}) AS word FROM benchmark) GROUP BY ALL) USING (word) GROUP BY ALL
)"""


def _tf(spark, sf_dir, keep=()):
    title = F.concat("source", F.lit("#"), F.col("doc_id").cast("string"))
    d = X.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", title.alias("title"), T_ESTIMATE.of(F.col("text")).alias("tokens"))
    b = X.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return d, R.term_scores(b, d, keep).withColumn("score", F.round("score", 9))


@query(_with(_TF) + "SELECT query_id, document_id, round(score, 6) AS score FROM tf")
def f20_term_scores(spark, sf_dir):
    return _tf(spark, sf_dir)[1].select("query_id", "document_id", F.round("score", 6).alias("score"))


_PACKED = f"""docs_of AS (
  SELECT query_id, document_id, source || '#' || document_id AS title, text, score, {_TOKENS.format('text')} AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS place
  FROM tf JOIN documents ON doc_id = document_id
)"""


_PLACES = f"""fold AS (
  SELECT query_id, 0::BIGINT AS place, 0::BIGINT AS used, 0::BIGINT AS document_id, ''::VARCHAR AS title, NULL::BIGINT AS n_chars, false AS skipped FROM (SELECT DISTINCT query_id FROM docs_of)
  UNION ALL
  SELECT query_id, place, used + CASE WHEN tokens <= room THEN tokens WHEN n > 500 THEN {_TOKENS.format('substr(text, 1, n)')} ELSE 0 END, document_id,
    CASE WHEN tokens > room AND n > 500 THEN title || ' (קטוע)' ELSE title END, CASE WHEN tokens <= room THEN length(text) WHEN n > 500 THEN n + {len(L.CUT_TEXT)} END, tokens > room AND coalesce(n, 0) <= 500
  FROM (
    SELECT *, CASE WHEN tokens > room AND room > 3000 AND score > 0 THEN list_filter(list_reduce(range(60), lambda a, i: a || [floor(a[len(a)] * 0.8::DOUBLE)::BIGINT], [floor(length(text) * (room / tokens::DOUBLE) * 0.8::DOUBLE)::BIGINT]),
      lambda c: c <= 500 OR {_TOKENS.format('substr(text, 1, c)')} <= room)[1] END AS n
    FROM (SELECT f.query_id, d.place, f.used, 20000 - f.used AS room, d.document_id, d.title, d.text, d.score, d.tokens FROM fold f JOIN docs_of d ON d.query_id = f.query_id AND d.place = f.place + 1))
)"""


@query("WITH RECURSIVE " + _TF + ", " + _PACKED + ", " + _PLACES + " SELECT query_id, place, document_id, title, n_chars::INT AS n_chars, skipped FROM fold WHERE place > 0")
def r12_pack_documents(spark, sf_dir):
    d, s = _tf(spark, sf_dir, ("title", "tokens"))
    return C.pack_documents(s, 20_000, texts=d).select("query_id", "place", "document_id", "title", F.length("text").alias("n_chars"), "skipped")


def _parameters(spark, sf_dir):
    return X.read(spark, sf_dir, "region").select(
        F.lit("k").alias("parameter_key"), (F.col("r_regionkey") + 1999).alias("tax_year"), F.concat(F.lit("value "), F.col("r_regionkey").cast("string")).alias("value_text"), F.lit("u").alias("unit"),
        F.col("r_name").alias("source_title"), F.lit("http://x/").alias("source_url"), F.when(F.col("r_regionkey") % 2 == 0, "12").alias("source_page"), F.when(F.col("r_regionkey") == 1, "web").alias("source_type"),
    )


def _parameter_block() -> str:
    """The block of a parameter in SQL."""
    of = {
        "tax_year": "yy", "value_text": "'value ' || v", "parameter_key": "'k'", "unit": "'u'", "source_title": "r_name", "source_url": "'http://x/'",
        "source_page": f"CASE WHEN v % 2 = 0 THEN '12' ELSE '{L.PARAMETER_NO_PAGE}' END", "source_type": f"CASE WHEN v = 1 THEN 'web' ELSE '{L.PARAMETER_SOURCE_TYPE}' END",
    }
    out = "'" + L.PARAMETER_BLOCK.replace("\n", "' || chr(10) || '") + "'"
    for name, value in of.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_PARAMETER_ASKED = {"key": "k", "subject": "fund", "terms": ["how much"]}


@query(f"""SELECT o_orderkey, y AS tax_year, CASE WHEN v IS NOT NULL THEN {_parameter_block()} END AS parameter_context FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(try_cast(nullif(regexp_extract(strftime(o_orderdate, '%Y'), '^(20\\d{{2}})$', 1), '') AS INT), 2024) END AS y FROM orders) LEFT JOIN (SELECT 1999 + r_regionkey AS yy, r_regionkey AS v, r_name FROM region) ON y = yy""")
def j14_parameter_lookup(spark, sf_dir):
    q = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "about the fund, how much in ").otherwise("hello "), F.date_format("o_orderdate", "yyyy"))
    o = X.read(spark, sf_dir, "orders").select("o_orderkey", q.alias("question"))
    return C.parameter_context(o, _parameters(spark, sf_dir), 2024, **_PARAMETER_ASKED).select("o_orderkey", "tax_year", "parameter_context")


_MORE = "(CASE WHEN item_id % 4 = 1 THEN 'תפרט ' WHEN item_id % 4 = 2 THEN 'how much is in the fund 2001 ' ELSE '' END)"
_NEAR_FEW = _NEAR.replace("place <= 20", "place <= CASE WHEN query_id % 4 = 1 THEN 5 ELSE 20 END")


def _context_sql(budget: int) -> str:
    return f"""array_to_string(list_reduce(list_transform(blocks, lambda x: {{'used': 0::BIGINT, 'kept': [x]}}),
      lambda a, x: CASE WHEN a.used + {_TOKENS.format('x.kept[1]')} <= {budget} THEN {{'used': a.used + {_TOKENS.format('x.kept[1]')}, 'kept': a.kept || x.kept}} ELSE a END, {{'used': 0::BIGINT, 'kept': []::VARCHAR[]}}).kept, chr(10) || chr(10))"""


@query(_with(X.CHUNKS, X.DOCUMENTS, X.QUESTIONS.replace("'' || b.text", _MORE + " || b.text"), _SCORES, _LEXICAL, _FUSED, _NEAR_FEW, _BLOCKS) + f"""SELECT query_id, query_id % 4 = 1 AS follow_up,
  CASE WHEN context = '' THEN question WHEN query_id % 4 = 1 THEN '{L.FOLLOW_UP_EVIDENCE}' || chr(10) || context || chr(10) || chr(10) || '{L.FOLLOW_UP_QUESTION}: ' || question ELSE '{L.EVIDENCE}' || chr(10) || chr(10) || context || chr(10) || chr(10) || question END AS message,
  'be exact' || chr(10) || chr(10) || 'cite' AS instructions
  FROM (SELECT query_id, question, concat_ws(chr(10) || chr(10), CASE WHEN query_id % 4 = 2 THEN (SELECT {_parameter_block()} FROM (SELECT 1999 + r_regionkey AS yy, r_regionkey AS v, r_name FROM region) WHERE yy = 2001) END, nullif({_context_sql(9000)}, '')) AS context FROM questions LEFT JOIN blocks USING (query_id))""")
def h02_answer_context(spark, sf_dir):
    q = X.questions(spark, sf_dir, _MORE).withColumn("messages", F.lit(2))
    documents = X.documents(spark, sf_dir).withColumn("effective_date", F.lit(None).cast("string"))
    out = C.answer_context(q, X.chunks(spark, sf_dir), documents, _parameters(spark, sf_dir), X.AS_OF, instructions=" be exact\n", contract="cite ", budget=9000, parameter=_PARAMETER_ASKED)
    return out.select("query_id", "follow_up", "message", "instructions")


# -- chunking ------------------------------------------------------------------

_STRIP = r"regexp_replace({0}, '^[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]+|[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x1c-\x1f]+$', '', 'g')"


@query(
    rf"""WITH found AS (SELECT doc_id, text, string_split(regexp_replace(text, '(?m)((?:^|\n)[A-ZÀ-Þ])', chr(57344) || '\1', 'g'), chr(57344))[2:] AS found FROM documents),
  s AS (SELECT doc_id, unnest(found) AS x, generate_subscripts(found, 1) AS i FROM found WHERE len(found) >= 3),
  kept AS (SELECT doc_id, i, regexp_extract(x, '^\n?([A-ZÀ-Þ])', 1) AS section_header, {_STRIP.format('x')} AS content FROM s)
SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT - 1 AS chunk_index, section_header, content FROM kept WHERE length(content) >= 40
UNION ALL SELECT doc_id, 0, 'קטע 1', text FROM found WHERE len(found) < 3 AND trim(text) <> ''"""
)
def k01_sections(spark, sf_dir):
    d = X.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return K.chunk_documents(d, start=LINE_START, most=1 << 40)


def _split_sql(source: str, keys: str, most: int, overlap: int) -> str:
    """Recursive tables ``walk`` and ``pieces`` (keys, part from 0, content) of K03 for rows (keys, text)."""
    room = T_ESTIMATE.room(most)
    key = keys.split(", ")
    same = " AND ".join(f"w.{k} = s.{k}" for k in key)
    return f"""sized AS (
  SELECT *, list_transform(words, lambda x: octet_length(encode(x))) AS n, list_transform(range(1, len(words) + 1), lambda i: list_sum(list_transform(words[1:i], lambda x: octet_length(encode(x)) + 1))::BIGINT) AS upto
  FROM (SELECT *, regexp_extract_all(text, '[^\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x1c-\\x1f]+') AS words FROM {source} WHERE {_TOKENS.format('text')} > {most})
), walk AS (
  SELECT {keys}, 0::BIGINT AS part, 1::BIGINT AS a, len(list_filter(upto, lambda x: x <= {room} + upto[1] - n[1]))::BIGINT AS b FROM sized
  UNION ALL
  SELECT {keys}, part, a, len(list_filter(upto, lambda x: x <= {room} + upto[a] - n[a]))::BIGINT AS b FROM (
    SELECT {", ".join("s." + k for k in key)}, w.part + 1 AS part, greatest(w.b - {overlap}, w.a) + 1 AS a, s.upto, s.n FROM walk w JOIN sized s ON {same} WHERE w.b < len(s.words))
), pieces AS (
  SELECT {", ".join("s." + k for k in key)}, part, array_to_string(words[a:b], ' ') AS content FROM walk w JOIN sized s ON {same}
  UNION ALL SELECT {keys}, 0, text FROM {source} WHERE {_TOKENS.format('text')} <= {most}
)"""


_FOUND = r"""found AS (SELECT doc_id, text, string_split(regexp_replace(text, '(?m)((?:^|\n)[A-ZÀ-Þ])', chr(57344) || '\1', 'g'), chr(57344))[2:] AS found FROM documents)""".replace("\\\\", "\\")


@query(
    "WITH RECURSIVE " + _FOUND + rf""", parts_of AS (
  SELECT doc_id, i, header, {_STRIP.format('x')} AS text FROM (SELECT doc_id, unnest(found) AS x, generate_subscripts(found, 1) AS i, NULL AS header FROM found WHERE len(found) >= 3)
), named AS (
  SELECT doc_id, i, regexp_extract(text, '^([A-ZÀ-Þ])', 1) AS header, text FROM parts_of WHERE length(text) >= 40
  UNION ALL SELECT doc_id, 0, NULL, text FROM found WHERE len(found) < 3
), """ + _split_sql("named", "doc_id, i", 200, 10) + """, numbered AS (
  SELECT p.doc_id AS document_id, header, content, part, count(*) OVER (PARTITION BY p.doc_id, p.i) AS n, (row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i, part) - 1)::INT AS chunk_index FROM pieces p JOIN named USING (doc_id, i)
)
SELECT document_id, chunk_index, CASE WHEN header IS NULL THEN 'קטע ' || (part + 1) WHEN n = 1 THEN header ELSE header || ' — חלק ' || (part + 1) END AS section_header, length(content)::INT AS n_chars FROM numbered WHERE header IS NOT NULL OR trim(content) <> ''"""
)
def k04_parts(spark, sf_dir):
    d = X.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return K.chunk_documents(d, start=LINE_START, most=200, overlap=10).select("document_id", "chunk_index", "section_header", F.length("content").alias("n_chars"))


@query("WITH RECURSIVE " + _split_sql("documents", "doc_id", 900, 20) + f" SELECT doc_id, part::INT AS part, length(content)::INT AS n_chars, {_TOKENS.format('content')} AS tokens FROM pieces")
def k03_token_cap(spark, sf_dir):
    d = X.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(K.parts(F.col("text"), 900, 20)).alias("part", "content"))
    return d.select("doc_id", "part", F.length("content").alias("n_chars"), T.estimate_tokens(F.col("content")).alias("tokens"))


@query(
    "WITH RECURSIVE pages_of AS (SELECT conv_id AS doc_id, turn AS i, text FROM conversations), " + _split_sql("pages_of", "doc_id, i", 60, 4) + """
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1)::INT AS chunk_index, 'קטע ' || (part + 1) AS section_header, content, i::INT + 1 AS page_start, i::INT + 1 AS page_end FROM pieces WHERE trim(content) <> ''"""
)
def k05_pages(spark, sf_dir):
    p = X.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")
    return K.chunk_pages(p, most=60, overlap=4)


# -- analytics ---------------------------------------------------------------------


@query(_with(X.MESSAGES) + "SELECT conv_id AS id, (SELECT content FROM messages WHERE conversation_id = conv_id AND role = 'user' ORDER BY id LIMIT 1) AS first_question, (SELECT count(*) FROM messages WHERE conversation_id = conv_id) AS message_count FROM (SELECT DISTINCT conv_id FROM conversations)")
def j03_conversations(spark, sf_dir):
    c = X.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumns({"session_id": F.lit("s"), "started_at": F.lit(None).cast("timestamp")})
    return A.conversation_list(c, X.messages(spark, sf_dir)).select("id", "first_question", "message_count")


_LOGS = "logs AS (SELECT m.*, q.question FROM messages m LEFT JOIN (SELECT conversation_id, arg_max(content, id) AS question FROM messages WHERE role = 'user' GROUP BY 1) q USING (conversation_id) WHERE role = 'assistant' AND strftime(created_at, '%Y-%m-%d %H:%M:%S') >= '2024-01-05' AND strftime(created_at, '%Y-%m-%d %H:%M:%S') <= '2024-01-20 23:59:59')"


@query(_with(X.MESSAGES, _LOGS) + "SELECT id, conversation_id, question FROM logs")
def j05_logs(spark, sf_dir):
    return A.logs(X.messages(spark, sf_dir), "2024-01-05", "2024-01-20").select("id", "conversation_id", "question")


@query(_with(X.MESSAGES, _LOGS) + "SELECT id, question FROM logs ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20")
def t03_page(spark, sf_dir):
    return A.page(A.logs(X.messages(spark, sf_dir), "2024-01-05", "2024-01-20"), 2).select("id", "question")


@query(_with(X.MESSAGES, _LOGS) + "SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS pages FROM logs")
def t08_page_count(spark, sf_dir):
    return A.page_count(A.logs(X.messages(spark, sf_dir), "2024-01-05", "2024-01-20"))


@query(_with(X.MESSAGES) + "SELECT conversation_id, id, (SELECT content FROM messages u WHERE u.conversation_id = m.conversation_id AND u.role = 'user' AND u.id < m.id ORDER BY u.id DESC LIMIT 1) AS question FROM messages m WHERE role = 'assistant'")
def j09_question_before(spark, sf_dir):
    return A.question_before(X.messages(spark, sf_dir))


@query(_with(X.MESSAGES) + "SELECT conversation_id, id, role, content FROM messages m WHERE id < (SELECT max(id) FROM messages x WHERE x.conversation_id = m.conversation_id)")
def p16_history(spark, sf_dir):
    return A.history(X.messages(spark, sf_dir))


@query(_with(X.USAGE) + "SELECT id FROM usage WHERE role = 'assistant' AND strftime(created_at, '%Y-%m-%d %H:%M:%S') >= '2024-01-03' AND strftime(created_at, '%Y-%m-%d %H:%M:%S') <= '2024-01-09 23:59:59'")
def p02_log_filter(spark, sf_dir):
    u = X.usage(spark, sf_dir)
    return u.where("role = 'assistant'").where(A.log_filter(F.col("created_at"), "2024-01-03", "2024-01-09")).select("id")


@query(_with(X.USAGE) + f"SELECT created_at::DATE AS date, round(sum(cost_usd), 6) AS cost, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens, sum(cache_write_tokens)::BIGINT AS cache_write_tokens, count(*) AS messages FROM usage WHERE role = 'assistant' AND created_at >= DATE '{AS_OF}' - 7 GROUP BY 1")
def a02_costs_daily(spark, sf_dir):
    return A.costs_daily(X.usage(spark, sf_dir), AS_OF).withColumn("cost", F.round("cost", 6))


@query(_with(X.USAGE) + f"SELECT round(coalesce(sum(cost_usd) FILTER (created_at::DATE = DATE '{AS_OF}'), 0), 6) AS today, round(coalesce(sum(cost_usd) FILTER (created_at >= DATE '2024-01-01'), 0), 6) AS month, round(coalesce(sum(cost_usd), 0), 6) AS total FROM usage WHERE role = 'assistant'")
def a03_costs_summary(spark, sf_dir):
    return A.costs_summary(X.usage(spark, sf_dir), AS_OF).select(*(F.round(c, 6).alias(c) for c in ("today", "month", "total")))


@query(_with(X.USAGE) + f"SELECT date, round(greatest(cost / greatest(max(cost) OVER (), 0.001) * 100, 4), 4) AS height FROM (SELECT created_at::DATE AS date, sum(cost_usd) AS cost FROM usage WHERE role = 'assistant' AND created_at >= DATE '{AS_OF}' - 7 GROUP BY 1)")
def a17_bars(spark, sf_dir):
    return A.bars(A.costs_daily(X.usage(spark, sf_dir), AS_OF)).select("date", F.round("height", 4).alias("height"))


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT coalesce(sum(token_count), 0)::BIGINT AS tokens FROM docs WHERE is_active")
def a01_total_tokens(spark, sf_dir):
    return A.total_tokens(X.documents(spark, sf_dir))


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT count(*) AS documents, sum(token_count)::BIGINT AS tokens, (SELECT count(*) FROM chunks) AS chunks, sum(token_count) > 500000 AS warning FROM docs")
def a09_stats(spark, sf_dir):
    return A.document_stats(X.documents(spark, sf_dir), X.chunks(spark, sf_dir))


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT count(*) FILTER (is_active) AS active, count(*) FILTER (index_status = 'ready') AS ready, count(*) FILTER (index_status = 'failed' OR chunk_count = 0) AS failed, sum(chunk_count)::BIGINT AS chunks, sum(token_count)::BIGINT AS tokens FROM docs")
def a10_tiles(spark, sf_dir):
    return A.tiles(X.documents(spark, sf_dir))


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, title FROM docs WHERE is_active")
def s01_documents(spark, sf_dir):
    return A.documents_list(X.documents(spark, sf_dir)).select("id", "title")


# -- audit ---------------------------------------------------------------------------

_AUDIT = f"""audited AS (
  SELECT id, is_active, coalesce(n, 0) AS live, coalesce(length(text), 0)::INT AS extraction_chars, effective_date, {_STATUS} AS status,
    list_filter([CASE WHEN text IS NULL THEN 'missing_text_file' WHEN length(text) = 0 THEN 'empty_extraction' END, CASE WHEN is_active AND coalesce(n, 0) = 0 THEN 'no_chunks' END], lambda x: x IS NOT NULL) AS issues
  FROM docs LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks WHERE document_id % 8 <> 2 GROUP BY 1) ON id = document_id
)"""


def _audited(spark, sf_dir):
    return audit.documents(X.documents(spark, sf_dir), X.chunks(spark, sf_dir).where("document_id % 8 <> 2"), X.AS_OF)


@query(_with(X.CHUNKS, X.DOCUMENTS, _AUDIT) + "SELECT id, live AS live_chunk_count, extraction_chars, status AS validity_status, array_to_string(issues, ',') AS issues FROM audited")
def p08_issues(spark, sf_dir):
    return _audited(spark, sf_dir).select("id", "live_chunk_count", "extraction_chars", "validity_status", F.array_join("issues", ",").alias("issues"))


@query(_with(X.CHUNKS, X.DOCUMENTS, _AUDIT) + "SELECT issue, count(*) AS documents FROM (SELECT unnest(issues) AS issue FROM audited) GROUP BY 1")
def a07_issue_histogram(spark, sf_dir):
    return audit.issue_histogram(_audited(spark, sf_dir))


@query(_with(X.CHUNKS, X.DOCUMENTS, _AUDIT) + "SELECT count(*) AS documents, count(*) FILTER (is_active) AS active, count(*) FILTER (is_active AND live > 0) AS indexed, count(*) FILTER (is_active AND live = 0) AS unindexed, count(*) FILTER (list_contains(issues, 'missing_text_file')) AS missing_text, sum(live)::BIGINT AS chunks, count(*) FILTER (is_active AND status = 'current') AS current, count(*) FILTER (is_active AND status = 'superseded') AS superseded, count(*) FILTER (is_active AND status = 'expired') AS expired, count(*) FILTER (is_active AND coalesce(effective_date, '') = '') AS undated FROM audited")
def a08_summary(spark, sf_dir):
    return audit.summary(_audited(spark, sf_dir))


# -- catalog -------------------------------------------------------------------------


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, CASE WHEN id % 4 = 1 THEN 'ready' WHEN id % 4 = 2 THEN 'failed' ELSE index_status END AS index_status, CASE WHEN id % 4 = 2 THEN 'broken' END AS index_error, CASE WHEN id % 4 = 1 THEN 99 ELSE chunk_count END::BIGINT AS chunk_count FROM docs")
def m02_status(spark, sf_dir):
    d = X.documents(spark, sf_dir).withColumn("indexed_at", F.lit(None).cast("timestamp"))
    i = F.col("id")
    changes = d.where("id % 4 in (1, 2)").select("id", F.when(i % 4 == 1, "ready").otherwise("failed").alias("index_status"), F.when(i % 4 == 2, "broken").alias("index_error"), F.when(i % 4 == 1, F.lit(99).cast("long")).alias("chunk_count"), F.lit(None).cast("timestamp").alias("at"))
    return M.set_status(d, changes).select("id", "index_status", "index_error", "chunk_count")


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, CASE WHEN id % 5 = 1 THEN '2001-01-01' ELSE effective_date END AS effective_date, CASE WHEN id % 5 = 1 THEN NULL ELSE valid_until END AS valid_until, CASE WHEN id % 5 = 1 THEN NULL ELSE superseded_by END AS superseded_by FROM docs")
def m03_validity(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    changes = d.where("id % 5 = 1").select("id", F.lit("2001-01-01").alias("effective_date"), F.lit(None).cast("string").alias("valid_until"), F.lit(None).cast("long").alias("superseded_by"))
    return M.set_validity(d, changes).select("id", "effective_date", "valid_until", "superseded_by")


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT c.id, d.id AS document_id, CASE WHEN d.id % 6 = 1 THEN 'new ' || d.id ELSE document_title END AS document_title, CASE WHEN d.id % 6 = 1 THEN 'draft' ELSE lifecycle_status END AS lifecycle_status FROM chunks c JOIN docs d ON c.document_id = d.id")
def m04_metadata(spark, sf_dir):
    d, c = X.documents(spark, sf_dir), X.chunks(spark, sf_dir)
    none = F.lit(None).cast("string")
    changes = d.where("id % 6 = 1").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("title"), none.alias("topic"), none.alias("document_type"), F.lit("draft").alias("lifecycle_status"))
    d2, c2 = M.set_metadata(d, c, changes)
    return c2.select("id", "document_id", "document_title").join(d2.select(F.col("id").alias("document_id"), "lifecycle_status"), "document_id")


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, CASE WHEN id % 3 = 2 THEN false ELSE is_active END AS is_active, CASE WHEN id % 3 = 2 THEN 'historical' ELSE lifecycle_status END AS lifecycle_status FROM docs")
def m05_archive(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    return M.archive(d, d.where("id % 3 = 2").select("id")).select("id", "is_active", "lifecycle_status")


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT c_custkey::INT, c_name FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation)")
def m06_insert_or_ignore(spark, sf_dir):
    n = X.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    c = X.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("k"), F.col("c_name").alias("v"))
    return M.insert_or_ignore(n, c, ["k"])


@query("SELECT coalesce(c.k, n.k) AS k, coalesce(c.v, n.v) AS v FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) n FULL JOIN (SELECT c_custkey::INT AS k, c_name AS v FROM customer) c ON n.k = c.k")
def m08_upsert(spark, sf_dir):
    n = X.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    c = X.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("k"), F.col("c_name").alias("v"))
    return M.upsert(n, c, ["k"])


@query(_with(X.CHUNKS) + "SELECT document_id, chunk_index, content FROM chunks WHERE document_id % 4 <> 1 UNION ALL SELECT document_id, 0, 'new' FROM (SELECT DISTINCT document_id FROM chunks WHERE document_id % 4 = 1)")
def m09_replace_chunks(spark, sf_dir):
    c = X.chunks(spark, sf_dir).select("document_id", "chunk_index", "content")
    new = c.where("document_id % 4 = 1").select("document_id").distinct().select("document_id", F.lit(0).alias("chunk_index"), F.lit("new").alias("content"))
    return M.replace_chunks(c, new)


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, document_id FROM chunks WHERE document_id % 9 <> 4")
def m10_delete(spark, sf_dir):
    d, c = X.documents(spark, sf_dir), X.chunks(spark, sf_dir)
    return M.delete_documents(d, c, d.where("id % 9 = 4").select("id"))[1].select("id", "document_id")


@query(_with(X.CHUNKS, X.DOCUMENTS) + r"""SELECT id, CASE WHEN index_status <> 'pending' THEN index_status WHEN live > 0 THEN 'ready' ELSE 'failed' END AS index_status, live AS chunk_count,
  coalesce(effective_date, strftime(try_strptime(regexp_extract(title, '(^|[^0-9])(\d{4}-\d{1,2}-\d{1,2})([^0-9]|$)', 2), '%Y-%m-%d'), '%Y-%m-%d')) AS effective_date
  FROM (SELECT d.*, coalesce(n, 0) AS live FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks WHERE document_id % 8 <> 2 GROUP BY 1) ON id = document_id)""")
def m12_backfill(spark, sf_dir):
    return M.backfill(X.documents(spark, sf_dir), X.chunks(spark, sf_dir).where("document_id % 8 <> 2")).select("id", "index_status", "chunk_count", "effective_date")


@query(_with(X.CHUNKS, X.DOCUMENTS) + r"SELECT id, CASE WHEN NOT is_active THEN 'skip' WHEN u IS NOT NULL THEN 'fetch' WHEN length(coalesce(text, '')) > 0 THEN 'reindex' ELSE 'skip' END AS action, u AS url FROM (SELECT *, nullif(regexp_extract(source_ref, 'https?://[^\s`]+'), '') AS u FROM docs)")
def m15_reindex_plan(spark, sf_dir):
    return M.reindex_plan(X.documents(spark, sf_dir))


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, CASE WHEN id % 14 = 7 THEN 'superseded_by_itself' WHEN superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM docs) THEN 'replacement_missing' ELSE '' END AS errors FROM docs")
def j15_validity_errors(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    changes = d.select("id", F.when(F.col("id") % 14 == 7, F.col("id")).otherwise(F.col("superseded_by")).alias("superseded_by"))
    return M.validity_errors(changes, d).select("id", F.array_join("errors", ",").alias("errors"))


# -- evaluation ---------------------------------------------------------------------

_METRICS = """rel AS (SELECT query_id, doc_id AS item FROM labels JOIN (SELECT DISTINCT query_id FROM tf) ON doc_id % 5 = query_id % 5 WHERE quality = 1), many AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
ranked AS (SELECT query_id, document_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM tf),
hits AS (SELECT ranked.query_id, rank, (rel.item IS NOT NULL)::INT AS hit FROM ranked LEFT JOIN rel ON rel.query_id = ranked.query_id AND rel.item = ranked.item),
seen AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM hits),
metrics AS (SELECT query_id, round(coalesce(sum(hit) FILTER (rank <= 20) / any_value(n)::DOUBLE, 0), 6) AS recall, round(sum(hit) FILTER (rank <= 20) / count(*) FILTER (rank <= 20)::DOUBLE, 6) AS precision,
  round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit = 1), 0), 6) AS reciprocal_rank, round(coalesce(sum(upto / rank::DOUBLE) FILTER (hit = 1) / any_value(n), 0), 6) AS average_precision FROM seen LEFT JOIN many USING (query_id) GROUP BY 1)"""


def _metrics(spark, sf_dir):
    s = _tf(spark, sf_dir)[1]
    ranked = R.placed(s, "query_id", [F.desc("score"), F.col("document_id")], "rank").select("query_id", F.col("document_id").alias("item"), "rank")
    good = X.read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("item"), (F.col("doc_id") % 5).alias("kind"))
    asked = X.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 5).alias("kind"))
    m = E.ranking_metrics(ranked, asked.join(good, "kind").select("query_id", "item"), 20)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in m.columns if c != "query_id"))


@query(_with(_TF, _METRICS) + "SELECT * FROM metrics")
def e01_ranking_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(_with(_TF, _METRICS) + "SELECT count(*) AS queries, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(reciprocal_rank), 5) AS reciprocal_rank, round(avg(average_precision), 5) AS average_precision FROM metrics")
def e05_means(spark, sf_dir):
    m = E.means(_metrics(spark, sf_dir))
    return m.select("queries", *(F.round(c, 5).alias(c) for c in m.columns if c != "queries"))


def _answers(spark, sf_dir):
    b = X.read(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    n = b.agg(F.count("*").alias("items"))
    a = X.read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    w = lambda *i: F.array(*(F.element_at("w", k) for k in i))
    return a.crossJoin(F.broadcast(n)).join(b, F.col("conv_id") % F.col("items") == F.col("item_id")).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "answer", F.array().cast("array<string>").alias("expected_citation_prefixes"),
        F.when(F.col("item_id") == 1, w(1)).alias("any_citation_prefixes"), w(1, 2).alias("must_include"), w(3).alias("must_not_include"), w(1, 2, 3).alias("expected_conclusion"), w(4, 5).alias("required_concepts"),
        w(6).alias("required_actions"), (F.col("item_id") % 2 == 0).alias("requires_clarification"), F.when(F.col("item_id") % 3 == 0, w(7)).alias("clarification_terms"),
    )


_ANSWERS = "answers AS (SELECT conv_id || '-' || turn AS id, c.text AS answer, item_id, string_split(b.text, ' ') AS w FROM conversations c JOIN benchmark b ON conv_id % (SELECT count(*) FROM benchmark) = item_id WHERE role = 'assistant')"


@query(_with(_ANSWERS) + "SELECT id, (item_id <> 1 OR contains(answer, w[1])) AND contains(answer, w[1]) AND contains(answer, w[2]) AND NOT contains(answer, w[3]) AS passed, array_to_string(list_filter([w[1], w[2]], lambda t: NOT contains(answer, t)), ',') AS missing_terms, CASE WHEN contains(answer, w[3]) THEN w[3] ELSE '' END AS prohibited FROM answers")
def e08_guardrails(spark, sf_dir):
    return E.guardrails(_answers(spark, sf_dir)).select("id", "passed", F.array_join("missing_terms", ",").alias("missing_terms"), F.array_join("prohibited", ",").alias("prohibited"))


@query(_with(_ANSWERS) + """SELECT id, a = 1 AND b = 1 AND c = 1 AND (item_id % 2 = 1 OR d = 1) AND (item_id <> 1 OR contains(answer, w[1])) AND NOT contains(answer, w[3]) AS passed, round(a, 6) AS conclusion_score, b AS required_concepts_score, c AS actionability_score, d AS clarification_score FROM (
  SELECT *, (contains(answer, w[1])::INT + contains(answer, w[2])::INT + contains(answer, w[3])::INT) / 3.0::DOUBLE AS a, (contains(answer, w[4])::INT + contains(answer, w[5])::INT) / 2.0::DOUBLE AS b, contains(answer, w[6])::INT::DOUBLE AS c,
    CASE WHEN item_id % 3 = 0 THEN contains(answer, w[7])::INT::DOUBLE ELSE 1.0::DOUBLE END AS d FROM answers)""")
def e09_rubric(spark, sf_dir):
    return E.rubric(_answers(spark, sf_dir)).select("id", "passed", F.round("conclusion_score", 6).alias("conclusion_score"), *E.SCORES[1:])


def _ranked_titles(spark, sf_dir):
    r = R.ranked_documents(hybrid(spark, sf_dir))
    return r.select(F.col("query_id").cast("string").alias("id"), F.col("position").alias("rank"), F.col("document_title").alias("title"), F.col("document_ref").alias("source_ref"))


_HITS = """first_of AS (
  SELECT query_id, document_title, row_number() OVER (PARTITION BY query_id ORDER BY first) AS position FROM (
    SELECT query_id, document_id, min(place) AS first, arg_min(document_title, place) AS document_title FROM capped WHERE place <= 20 GROUP BY ALL)
), judged AS (
  SELECT *, contains(lower(document_title), 'src1') AS hit, NOT contains(lower(document_title), 'src1') AND contains(lower(document_title), 'src7') AS bad, sum(contains(lower(document_title), 'src1')::INT) OVER (PARTITION BY query_id ORDER BY position) AS upto FROM first_of
)"""


@query(_with(*_RETRIEVAL, _HITS) + """SELECT query_id::VARCHAR AS id, count(*) FILTER (hit)::DOUBLE AS recall, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS precision, round(coalesce(1.0::DOUBLE / min(position) FILTER (hit), 0), 6) AS reciprocal_rank,
  round(coalesce(sum(upto / position::DOUBLE) FILTER (hit), 0), 6) AS average_precision, CASE WHEN bool_or(hit) THEN 'src1' ELSE '' END AS found, CASE WHEN bool_or(hit) THEN '' ELSE 'src1' END AS missing,
  CASE WHEN bool_or(bad) THEN 'src7' ELSE '' END AS distractors, bool_or(hit) AND NOT bool_or(bad) AS passed FROM judged GROUP BY query_id""")
def e06_ranking_scores(spark, sf_dir):
    ranked = _ranked_titles(spark, sf_dir)
    one = lambda x: F.array(F.lit(x))
    cases = X.questions(spark, sf_dir).select(F.col("query_id").cast("string").alias("id"), one("SRC1 ").alias("relevant_documents"), F.lit(None).cast("array<string>").alias("expected_documents"), one("src7").alias("distractor_documents"))
    out = E.score_rankings(cases, ranked)
    flat = lambda c: F.lower(T.strip(F.array_join(c, ","))).alias(c)
    return out.select("id", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank", "average_precision")), flat("found"), flat("missing"), flat("distractors"), "passed")


_STATS = "count(*) AS n, count(*) FILTER (passed) AS passed, count(*) FILTER (error IS NOT NULL) AS errors, round(avg(passed::INT), 6) AS pass_rate, round(avg(coalesce(conclusion_score, 0)), 6) AS conclusion_score, round(avg(coalesce(required_concepts_score, 0)), 6) AS required_concepts_score, round(avg(coalesce(actionability_score, 0)), 6) AS actionability_score, round(avg(coalesce(clarification_score, 0)), 6) AS clarification_score"


@query(_with(X.RUNS) + f"SELECT run, coalesce(category, 'uncategorized') AS category, {_STATS} FROM runs GROUP BY 1, 2 UNION ALL SELECT run, NULL, {_STATS} FROM runs GROUP BY 1")
def a14_run_stats(spark, sf_dir):
    s = E.run_stats(X.runs(spark, sf_dir))
    return s.select("run", "category", "n", "passed", "errors", F.round("pass_rate", 6).alias("pass_rate"), *(F.round(c, 6).alias(c) for c in E.SCORES))


def _sides(c: str, value: str) -> str:
    return ", ".join(f"{value.replace('?', run)} AS {run}_{c}" for run in ("base", "candidate"))


def _delta(c: str, whole: bool) -> str:
    b, n = f"base_{c}", f"candidate_{c}"
    if whole:
        return f"printf('%4d -> %4d (%s)', {b}, {n}, CASE WHEN {n} = {b} THEN '  0' ELSE printf('%+d', {n} - {b}) END) AS {c}_delta"
    return f"printf('%.3f -> %.3f (%s%.3f)', {b}, {n}, CASE WHEN {n} - {b} > 1e-9 THEN '+' WHEN {n} - {b} < -1e-9 THEN '-' ELSE ' ' END, abs({n} - {b})) AS {c}_delta"


_COMPARED = f"""both_runs AS (
  SELECT r.run, r.passed, r.error, {", ".join(f"coalesce(r.{c}, 0) AS {c}" for c in E.SCORES)}, coalesce(b.category, 'uncategorized') AS category
  FROM runs r JOIN runs b ON b.run = 'base' AND b.id = r.id WHERE r.id IN (SELECT id FROM runs WHERE run = 'candidate') AND r.id IN (SELECT id FROM runs WHERE run = 'base')
), wide AS (
  SELECT category, (count(*) FILTER (run = 'base')) AS n, {_sides("passed", "count(*) FILTER (passed AND run = '?')")}, {_sides("errors", "count(*) FILTER (error IS NOT NULL AND run = '?')")},
    {", ".join(_sides(c, f"avg({c}) FILTER (run = '?')") for c in E.SCORES)} FROM both_runs GROUP BY GROUPING SETS ((category), ())
)"""


@query(_with(X.RUNS, _COMPARED) + f"SELECT category, n, base_passed, candidate_passed, base_errors, candidate_errors, {', '.join(f'round({run}_{c}, 6) AS {run}_{c}' for c in E.SCORES for run in ('base', 'candidate'))}, {_delta('passed', True)}, {_delta('errors', True)}, {', '.join(_delta(c, False) for c in E.SCORES)} FROM wide")
def a12_compared(spark, sf_dir):
    r = X.runs(spark, sf_dir)
    out = E.compared(r.where("run = 'base'"), r.where("run = 'candidate'"))
    return out.withColumns({f"{run}_{c}": F.round(f"{run}_{c}", 6) for c in E.SCORES for run in ("base", "candidate")})


_PAIRS = "pairs AS (SELECT b.id, b.passed AS bp, c.passed AS cp FROM (SELECT * FROM runs WHERE run = 'base') b JOIN (SELECT * FROM runs WHERE run = 'candidate') c ON b.id = c.id)"


@query(_with(X.RUNS, _PAIRS) + "SELECT id, bp AS base_passed, cp AS candidate_passed, CASE WHEN cp AND NOT bp THEN 'gained' WHEN bp AND NOT cp THEN 'lost' END AS flip FROM pairs")
def u06_flips(spark, sf_dir):
    r = X.runs(spark, sf_dir)
    return E.paired(r.where("run = 'base'"), r.where("run = 'candidate'")).drop("category")


@query(_with(X.RUNS) + "SELECT id, 'base' AS only_in FROM runs WHERE run = 'base' AND id NOT IN (SELECT id FROM runs WHERE run = 'candidate') UNION ALL SELECT id, 'candidate' FROM runs WHERE run = 'candidate' AND id NOT IN (SELECT id FROM runs WHERE run = 'base')")
def u02_unpaired(spark, sf_dir):
    r = X.runs(spark, sf_dir)
    return E.unpaired(r.where("run = 'base'"), r.where("run = 'candidate'"))


@query(_with(X.RUNS, _PAIRS) + "SELECT count(*) AS n, count(*) FILTER (bp) AS base_passed, count(*) FILTER (cp) AS candidate_passed, count(*) FILTER (cp AND NOT bp) AS gained, count(*) FILTER (bp AND NOT cp) AS lost, CASE WHEN count(*) FILTER (cp) >= count(*) FILTER (bp) THEN 'candidate >= baseline' ELSE 'candidate REGRESSED' END AS verdict, CASE WHEN count(*) FILTER (cp) >= count(*) FILTER (bp) THEN 0 ELSE 1 END::INT AS exit_code FROM pairs")
def e10_compare(spark, sf_dir):
    r = X.runs(spark, sf_dir)
    return E.verdict(E.paired(r.where("run = 'base'"), r.where("run = 'candidate'")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def s15_last_of_each(spark, sf_dir):
    return E.last_of_each(X.read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


# -- sources ------------------------------------------------------------------------


@query()
def s08_html_text(spark, sf_dir):
    return X.read(spark, sf_dir, "pages").select("page_id", S.html_text(F.col("html")).alias("text"))


#: Lines of a page of the PDFs that are made of documents.
PAGE_LINES = 40


def _as_pdf(batches):
    for rows in sliced(batches):
        i, lines = rows.column("doc_id").to_pylist(), rows.column("lines").to_pylist()
        made = [pdf.write([x[a : a + PAGE_LINES] for a in range(0, len(x), PAGE_LINES)], k % 2 == 0, k % 3 == 0) for k, x in zip(i, lines, strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])


@query(rf"""SELECT doc_id, (p + 1)::INT AS page_number, {_CLEAN.format("array_to_string(lines[p * 40 + 1:p * 40 + 40], chr(10))")} AS text
  FROM (SELECT doc_id, lines, unnest(range(0, (len(lines) + 39) // 40)) AS p FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM documents))""")
def s04_pdf_pages(spark, sf_dir):
    """Documents as PDFs, packed or not, with tables or streams of cross references, and read back page by page."""
    ship(spark)
    lines = X.read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"\S"))).alias("lines"))
    files = lines.mapInArrow(_as_pdf, "doc_id long, content binary").withColumns({"url": F.lit("a.pdf"), "content_type": F.lit("application/pdf")})
    return S.extract(files, pdf_reader=pdf.read).select("doc_id", F.inline("pages"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' WHEN page_id % 4 = 1 THEN 'docx' WHEN page_id % 4 = 2 THEN 'doc' ELSE 'html' END AS kind FROM pages")
def s09_kind(spark, sf_dir):
    i = F.col("page_id")
    t = F.when(i % 4 == 0, "Application/PDF; x").when(i % 4 == 2, "application/msword")
    u = F.when(i % 4 == 1, "https://a.b/c.DOCX").otherwise(F.lit("https://a.b/c"))
    return X.read(spark, sf_dir, "pages").select("page_id", S.kind_of(t, u).alias("kind"))


@query(_with(X.USAGE) + "SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, id, coalesce(cache_write_tokens::VARCHAR, '') AS cache_write_tokens FROM usage WHERE role = 'assistant' ORDER BY usage.created_at DESC, id DESC LIMIT 10000")
def s17_export(spark, sf_dir):
    u = X.usage(spark, sf_dir).where("role = 'assistant'")
    none = {c: F.lit(None).cast("string") for c in ("confidence", "response_time_ms")}
    return A.export(u.withColumns(none).withColumn("question", F.col("id").cast("string"))).select("created_at", F.col("question").cast("long").alias("id"), "cache_write_tokens")


@query(_with(X.MESSAGES, _LOGS) + """SELECT strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, left(coalesce(question, ''), 100) AS question, CASE WHEN id % 3 = 0 THEN '' ELSE 'HIGH' END AS confidence,
  (id % 900)::VARCHAR AS response_time_ms, CASE WHEN id % 5 = 0 THEN '' ELSE (id % 7000)::VARCHAR END AS input_tokens, (id % 11)::VARCHAR AS output_tokens, '' AS cache_read_tokens, (id % 13)::VARCHAR AS cache_write_tokens, (id % 17)::VARCHAR AS cost_usd
  FROM logs ORDER BY logs.created_at DESC, id DESC LIMIT 10000""")
def s17_export_rows(spark, sf_dir):
    """All columns of the export; questions are texts, cut to 100 characters."""
    i = F.col("id")
    rows = A.logs(X.messages(spark, sf_dir), "2024-01-05", "2024-01-20").withColumns({
        "confidence": F.when(i % 3 != 0, "HIGH"), "response_time_ms": i % 900, "input_tokens": F.when(i % 5 != 0, i % 7000), "output_tokens": i % 11, "cache_read_tokens": F.lit(None).cast("long"), "cache_write_tokens": i % 13, "cost_usd": i % 17,
    })
    return A.export(rows)


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 40 THEN 'too_large' END, CASE WHEN p_partkey % 3 = 0 THEN 'unsupported_type' END, CASE WHEN p_partkey % 7 = 0 THEN 'no_text' END) AS errors FROM part")
def s22_upload_errors(spark, sf_dir):
    p = X.read(spark, sf_dir, "part")
    e = S.upload_errors(F.when(F.col("p_partkey") % 3 == 0, "a.txt").otherwise("b.PDF"), F.when(F.col("p_size") > 40, S.MOST_BYTES + 1).otherwise(5), F.when(F.col("p_partkey") % 7 == 0, " \n").otherwise("x"))
    return p.select("p_partkey", F.array_join(e, ",").alias("errors"))


# -- more of the inventory --------------------------------------------------------------


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, title, is_active FROM docs WHERE id = 12")
def s02_point_lookup(spark, sf_dir):
    return X.documents(spark, sf_dir).where("id = 12").select("id", "title", "is_active")


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT c.id, document_id, chunk_index, coalesce(nullif(d.effective_date, ''), c.effective_date) AS effective_date FROM chunks c JOIN docs d ON document_id = d.id WHERE is_active")
def s03_active_chunks(spark, sf_dir):
    d = X.documents(spark, sf_dir).where("is_active").select(F.col("id").alias("document_id"), F.col("effective_date").alias("own"))
    c = X.chunks(spark, sf_dir).join(d, "document_id")
    return c.select("id", "document_id", "chunk_index", F.coalesce(T.blank_to_null(F.col("own")), F.col("effective_date")).alias("effective_date"))


@query(f"SELECT event_id, CASE WHEN event_type = 'purchase' THEN '{L.OFFICIAL_CLASS}' WHEN event_type = 'click' THEN '{L.CONSTRUCTED_CLASS}' ELSE '{L.SECONDARY_CLASS}' END AS class, event_type = 'error' OR user_id % 5 = 0 AS quota FROM events")
def p13_p14_classes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "government").when(F.col("event_type") == "click", "constructed_from_web_topics").otherwise(F.col("event_type"))
    code, text = F.when(F.col("event_type") == "error", "insufficient_quota"), F.when(F.col("user_id") % 5 == 0, "x credit_balance_exhausted y").otherwise("fine")
    return X.read(spark, sf_dir, "events").select("event_id", T.source_class(kind).alias("class"), T.is_quota_error(code, text).alias("quota"))


@query("SELECT p_partkey, contains(p_name, 'ring') AND (contains(p_name, 'red') OR contains(p_name, 'small')) AS asked FROM part")
def p11_parameter_question(spark, sf_dir):
    return X.read(spark, sf_dir, "part").select("p_partkey", T.is_parameter_question(F.col("p_name"), "ring", ["red", "small"]).alias("asked"))


@query("SELECT c_custkey, m AS kind, CASE WHEN c_custkey % 2 = 0 THEN CASE m WHEN 'חוק' THEN 0.04::DOUBLE WHEN 'תקנה' THEN 0.02::DOUBLE WHEN 'חוזר' THEN 0.01::DOUBLE WHEN 'הכרעה' THEN 0.008::DOUBLE ELSE 0::DOUBLE END ELSE 0::DOUBLE END AS bonus FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'special' WHEN 1 THEN 'חוק' WHEN 2 THEN 'תקנה' WHEN 3 THEN 'חוזר' WHEN 4 THEN 'הכרעה' ELSE 'אחר' END AS m FROM customer)")
def f22_f23_authority(spark, sf_dir):
    c = X.read(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 6
    title = F.when(k == 1, "חוק חוזר").when(k == 2, "תקנות").when(k == 3, "חוזר 1").when(k == 4, "הכרעה").otherwise("x")
    kind = T.authority(F.when(k == 0, " special ").otherwise(""), title)
    bonus = T.authority_bonus(F.when(F.col("c_custkey") % 2 == 0, "מותר").otherwise("x"), kind)
    return c.select("c_custkey", kind.alias("kind"), bonus.alias("bonus"))


@query(_with(X.RUNS) + "SELECT id, printf('%.3f -> %.3f (%s%.3f)', b, c, CASE WHEN c - b > 1e-9 THEN '+' WHEN c - b < -1e-9 THEN '-' ELSE ' ' END, abs(c - b)) AS delta FROM (SELECT id, max(actionability_score) FILTER (run = 'base') AS b, max(required_concepts_score) FILTER (run = 'candidate') AS c FROM runs GROUP BY 1) WHERE b IS NOT NULL AND c IS NOT NULL")
def f26_deltas(spark, sf_dir):
    r = X.runs(spark, sf_dir)
    b, c = r.where("run = 'base'").select("id", F.col("actionability_score").alias("b")), r.where("run = 'candidate'").select("id", F.col("required_concepts_score").alias("c"))
    return b.join(c, "id").select("id", T.signed_delta(F.col("b"), F.col("c")).alias("delta"))


@query("SELECT page_id, substr(url, 1, 80) AS shown FROM pages")
def f33_title_or_url(spark, sf_dir):
    return X.read(spark, sf_dir, "pages").select("page_id", T.title_or_url(F.lit(""), F.col("url")).alias("shown"))


_MARKS = "# {0}\n**b** & <i>\n## two *em* `code`\n### three\n---\n- one\n- two **x**\n1. first\n{0}"
_MARKED = "<h1>{0}</h1><br><strong>b</strong> &amp; &lt;i&gt;<br><h2>two <em>em</em> <code>code</code></h2><br><h3 id=\"t\">three</h3><br><hr><br><ul><li>one</li><br><li>two <strong>x</strong></li></ul><br><li>first</li><br>{0}"


@query("SELECT p_partkey, '" + _MARKED.replace("{0}", "' || p_name || '") + "' AS html FROM part")
def f35_markdown(spark, sf_dir):
    before, between, after = (F.lit(x) for x in _MARKS.split("{0}"))
    text = F.concat(before, "p_name", between, "p_name", after)
    return X.read(spark, sf_dir, "part").select("p_partkey", T.markdown_to_html(text, {"h3": 'id="t"'}).alias("html"))


@query("SELECT o_orderstatus AS outcome, count(*) AS documents, sum(o_custkey)::BIGINT AS chunks FROM orders GROUP BY 1")
def a18_tally(spark, sf_dir):
    return M.tally(X.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("outcome"), F.col("o_custkey").alias("chunks")))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS title, 'current' AS lifecycle_status, 'ready' AS index_status FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name, 'current', 'indexing' FROM region")
def m01_add_documents(spark, sf_dir):
    from ..schemas import DOCUMENT_DEFAULTS, DOCUMENTS, migrate

    n = X.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.lit("ready").alias("index_status"))
    r = X.read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("title"))
    return M.add_documents(migrate(n, DOCUMENTS, DOCUMENT_DEFAULTS), r).select("id", "title", "lifecycle_status", "index_status")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN sha256(n_name) ELSE 'old' END AS source_checksum FROM nation")
def m11_artifact(spark, sf_dir):
    n = X.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lit("old").alias("source_checksum"), F.lit("p").alias("original_path"), "n_name")
    changes = n.select("id", F.when(F.col("id") % 2 == 0, F.sha2("n_name", 256)).alias("source_checksum"), F.lit(None).cast("string").alias("original_path"))
    return M.set_artifact(n, changes).select("id", "source_checksum")


_REPORT = """(SELECT -1 AS nth, '{"summary": ' || to_json({documents: count(*), active_documents: count(*) FILTER (is_active), indexed_documents: count(*) FILTER (is_active AND live > 0), unindexed_documents: count(*) FILTER (is_active AND live = 0),
    missing_text_files: count(*) FILTER (list_contains(issues, 'missing_text_file')), total_chunks: sum(live)::BIGINT, validity: {current: count(*) FILTER (is_active AND status = 'current'), superseded: count(*) FILTER (is_active AND status = 'superseded'),
    expired: count(*) FILTER (is_active AND status = 'expired'), undated: count(*) FILTER (is_active AND coalesce(effective_date, '') = '')}})
  || ', "issues": ' || (SELECT '{' || string_agg('"' || issue || '":' || n, ',' ORDER BY issue) || '}' FROM (SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM audited) GROUP BY 1)) || ', "documents": [' AS line FROM audited)
UNION ALL SELECT id, to_json({id: id, title: title, source_type: source_type, source_ref: source_ref, is_active: is_active, token_count: token_count, chunk_count: live, text_file_exists: text IS NOT NULL, extraction_chars: extraction_chars, effective_date: effective_date,
    valid_until: valid_until, superseded_by: superseded_by, topic: topic, document_type: document_type, lifecycle_status: lifecycle_status, validity_status: status, issues: issues})::VARCHAR || CASE WHEN id = (SELECT max(id) FROM audited) THEN '' ELSE ',' END
  FROM (SELECT a.*, d.title, d.source_type, d.source_ref, d.token_count, d.text, d.valid_until, d.superseded_by, d.topic, d.document_type, d.lifecycle_status FROM audited a JOIN docs d USING (id))
UNION ALL SELECT 9223372036854775807, ']}'"""


@query(_with(X.CHUNKS, X.DOCUMENTS, _AUDIT) + _REPORT)
def s18_report(spark, sf_dir):
    return audit.report(_audited(spark, sf_dir))


_KIND = "CASE WHEN item_id % 4 = 0 THEN 'official' WHEN item_id % 4 = 1 THEN 'constructed_from_web_topics' WHEN item_id % 4 = 2 THEN 'blog' END"
_SHEET = f"""SELECT id, nth::INT AS nth, array_to_string(list_filter(['### ' || nth || '. ' || text, '', '**{L.REVIEW_KIND}:** ' || coalesce(kind, '{L.REVIEW_NO_KIND}'),
  '**{L.REVIEW_CLASS}:** ' || CASE kind WHEN 'official' THEN '{L.OFFICIAL_CLASS}' WHEN 'constructed_from_web_topics' THEN '{L.CONSTRUCTED_CLASS}' ELSE '{L.SECONDARY_CLASS}' END,
  CASE WHEN item_id % 3 = 0 THEN '**{L.REVIEW_SOURCE}:** https://x.y/' || item_id END, CASE WHEN item_id % 5 = 0 THEN '**{L.REVIEW_PRIMARY}:** p' END, '', '**{L.REVIEW_ANSWER}:**',
  '> ' || CASE WHEN item_id % 2 = 0 THEN w[1] ELSE '{L.REVIEW_NO_ANSWER}' END, '', '**{L.REVIEW_CONCLUSION}:** ' || w[1] || ', ' || w[2], CASE WHEN item_id % 3 = 1 THEN '**{L.REVIEW_CONCEPTS}:** ' || w[3] END,
  '**{L.REVIEW_ACTIONS}:** ' || w[4], '**{L.REVIEW_PROHIBITED}:** ' || w[5], CASE WHEN item_id % 4 = 3 THEN '**{L.REVIEW_CLARIFY}:** {L.REVIEW_YES} — ' || w[6] || ', ' || w[7] END,
  '**{L.REVIEW_STATUS}:** ' || CASE WHEN item_id % 2 = 0 THEN '{L.REVIEW_DONE.format(product="lexforge")}' ELSE '{L.REVIEW_OPEN}' END, '', '---', ''], lambda x: x IS NOT NULL), chr(10)) AS markdown
FROM (SELECT *, item_id::VARCHAR AS id, row_number() OVER (PARTITION BY item_id % 2 ORDER BY item_id::VARCHAR) AS nth, {_KIND} AS kind, string_split(text, ' ') AS w FROM benchmark)"""


@query(_SHEET)
def s20_review_sheet(spark, sf_dir):
    i = F.col("item_id")
    b = X.read(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " "))
    w = lambda *k: F.array(*(F.element_at("w", n) for n in k))
    cases = b.select(
        i.cast("string").alias("id"), (i % 2 == 0).alias("executed"), F.col("text").alias("question"), F.expr(_KIND).alias("source_type"), F.when(i % 3 == 0, F.concat(F.lit("https://x.y/"), i.cast("string"))).alias("reference_url"),
        F.when(i % 5 == 0, "p").alias("primary_source"), F.when(i % 2 == 0, F.element_at("w", 1)).otherwise("").alias("reference_answer"), w(1, 2).alias("expected_conclusion"), F.when(i % 3 == 1, w(3)).alias("required_concepts"),
        w(4).alias("required_actions"), w(5).alias("must_not_include"), (i % 4 == 3).alias("requires_clarification"), w(6, 7).alias("clarification_terms"),
    )
    return S.review_sheet(cases).select("id", "nth", "markdown")


@query(_with(_ANSWERS) + "SELECT id, contains(answer, w[1]) AND contains(answer, w[2]) AS passed, array_to_string(list_filter([w[1], w[2]], lambda t: contains(answer, t)), ',') AS found FROM answers")
def e07_context_score(spark, sf_dir):
    a = _answers(spark, sf_dir).select("id", E.context_score(F.col("must_include"), F.col("answer")).alias("s"))
    return a.select("id", "s.passed", F.array_join("s.found", ",").alias("found"))


@query(_with(X.USAGE) + "SELECT id, printf('%4d -> %4d (', input_tokens, output_tokens) || CASE WHEN output_tokens = input_tokens THEN '  0' ELSE printf('%+d', output_tokens - input_tokens) END || ')' AS delta, CASE WHEN coalesce(input_tokens, 0) = 0 THEN '-' ELSE printf('%.1f', input_tokens / 1000.0::DOUBLE) || 's' END AS seconds, CASE WHEN output_tokens = 0 THEN '-' ELSE printf('$%.4f', output_tokens / 8.0::DOUBLE) END AS cost, strftime(created_at, '%m-%d') AS day, round(input_tokens / 7.0::DOUBLE, 2) AS elapsed, (input_tokens / 8.0::DOUBLE * 1000)::INT AS ms FROM usage")
def f26_f27_f36_shown(spark, sf_dir):
    u = X.usage(spark, sf_dir)
    n, m = F.col("input_tokens"), F.col("output_tokens")
    return u.select(
        "id", T.signed_delta(n, m, as_int=True).alias("delta"), T.shown_seconds(n).alias("seconds"), T.shown_cost(m / F.lit(8.0)).alias("cost"), T.shown_day(F.to_date("created_at")).alias("day"),
        T.elapsed(n / F.lit(7.0)).alias("elapsed"), T.elapsed(n / F.lit(8.0), ms=True).alias("ms"),
    )


@query("SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: printf('%.6f', x)), ' ') AS vector FROM embeddings")
def f28_vectors(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    back = T.vector_from_json(T.vector_to_json(v))
    return X.read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(back, lambda x: T.fixed(x, 6)), " ").alias("vector"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '.pdf' ELSE 'x.bin' END AS original, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'document' ELSE '.hidden' END || '.txt' AS text FROM part")
def f33_download_name(spark, sf_dir):
    i = F.col("p_partkey")
    title = F.when(i % 3 == 0, F.concat(F.lit("a/b/"), "p_name", F.lit(".pdf"))).when(i % 3 == 1, "").otherwise("c/.hidden")
    return X.read(spark, sf_dir, "part").select("p_partkey", T.download_name(F.when(i % 3 == 0, title), F.lit("/o/x.bin")).alias("original"), T.download_name(title, text=True).alias("text"))


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, CASE WHEN coalesce(text, '') = '' THEN 'failed' ELSE 'succeeded' END AS outcome, CASE WHEN coalesce(text, '') = '' THEN 'no text' END AS error, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END::BIGINT AS chunks FROM docs WHERE is_active")
def m14_reindex(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    return M.reindex(d, X.chunks(spark, sf_dir), start=r"\\Zno section", most=1 << 40)[1].select("id", "outcome", "error", "chunks")


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT document_id, chunk_index, content FROM chunks WHERE document_id NOT IN (SELECT id FROM docs WHERE is_active AND text <> '') UNION ALL SELECT id, 0, text FROM docs WHERE is_active AND text <> ''")
def m14_chunks(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    return M.reindex(d, X.chunks(spark, sf_dir), start=r"\\Zno section", most=1 << 40)[0].select("document_id", "chunk_index", "content")


@query(_with(X.CHUNKS, X.DOCUMENTS) + "SELECT id, 'would be fetched' AS outcome FROM docs WHERE is_active AND source_type = 'url'")
def m15_dry_run(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    return M.reingest(d, X.chunks(spark, sf_dir), S.fetch_documents)[2].select("id", "outcome")


@query("SELECT conv_id * 1000 + turn AS id, role, text AS content FROM conversations WHERE conv_id = 7")
def t02_conversation(spark, sf_dir):
    return A.conversation(X.messages(spark, sf_dir), 7).select("id", "role", "content")


@query("SELECT n_nationkey AS id, n_name AS title FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name FROM region")
def m13_add_rows(spark, sf_dir):
    n = X.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    return M.add_rows(n, X.read(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("title")))


@query("SELECT r_regionkey AS k, r_name AS v FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT r_regionkey, 'new' FROM region WHERE r_regionkey = 2 UNION ALL SELECT 99, 'more'")
def h08_settings(spark, sf_dir):
    r = X.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    more = spark.createDataFrame([(0, None), (2, "new"), (4, None), (99, "more")], "key int, value string")
    return M.set_setting(r, more).select(F.col("key").alias("k"), F.col("value").alias("v"))


@query(f"SELECT 'a' AS parameter_key, 1999 + r_regionkey AS tax_year, r_name AS value_text FROM region UNION ALL SELECT '{L.FIRST_PARAMETER['parameter_key']}', {L.FIRST_PARAMETER['tax_year']}, '{L.FIRST_PARAMETER['value_text']}'")
def s23_seed(spark, sf_dir):
    p = X.read(spark, sf_dir, "region").select(F.lit("a").alias("parameter_key"), (F.col("r_regionkey") + 1999).alias("tax_year"), F.col("r_name").alias("value_text"))
    return M.seed_parameters(M.seed_parameters(p))


@query("SELECT conv_id AS document_id, turn::INT AS chunk_index, text AS content, turn::INT + 1 AS page_start FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, 0, string_agg(text, chr(10) ORDER BY turn), NULL FROM conversations WHERE conv_id % 2 = 1 GROUP BY 1")
def k06_index_choice(spark, sf_dir):
    c = X.read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).cast("int").alias("page_number"), "text"))).alias("p"))
    d = c.select("document_id", F.array_join("p.text", "\n").alias("text"), F.when(F.col("document_id") % 2 == 0, F.col("p")).alias("pages"))
    return K.chunk(d).select("document_id", "chunk_index", "content", "page_start")


@query("SELECT doc_id, (ord(text[1]) + length(text))::DOUBLE AS first, 1.0::DOUBLE AS second FROM documents")
def k07_embed(spark, sf_dir):
    d = X.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    out = K.embed(d, lambda texts: [[None if t is None else float(ord(t[0]) + len(t)) if t else -1.0, 1.0] for t in texts])
    return out.select("doc_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", 2).alias("second"))


@query("SELECT item_id::VARCHAR AS id, text AS question, list_transform(string_split(text, ' ')[1:2], lambda x: x || '\"') AS relevant_documents FROM benchmark")
def s14_s16_results(spark, sf_dir):
    b = X.read(spark, sf_dir, "benchmark")
    rows = b.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.transform(F.slice(F.split("text", " "), 1, 2), lambda x: F.concat(x, F.lit('"'))).alias("relevant_documents"))
    path = scratch_path(spark, "results")
    S.write_results(rows, path)
    return S.read_cases(spark, path, rows.schema)


@query("SELECT 'a, ' || p_name || ', b' AS document, p_type || ', \"x\"' AS title, p_partkey::VARCHAR AS notes FROM part")
def s19_register(spark, sf_dir):
    p = X.read(spark, sf_dir, "part")
    line = F.concat(F.lit("a, "), "p_name", F.lit(', b,"'), "p_type", F.lit(', ""x""",'), F.col("p_partkey").cast("string"))
    path = scratch_path(spark, "register")
    p.select(line.alias("value")).unionByName(spark.createDataFrame([("document,title,notes",), (" ",)], "value string")).write.text(path)
    return S.read_register(spark, path, ["document", "title", "notes"])


@query("SELECT s_suppkey AS id, s_name || chr(10) || s_suppkey AS text FROM supplier WHERE s_suppkey <> 3")
def s13_texts(spark, sf_dir):
    s = X.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit("\n"), F.col("s_suppkey").cast("string")).alias("text"))
    path = scratch_path(spark, "texts")
    S.write_texts(s, path)
    S.delete_text(spark, path, 3)
    return S.read_text_of(spark, path)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 'blank_title' ELSE '' END AS errors FROM part")
def p07_metadata_errors(spark, sf_dir):
    i = F.col("p_partkey")
    changes = X.read(spark, sf_dir, "part").select(i.alias("id"), F.when(i % 3 == 0, "p").when(i % 3 == 1, " \n").alias("title"))
    return M.metadata_errors(changes).select("id", F.array_join("errors", ",").alias("errors"))
