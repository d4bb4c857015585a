"""Registered queries of whole flows: files and addresses to texts, uploads to chunks, streams of events to answers."""

from __future__ import annotations

import base64
import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

import lexforge

from ..functions import rules as L
from ..operators import analytics as A, catalog as M, context as C, evaluation as E, ingest
from ..schemas import CHUNKS, DOCUMENTS, PARAMETERS, migrate
from ..scratch import scratch_path
from ..session import ship, sliced
from ..sources import files as S, pdf
from ..streaming import answers
from . import standins as X
from .queries import _CLEAN, _TOKENS, _with, ORACLES, PAGE_LINES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

#: No section begins anywhere, and no text is too long: one chunk for a text or page.
WHOLE = {"start": r"\\Zno section", "most": 1 << 40}
POISON = "zzpoison"
_LINES = r"SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '\S')) AS lines FROM documents"
_PAGES = "(len(lines) + 39) // 40"
_TRIM = r"trim({0}, E' \t\n\r\x0b\x0c')"


def _lines(spark, sf_dir: str) -> DataFrame:
    return X.read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"\S"))).alias("lines"))


def _docx(lines: list[str]) -> bytes:
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</w:t></w:r></w:p>' for x in lines)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>')
    return made.getvalue()


def _file(kind: str, lines: list[str]) -> bytes:
    if kind == "pdf":
        return pdf.write([list(lines[a : a + PAGE_LINES]) for a in range(0, len(lines), PAGE_LINES)] or [[]])
    if kind == "docx":
        return _docx(["", *lines, " "])
    return ("<html><head><style>p {}</style></head><body><nav>menu</nav>" + "".join(f"<p>{escape(x)}</p>" for x in lines) + "<footer>end</footer></body></html>").encode()


def _made(batches):
    for rows in sliced(batches):
        kinds = rows.column("kind")
        files = [_file(k, x) for k, x in zip(kinds.to_pylist(), rows.column("lines").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), kinds, pa.array(files, pa.binary())], ["doc_id", "kind", "content"])


def _files(spark, sf_dir: str, kind: Column) -> DataFrame:
    """doc_id, kind and content: a file of its kind for each document."""
    ship(spark)
    return _lines(spark, sf_dir).withColumn("kind", kind).mapInArrow(_made, "doc_id long, kind string, content binary")


_KINDS = ("pdf", "docx", "doc", "html", "lost")
_TYPES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword", "text/html;charset=utf-8")


def _of_id(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values)).cast("int") + 1)


@query(rf"""SELECT doc_id, kind, text, CASE doc_id % 5 WHEN 2 THEN 'legacy format' WHEN 4 THEN 'ValueError: no web address' ELSE CASE WHEN text = '' THEN 'empty' END END AS error FROM (SELECT doc_id, ['pdf', 'docx', 'doc', 'html', 'html'][doc_id % 5 + 1] AS kind,
  CASE doc_id % 5 WHEN 0 THEN array_to_string(list_transform(range(0, {_PAGES}), lambda p: {_CLEAN.format("array_to_string(lines[p * 40 + 1:p * 40 + 40], chr(10))")}), chr(10) || chr(10))
    WHEN 1 THEN {_CLEAN.format("array_to_string(lines, chr(10))")} WHEN 3 THEN {_CLEAN.format(f"array_to_string(list_transform(lines, lambda x: {_TRIM.format('x')}), chr(10))")} END AS text FROM ({_LINES}))""")
def s05_s10_fetched(spark, sf_dir):
    """Documents as PDF, DOCX, an old format and HTML, each in an address that holds it, fetched and extracted; some addresses are none."""
    made = _files(spark, sf_dir, _of_id(_KINDS, F.col("doc_id")))
    i = F.col("doc_id")
    held = F.concat(F.lit("data:"), _of_id((*_TYPES, ""), i), F.lit(";base64,"), F.translate(F.base64("content"), "\r\n", ""))
    addresses = made.select("doc_id", F.when(i % 5 == 4, F.lit("nowhere")).otherwise(held).alias("url"))
    return S.fetch_documents(addresses, pdf_reader=pdf.read, schemes=("data:",)).select("doc_id", "kind", "text", "error")


@query("""SELECT doc_id, 'text' AS kind, CASE WHEN doc_id % 3 < 2 THEN 'f-' || md5(coalesce(text, '')) END AS text, CASE WHEN doc_id % 3 = 2 THEN 'no file id in the link' END AS error FROM documents""")
def s11_shared(spark, sf_dir):
    """Links to shared files, by two forms or without an id; a file holds its id."""
    i, name = F.col("doc_id"), F.concat(F.lit("f-"), F.md5(F.coalesce("text", F.lit(""))))
    url = F.when(i % 3 == 0, F.concat(F.lit("https://drive.google.com/file/d/"), name, F.lit("/view?usp=sharing"))).when(i % 3 == 1, F.concat(F.lit("https://drive.google.com/open?id="), name)).otherwise("https://drive.google.com/x")
    links = X.read(spark, sf_dir, "documents").select("doc_id", url.alias("url"))
    return S.fetch_shared(links, pdf_reader=pdf.read, template="data:text/plain,{id}", schemes=("data:",)).select("doc_id", "kind", "text", "error")


@query(_with(X.CHUNKS, X.DOCUMENTS) + r"SELECT id, CASE WHEN NOT is_active OR id % 4 <> 1 THEN 'skip' WHEN u IS NOT NULL THEN 'fetch' WHEN length(coalesce(text, '')) > 0 THEN 'reindex' ELSE 'skip' END AS action FROM (SELECT *, nullif(regexp_extract(source_ref, 'https?://[^\s`]+'), '') AS u FROM docs)")
def p06_subset(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    return M.reindex_plan(d, d.where("id % 4 = 1").select("id")).select("id", "action")


@query(_with(X.RUNS) + """SELECT run, id, category, coalesce(error, CASE WHEN id % 17 = 0 THEN 'bad' END) AS error, id % 17 <> 0 AND passed AS passed,
  CASE WHEN id % 17 <> 0 THEN conclusion_score END AS conclusion_score, CASE WHEN id % 17 <> 0 THEN required_concepts_score END AS required_concepts_score, NULL::DOUBLE AS actionability_score FROM runs""")
def e11_flat_runs(spark, sf_dir):
    """Lines of results: scores as a struct, or the record of an error in their place."""
    i = F.col("id")
    bad = F.struct(F.lit(False).alias("passed"), F.lit("bad").alias("error"), F.lit(None).cast("double").alias("conclusion_score"), F.lit(None).cast("double").alias("required_concepts_score"))
    good = F.struct("passed", F.lit(None).cast("string").alias("error"), "conclusion_score", "required_concepts_score")
    lines = X.runs(spark, sf_dir).select("run", "id", "category", "error", F.when(i % 17 == 0, bad).otherwise(good).alias("score"))
    return E.flat_runs(lines).select("run", "id", "category", "error", "passed", "conclusion_score", "required_concepts_score", "actionability_score")


@query(_with(X.CHUNKS) + f"SELECT '{lexforge.__version__}' AS version, count(*) AS total_chunks FROM chunks")
def h01_version(spark, sf_dir):
    return A.version(X.chunks(spark, sf_dir), lexforge.__version__)


_UPLOADS = ("pdf", "docx", "txt", "pdf", "docx", "DOCX")


def _embedder(texts: list[str]) -> list[list[float]]:
    if any(POISON in t for t in texts):
        raise RuntimeError("no vector")
    return [[float(len(t)), 1.0] for t in texts]


@query(_with(X.CHUNKS, X.DOCUMENTS, f"up AS (SELECT doc_id AS id, doc_id % 6 AS m, lines FROM ({_LINES}))",
    "state AS (SELECT id, m, lines, CASE WHEN m = 2 THEN 'refused' WHEN m = 4 THEN 'failed' WHEN m = 3 OR len(lines) = 0 THEN 'refused' ELSE 'ready' END AS status FROM up)",
    "old AS (SELECT document_id AS id, count(*) AS n FROM chunks GROUP BY 1)") + f"""SELECT id, status, CASE WHEN m = 2 THEN 'unsupported_type,no_text' WHEN m = 4 THEN 'RuntimeError: no vector' WHEN status = 'refused' THEN 'no_text' END AS error,
  CASE WHEN status = 'ready' THEN 'ready' WHEN status = 'failed' THEN 'failed' ELSE docs.index_status END AS index_status,
  CASE WHEN status = 'ready' THEN CASE WHEN m = 0 THEN {_PAGES} ELSE 1 END WHEN docs.id IS NULL AND status = 'failed' THEN 0 ELSE docs.chunk_count END::BIGINT AS chunk_count,
  CASE WHEN status = 'ready' THEN CASE WHEN m = 0 THEN {_PAGES} ELSE 1 END ELSE coalesce(old.n, 0) END::BIGINT AS live
  FROM state LEFT JOIN docs USING (id) LEFT JOIN old USING (id)""")  # fmt: skip
def h05_ingest(spark, sf_dir):
    """Uploads of all documents at once: PDF and DOCX become chunks, the rest is refused or fails alone; ids that are there already are indexed again."""
    i = F.col("doc_id")
    kind = F.lower(_of_id(_UPLOADS, i))
    rows = _files(spark, sf_dir, kind)
    title = F.concat(F.lit("file "), i.cast("string"), F.lit("."), _of_id(_UPLOADS, i))
    poison = F.unbase64(F.lit(base64.b64encode(_docx([POISON])).decode()))
    uploads = rows.select(i.alias("id"), title.alias("title"), F.when(i % 6 == 3, F.encode(F.lit("no file"), "utf-8")).when(i % 6 == 4, poison).otherwise(F.col("content")).alias("content"))
    documents = migrate(X.documents(spark, sf_dir), DOCUMENTS)
    docs, kept, outcomes = ingest.ingest(documents, migrate(X.chunks(spark, sf_dir), CHUNKS), uploads, _embedder, "2024-01-02 03:04:05", **WHOLE)
    live = kept.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("live"))
    out = outcomes.select("id", "status", "error").join(docs.select("id", "index_status", "chunk_count"), "id", "left").join(live, "id", "left")
    return out.withColumn("live", F.coalesce("live", F.lit(0)))


@query(_with(X.CHUNKS, X.DOCUMENTS, rf"done AS (SELECT *, is_active AND source_type = 'url' AS asked, {_CLEAN.format(_TRIM.format('text'))} AS new FROM docs)", "what AS (SELECT *, asked AND id % 4 <> 0 AND coalesce(new, '') <> '' AS good FROM done)") + f"""SELECT id, good AS fetched,
  CASE WHEN NOT asked THEN NULL WHEN id % 4 = 0 THEN 'TimeoutError: late' WHEN text IS NULL THEN 'unreadable' WHEN new = '' THEN 'empty' END AS error, CASE WHEN good THEN new ELSE text END AS text, CASE WHEN good THEN {_TOKENS.format("new")} ELSE token_count END AS token_count,
  CASE WHEN NOT asked THEN index_status WHEN good THEN 'ready' ELSE 'failed' END AS index_status, CASE WHEN good THEN 1 ELSE chunk_count END::BIGINT AS chunk_count FROM what""")
def m15_apply(spark, sf_dir):
    """Documents from addresses fetched again, for good: texts, tokens, statuses and counts; what fails stays as it is."""
    d = migrate(X.documents(spark, sf_dir), DOCUMENTS)
    text = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    pages = d.select("id", F.encode(F.concat(F.lit("<script>x</script><p>"), text, F.lit("</p>")), "utf-8").alias("content"))

    def fetch(plan: DataFrame) -> DataFrame:
        lost = F.col("id") % 4 == 0
        got = plan.join(pages, "id").withColumns({"content": F.when(~lost, F.col("content")), "content_type": F.lit("text/html"), "error": F.when(lost, "TimeoutError: late")})
        return S.extract(got, between_pages="\n\n")

    docs, _, outcomes = M.reingest(d, migrate(X.chunks(spark, sf_dir), CHUNKS), fetch, apply=True, at="2024-01-02 03:04:05", **WHOLE)
    out = docs.join(outcomes.select("id", "outcome", F.col("error").alias("failure")), "id", "left")
    return out.select("id", F.coalesce(F.col("outcome") == "succeeded", F.lit(False)).alias("fetched"), F.col("failure").alias("error"), "text", "token_count", "index_status", "chunk_count")


def _pamphlets(frames):
    for f in frames:
        said = [f"{L.PARAMETER_PHRASE} {10 + y % 50},{100 + y % 900} a year" if y % 5 else "nothing" for y in f["tax_year"]]
        yield f.assign(content=[pdf.write([["x"], [x]]) for x in said], error=None)


@query("""SELECT o_orderkey AS query_id, y AS tax_year, CASE WHEN y % 7 = 0 THEN 'known' WHEN y % 5 > 0 AND y < 2032 THEN (10 + y % 50)::VARCHAR || ',' || (100 + y % 900)::VARCHAR END AS amount
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 2000 + o_orderkey % 40 END::INT AS y FROM orders)""")
def r14_fetched_parameters(spark, sf_dir):
    """Years that questions ask for and no row has are fetched, each once, from addresses of some years, and then looked up."""
    i = F.col("o_orderkey")
    about = F.concat(F.lit(f"{L.PARAMETER_TERMS[0]} {L.PARAMETER_SUBJECT} "), (2000 + i % 40).cast("string"))
    questions = X.read(spark, sf_dir, "orders").select(i.alias("query_id"), F.when(i % 3 < 2, about).otherwise("hello").alias("question"))
    years = spark.range(2000, 2040).select(F.col("id").cast("int").alias("tax_year"))
    known = migrate(years.where("tax_year % 7 = 0").select("tax_year", F.lit(L.PARAMETER_KEY).alias("parameter_key"), F.lit("known").alias("value_text"), F.lit("u").alias("unit"), F.lit("t").alias("source_title"), F.lit("http://x/").alias("source_url")), PARAMETERS)
    sources = years.where("tax_year < 2032").select("tax_year", F.lit("t").alias("source_title"), F.lit("http://x/").alias("source_url"), F.lit("2").alias("source_page"))
    fetch = lambda rows: rows.mapInPandas(_pamphlets, "tax_year int, url string, content binary, error string")
    now, _ = C.complete_parameters(questions, known, sources, 2024, "2024-02-03 00:00:00", fetch)
    out = C.parameter_context(questions, now, 2024)
    amount = F.regexp_extract("parameter_context", r"(\d+,\d{3}|known)", 1)
    return out.select("query_id", F.col("tax_year").cast("int").alias("tax_year"), F.when(amount != "", amount).alias("amount"))


# -- streams of events ---------------------------------------------------------------


def _event_lines(spark, sf_dir: str) -> DataFrame:
    """Turns as events, numbered from 0: each fifth is a thought, some seventh an error; all but some conversations end with usage and done."""
    i = F.col("id")
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text")) - 1
    c = X.read(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("id"), nth.cast("long").alias("nth"), "text")
    kind = F.when(F.col("nth") % 5 == 3, "thinking").when((i % 11 == 0) & (F.col("nth") == 7), "error").otherwise("text")
    turns = c.select("id", "nth", F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), "text"))).alias("line"))
    ends = c.groupBy("id").agg(F.max("nth").alias("m")).where(i % 4 != 0)
    end = lambda k, line: ends.select("id", (F.col("m") + k).alias("nth"), line.alias("line"))
    usage = F.concat(F.lit('data: {"type":"usage","data":{"input_tokens":'), i.cast("string"), F.lit("}}"))
    return turns.unionByName(end(1, usage)).unionByName(end(2, F.lit('data: {"type":"done"}')))


_EVENTS = """c AS (SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) - 1 AS nth, text FROM conversations WHERE conv_id IS NOT NULL),
stream AS (SELECT id, max(nth) AS m, id % 11 = 0 AND max(nth) >= 7 AS bad FROM c GROUP BY 1),
said AS (SELECT id, m, bad, coalesce(string_agg(text, '' ORDER BY nth) FILTER (nth % 5 <> 3 AND (NOT bad OR nth < 7)), '') AS text, coalesce(max(text) FILTER (bad AND nth = 7), CASE WHEN bad THEN 'unknown error' END) AS error FROM c JOIN stream USING (id) GROUP BY 1, 2, 3)"""


@query(_with(_EVENTS) + "SELECT id, text, error FROM said")
def s21_event_text(spark, sf_dir):
    return S.event_text(_event_lines(spark, sf_dir))


@query(_with(_EVENTS) + "SELECT id::VARCHAR AS id, text, error, CASE WHEN NOT bad THEN '{\"input_tokens\":' || id::VARCHAR || '}' END AS usage, CASE WHEN bad THEN 8 ELSE m + 3 END::BIGINT AS events FROM said WHERE bad OR id % 4 <> 0")
def h02_answer_stream(spark, sf_dir):
    """The same events as a stream, in four micro-batches by a hash, so that those of an answer come in any order, and some of them twice."""
    lines = _event_lines(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("id", "nth"), F.lit(4)))
    again = lines.where("nth % 6 = 1").withColumn("part", (F.col("part") + 1) % 4)
    where = scratch_path(spark, "events")
    lines.unionByName(again).repartition(4, "part").write.parquet(f"{where}/lines")
    stream = spark.readStream.schema(lines.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/lines")
    answers.answers(stream, f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return answers.answered(spark, f"{where}/out")
