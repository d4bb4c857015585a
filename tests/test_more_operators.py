"""Ranks in ranges, tokenizers, fetching, reindexing, comparison of runs and the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import Window as W, functions as F

from lexforge import cli
from lexforge.functions import text as T
from lexforge.functions.tokens import ESTIMATE, Library
from lexforge.operators import audit, catalog as M, chunking as K, context as C, evaluation as E, ranking as R
from lexforge.sources import files as S


def test_ranks_in_ranges(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("query_id"), (F.col("id") * 7919 % 501).alias("document_id"), F.col("id").cast("int").alias("chunk_index"), F.when(F.col("id") % 50 != 0, F.round(F.sin("id"), 2)).alias("score"))
    fine = [F.desc("score"), *(F.col(c) for c in R.ORDER)]
    got = R.ranked(rows, "place", [F.floor(F.col("score") * -R.STEPS)], fine)
    want = rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*fine)))
    key = lambda df: sorted(map(str, df.select("query_id", "chunk_index", "place").collect()))
    assert key(got) == key(want)


def naive_split(text, most, overlap, size):
    if size(text) <= most:
        return [text]
    words, out, at = text.split(), [], 0
    while at < len(words):
        ends = [e for e in range(at + 1, len(words) + 1) if size(" ".join(words[at:e])) <= most]
        if not ends:
            return out
        out.append(" ".join(words[at : ends[-1]]))
        if ends[-1] == len(words):
            return out
        at = max(ends[-1] - overlap, at + 1)
    return out


def test_tokenizers_in_place_of_the_estimate(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    real = Library(tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(f"word{i} naïve" for i in range(60))
    for sizer in (ESTIMATE, real):
        for most, overlap in ((20, 3), (45, 0), (50, 60)):
            parts = K.split_to_limit(text, most, overlap, sizer)
            assert parts == naive_split(text, most, overlap, sizer.size) and all(sizer.size(p) <= most for p in parts)
    assert all(real.size(p) <= 9 for p in K.split_to_limit("x1y2" * 50, 8, 0, real))
    docs = spark.createDataFrame([(1, text, "t"), (2, "short", "u"), (3, None, "v")], "document_id long, text string, title string")
    got = K.chunk_documents(docs, most=50, overlap=5, sizer=real, keep=("title",)).orderBy("document_id", "chunk_index").collect()
    assert [r.content for r in got if r.document_id == 1] == K.split_to_limit(text, 50, 5, real) and {r.title for r in got} == {"t", "u"}
    blocks = spark.createDataFrame([(["naïve " * 9, "b " * 300, "c"],)], "b array<string>")
    budget = real.size("naïve " * 9) + real.size("c")
    assert len(blocks.select(C.fit(F.col("b"), budget, real).alias("x")).first().x) == 2
    assert len(blocks.select(C.fit(F.col("b"), budget - 1, real).alias("x")).first().x) == 1


def test_expanded_queries_are_embedded(spark):
    q = R.expand(spark.createDataFrame([(1, "הלוואה מקרן השתלמות", 0), (2, "x", 3)], "query_id long, question string, messages int"))
    got = {r.query_id: r.vectors for r in C.embed_queries(q, lambda ts: [[float(len(t)), 1.0] for t in ts]).collect()}
    assert [len(got[1]), len(got[2])] == [3, 1] and got[2] == [[1.0, 1.0]]


def test_answer_context(spark):
    chunks = spark.createDataFrame([(i, 0, f"text {i} about loans", "", f"t{i}", "r", None, None, None, [1.0, float(i)]) for i in range(9)], "document_id long, chunk_index int, content string, section_header string, document_title string, document_ref string, effective_date string, page_start int, page_end int, embedding array<double>")
    docs = spark.createDataFrame([(i, True, None, None, None, None) for i in range(9)], "id long, is_active boolean, superseded_by long, valid_until string, document_type string, effective_date string")
    p = spark.createDataFrame([("training_fund_favored_deposit_limit", 2026, "20,566", "ILS", "book", "http://x", "12", "official")], "parameter_key string, tax_year int, value_text string, unit string, source_title string, source_url string, source_page string, source_type string")
    q = spark.createDataFrame([(1, "כמה בקרן השתלמות", 0), (2, "loans", 4), (3, "a long question about loans " * 4, 0)], "query_id long, question string, messages int")
    got = {r.query_id: r for r in C.answer_context(q, chunks, docs, p, "2026-01-01", embedder=lambda ts: [[1.0, 0.0]] * len(ts), instructions=" i ", contract="c").collect()}
    assert got[1].context.startswith("[[TAX-PARAM-2026]]") and "[[SOURCE" in got[1].context and not got[1].follow_up
    assert got[2].follow_up and got[2].context.count("[[SOURCE") == C.FOLLOW_UP_K and got[2].message.endswith("loans") and got[3].context.count("[[SOURCE") == 9
    assert got[3].instructions == "i\n\nc"


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("location", "/page")
            self.end_headers()
            return
        self.send_response(404 if self.path == "/none" else 200)
        self.send_header("content-type", "text/html" if self.path != "/plain?id=abc" else "text/plain")
        self.end_headers()
        self.wfile.write("<nav>menu</nav><p>Hello <b>you</b></p>".encode() if self.path == "/page" else b"a   b")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def web():
    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetching(spark, web):
    rows = spark.createDataFrame([(1, f"{web}/moved"), (2, f"{web}/none"), (3, None), (4, "file:///etc/passwd"), (5, f"{web}/old.doc")], "id long, url string")
    got = {r.id: r for r in S.fetch_documents(rows).collect()}
    assert got[1].text == "Hello\nyou" and got[1].url.endswith("/page") and got[1].error is None
    assert "404" in got[2].error and got[3].error and got[4].error and got[5].error == "legacy format"
    links = spark.createDataFrame([(1, "https://d.example/file/d/abc/view"), (2, "nothing")], "id long, url string")
    got = {r.id: r for r in S.fetch_shared(links, template=web + "/plain?id={id}").collect()}
    assert got[1].text == "a b" and got[2].error == "no file id in the link"


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one  x|two|")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    read = lambda content: content.decode().split("|") if b"|" in content else 1 / 0
    got = {r.url.rsplit("/", 1)[1]: r for r in S.extract(S.read_files(spark, str(tmp_path)), pdf_reader=read).collect()}
    assert got["a.pdf"].text == "one x\ntwo" and [(p.page_number, p.text) for p in got["a.pdf"].pages] == [(1, "one x"), (2, "two"), (3, "")]
    assert got["b.pdf"].error == "unreadable"
    chunks = K.chunk(spark.createDataFrame([(1, got["a.pdf"].text, [(1, "one x"), (2, "two"), (3, "")])], "document_id long, text string, pages array<struct<page_number:int,text:string>>"))
    assert [(r.chunk_index, r.page_start) for r in chunks.orderBy("chunk_index").collect()] == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="pypdf"):
        S.extract(S.read_files(spark, str(tmp_path))).collect()


def documents(spark, web):
    rows = [(1, "t1", "url", f"see `{web}/page`", "old", True), (2, "t2", "url", "no address", "old", True), (3, "t3", "url", f"{web}/none", "old", True), (4, "t4", "pdf", "f", "body", True), (5, "t5", "pdf", "g", "", True), (6, "t6", "pdf", "h", "body", False)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, title string, source_type string, source_ref string, text string, is_active boolean, source_checksum string, token_count long")
    chunks = spark.createDataFrame([(i, 0, "old chunk", None, "t") for i in range(1, 7)], "document_id long, chunk_index int, content string, section_header string, document_title string")
    return docs, chunks


def test_reingest(spark, web):
    docs, chunks = documents(spark, web)
    same, _, plan = M.reingest(docs, chunks, S.fetch_documents)
    assert same is docs and {r.id: r.outcome for r in plan.collect()} == {1: "would be fetched", 2: "skipped", 3: "would be fetched"}
    new, new_chunks, outcomes = M.reingest(docs, chunks, S.fetch_documents, apply=True)
    assert {r.id: (r.outcome, r.chunks) for r in outcomes.collect()} == {1: ("succeeded", 1), 2: ("skipped", 0), 3: ("failed", 0)}
    assert {r.id: r.text for r in new.collect()}[1] == "Hello\nyou" and {r.id: r.source_checksum for r in new.collect()}[3] == "x"
    assert {r.document_id: (r.content, r.document_title) for r in new_chunks.collect()}[1] == ("Hello\nyou", "t1") and new_chunks.count() == 6
    only = M.reingest(docs, chunks, S.fetch_documents, spark.createDataFrame([(3,)], "id long"))[2].collect()
    assert [r.id for r in only] == [3]


def test_reindex(spark, web):
    docs, chunks = documents(spark, web)
    new, outcomes = M.reindex(docs, chunks, embedder=lambda ts: [[1.0]] * len(ts))
    assert {r.id: r.outcome for r in outcomes.collect()} == {1: "succeeded", 2: "succeeded", 3: "succeeded", 4: "succeeded", 5: "failed"}
    got = {r.document_id: r.content for r in new.collect()}
    assert got[4] == "body" and got[5] == got[6] == "old chunk"


def test_texts_on_disk(spark, tmp_path):
    where = str(tmp_path / "texts")
    S.write_texts(spark.createDataFrame([(1, "a\nb\n"), (2, None)], "id long, text string"), where)
    assert {r.id: r.text for r in S.read_text_of(spark, where).collect()}[1] == "a\nb\n"
    assert S.delete_text(spark, where, 1) and not S.delete_text(spark, where, 1)


def test_versions_of_two_writers(spark, tmp_path):
    where = str(tmp_path / "table")
    a, b = M.publish(spark.range(1), where), M.publish(spark.range(2), where)
    assert M.versions(spark, where)[-1].endswith(b.rsplit("/", 1)[1]) and a != b and M.current(spark, where).count() == 2


def runs(spark):
    base = [(1, "a", None, {"passed": True, "error": None, "conclusion_score": 1.0}), (2, None, None, {"passed": False, "error": None, "conclusion_score": 0.0}), (3, "a", "late", {"passed": False, "error": "late", "conclusion_score": None}), (9, "z", None, {"passed": True, "error": None, "conclusion_score": 1.0})]
    cand = [(1, "other", None, {"passed": False, "error": None, "conclusion_score": 0.5}), (2, "other", None, {"passed": False, "error": "x", "conclusion_score": 0.0}), (3, "a", None, {"passed": True, "error": None, "conclusion_score": 1.0})]
    schema = "id long, category string, error string, score struct<passed:boolean,error:string,conclusion_score:double>"
    return E.flat_runs(spark.createDataFrame(base, schema)), E.flat_runs(spark.createDataFrame(cand, schema))


def test_compared(spark):
    rows = E.compared(*runs(spark)).collect()
    assert [(r.category, r.n) for r in rows] == [(None, 3), ("a", 2), ("uncategorized", 1)]
    assert (rows[0].base_passed, rows[0].candidate_passed, rows[0].base_errors, rows[0].candidate_errors) == (1, 1, 1, 1)
    assert rows[0].passed_delta == "   1 ->    1 (  0)" and rows[0].conclusion_score_delta == "0.333 -> 0.500 (+0.167)"
    v = E.verdict(E.paired(*runs(spark))).first()
    assert (v.verdict, v.exit_code, v.gained, v.lost) == ("candidate >= baseline", 0, 1, 1)


def test_report_is_one_json_object(spark):
    docs = spark.createDataFrame([(1, "t\"é", "pdf", "r", "text", True, 1, None, None, None), (2, "u", "pdf", "r", None, True, 0, "2020-01-01", None, "2019-01-01")], "id long, title string, source_type string, source_ref string, text string, is_active boolean, chunk_count long, effective_date string, superseded_by long, valid_until string")
    chunks = spark.createDataFrame([(1,), (1,)], "document_id long")
    audited = audit.documents(docs, chunks, "2024-01-01")
    got = json.loads("\n".join(r.line for r in audit.report(audited).collect()))
    assert got["summary"]["validity"] == {"current": 1, "superseded": 0, "expired": 1, "undated": 1} and got["issues"] == {"missing_text_file": 1, "no_chunks": 1}
    assert [d["id"] for d in got["documents"]] == [1, 2] and got["documents"][0]["title"] == 't"é' and got["documents"][1]["effective_date"] == "2020-01-01" and got["documents"][0]["superseded_by"] is None


def test_review_sheet(spark, tmp_path):
    cases = spark.createDataFrame([("1", True, "Q?", "official", None, ["c"], True, ["t1", "t2"]), ("2", False, "R?", None, "http://u", [], False, None)], "id string, executed boolean, question string, source_type string, url string, expected_conclusion array<string>, requires_clarification boolean, clarification_terms array<string>")
    got = {r.id: r.markdown.split("\n") for r in S.review_sheet(cases).collect()}
    assert got["1"][0] == "### 1. Q?" and "**נדרשת הבהרה:** כן — t1, t2" in got["1"] and "**מקור:** http://u" in got["2"] and not any("מסקנה" in x for x in got["2"])
    S.write_review(cases, str(tmp_path / "sheet"), "Title")
    text = "\n".join(p.read_text() for p in (tmp_path / "sheet").glob("part-*"))
    assert text.startswith("# Title") and text.index("### 1. Q?") < text.index("### 1. R?")


def test_command_line(spark, tmp_path, capsys):
    for name, passed in (("base", [True, True]), ("cand", [True, False])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"id": str(i), "category": "c", "error": None, "score": {"passed": p, "conclusion_score": 1.0 * p}}) for i, p in enumerate(passed)))
    assert cli.main(["compare", str(tmp_path / "base.jsonl"), str(tmp_path / "cand.jsonl")]) == 1
    assert "candidate REGRESSED" in capsys.readouterr().out
    assert cli.main(["compare", str(tmp_path / "base.jsonl"), str(tmp_path / "base.jsonl")]) == 0
    capsys.readouterr()
    d = "id long, title string, source_type string, source_ref string, text string, is_active boolean, chunk_count long, effective_date string, superseded_by long, valid_until string"
    spark.createDataFrame([(1, "t", "pdf", "r", "some text", True, 1, None, None, None)], d).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, 0, "old", None)], "document_id long, chunk_index int, content string, section_header string").write.parquet(str(tmp_path / "chunks"))
    assert cli.main(["audit", str(tmp_path / "docs"), str(tmp_path / "chunks"), "--as-of", "2024-01-01"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["documents"] == 1
    assert cli.main(["reindex", str(tmp_path / "docs"), str(tmp_path / "chunks"), str(tmp_path / "new")]) == 0
    assert [r.content for r in M.current(spark, str(tmp_path / "new")).collect()] == ["some text"]


def test_names_of_downloads(spark):
    df = spark.createDataFrame([("a/b.pdf", "/x/1.bin"), ("", "/x/1.bin"), (None, "/x/1.bin"), ("..x", "/x")], "t string, p string")
    got = df.select(T.download_name(F.col("t"), F.col("p")).alias("o"), T.download_name(F.col("t"), text=True).alias("x")).collect()
    assert [(r.o, r.x) for r in got] == [("b.pdf", "b.txt"), ("1.bin", "document.txt"), ("1.bin", "document.txt"), ("..x", "..x.txt")]
