"""Operators on small tables."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import analytics as A, audit, catalog as M, chunking as K, context as C, evaluation as E, ranking as R
from lexforge.schemas import DOCUMENT_DEFAULTS, DOCUMENTS, migrate
from lexforge.sources import files as S
from lexforge.streaming import incremental

CHUNK = "document_id long, chunk_index int, content string, section_header string, document_title string, document_ref string, effective_date string, page_start int, page_end int, embedding array<double>"


def chunk(d, i, content, title="t", ref="r", v=(1.0, 0.0), section=""):
    return (d, i, content, section, title, ref, None, None, None, list(v))


def retrieve(spark, question, chunks, docs=None, **how):
    ids = sorted({c[0] for c in chunks})
    docs = docs or [(i, True, None, None, None, None) for i in ids]
    q = R.expand(spark.createDataFrame([(1, question, [[1.0, 0.0]])], "query_id long, question string, vectors array<array<double>>"))
    d = spark.createDataFrame(docs, "id long, is_active boolean, superseded_by long, valid_until string, document_type string, effective_date string")
    return R.retrieve(q, spark.createDataFrame(chunks, CHUNK), d, R.Retrieval(**how), as_of="2024-01-01")


def order(ranked):
    return [(r.document_id, r.chunk_index) for r in ranked.orderBy("rank").collect()]


def test_exact_reference_beats_similarity(spark):
    got = retrieve(spark, "מה אומר חוזר 2016-9-17", [chunk(1, 0, "x"), chunk(2, 0, "y", title="חוזר 2016-9-17", v=(0.0, 1.0))])
    assert order(got)[0] == (2, 0)


def test_document_cap_and_ties(spark):
    got = retrieve(spark, "zz", [chunk(1, i, "x") for i in range(5)] + [chunk(2, 0, "x")])
    assert order(got) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_validity_penalty_and_inactive(spark):
    docs = [(1, True, 2, None, None, None), (2, True, None, None, None, None), (3, False, None, None, None, None)]
    got = retrieve(spark, "zz", [chunk(1, 0, "x"), chunk(2, 0, "x"), chunk(3, 0, "x")], docs)
    assert order(got) == [(2, 0), (1, 0)]


def test_forced_evidence_goes_first(spark):
    chunks = [chunk(1, i, f"a {i}") for i in range(6)] + [chunk(1, 6, "x 8(ד) y", v=(0.0, 1.0)), chunk(1, 7, "z 50 אחוז", v=(0.0, 1.0))]
    assert order(retrieve(spark, "הלוואה מתוך קרן השתלמות", chunks, k=3)) [:2] == [(1, 7), (1, 6)]
    assert (1, 7) not in order(retrieve(spark, "הלוואה", chunks, k=3))


def test_expansion(spark):
    q = spark.createDataFrame([("זכויות עמית: העברה ועיקול",), ("זכויות עמית ועיקול",), ("הלוואה מקרן השתלמות",), ("x",)], "question string")
    assert [len(r.queries) for r in R.expand(q).collect()] == [3, 1, 3, 1]


def test_consensus_and_cosine(spark):
    row = spark.range(1).select(R.consensus(F.array(F.lit(0.5), F.lit(0.4), F.lit(0.1))), R.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0)))).first()
    assert row[0] == pytest.approx(0.51) and row[1] == pytest.approx(0.96)


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(["a" * 100, "b" * 1000, "c" * 50],)], "b array<string>")
    assert [x[0] for x in df.select(C.fit(F.col("b"), 110)).first()[0]] == ["a", "c"]


def test_context_blocks(spark):
    chunks = spark.createDataFrame([chunk(1, i, f"c{i}") for i in range(4)] + [chunk(2, 0, "d0")], CHUNK)
    ranked = spark.createDataFrame([(1, 2, 0, 1, "expired", None), (1, 1, 2, 2, "current", "2020-01-01")], "query_id long, document_id long, chunk_index int, rank int, validity_status string, effective_date string")
    text = C.context(ranked, chunks).first().context
    assert text.startswith("=== t | r | [פג תוקף] ===\n\n[[SOURCE D2-C1 |") and text.index("D1-C2") < text.index("D1-C3") < text.index("D1-C4") and "D1-C1 " not in text
    assert "=== t | r | תוקף: 2020-01-01 ===" in text


def test_sources_footer(spark):
    f = lambda a, c: spark.createDataFrame([(a, c)], "a string, c string").select(C.with_sources(F.col("a"), F.col("c"))).first()[0]
    ev = "[[SOURCE D1-P2 | x]]..[[SOURCE D1-P2 | y]][[TAX-PARAM-2026]]\nמקור: book | p\nURL: https://a.b/c\n"
    assert f("ans ", ev) == "ans\n\n---\nמקורות שנשלפו:\n* [D1-P2] x\n* [TAX-PARAM-2026] book | URL: https://a.b/c"
    assert f("ans", "none") == "ans"
    assert f("מקורות שנשלפו [DTAX-PARAM-2026]", ev) == "מקורות שנשלפו [TAX-PARAM-2026]\n* [TAX-PARAM-2026] book | URL: https://a.b/c"


def brute_pack(docs, budget):
    est = lambda t: max(int(len(t.encode()) * 0.7), 1) if t else 0
    used, out = 0, []
    for d, text, score in sorted(docs, key=lambda x: (-x[2], x[0])):
        n = est(text)
        if used + n <= budget:
            used += n
            out.append((d, len(text)))
            continue
        left, size = budget - used, 0
        if left > 3000 and score > 0:
            size = int(len(text) * (left / n) * 0.8)
            while est(text[:size]) > left and size > 500:
                size = int(size * 0.8)
        if size > 500:
            used += est(text[:size])
            out.append((d, size))
        else:
            out.append((d, None))
    return out


def test_pack_documents(spark):
    docs = [(1, "a" * 6000, 0.5), (2, "b" * 500 + "é" * 9000, 0.4), (3, "c" * 400, 0.3), (4, "d" * 9000, 0.0), (5, "e" * 9000, 0.2)]
    df = spark.createDataFrame([(1, d, f"t{d}", t, s) for d, t, s in docs], "query_id int, document_id long, title string, text string, score double")
    for budget in (3000, 8000, 12_000, 30_000):
        got = [(r.document_id, None if r.skipped else len(r.text.removesuffix("\n[... המסמך נחתך עקב מגבלת גודל ...]"))) for r in C.pack_documents(df, budget).orderBy("place").collect()]
        assert got == brute_pack(docs, budget)


@pytest.mark.parametrize("parts", [1, 7])
def test_pack_many_documents_of_a_question(spark, monkeypatch, parts):
    monkeypatch.setattr(C, "BLOCK", 8)
    rng = random.Random(parts)
    of = {q: [(d, rng.choice("abé") * rng.choice([0, 3, 900, 4000, 7000]), rng.choice([0.0, 0.1, 0.2, 0.5])) for d in range(n)] for q, n in ((1, 60), (2, 3), (3, 25))}
    df = spark.createDataFrame([(q, d, f"t{d}", t, s) for q, v in of.items() for d, t, s in v], "query_id int, document_id long, title string, text string, score double").repartition(parts)
    seen = []
    walk = C._walk

    def watched(budget, least):
        seen.append(budget)
        return walk(budget, least)

    monkeypatch.setattr(C, "_walk", watched)
    for budget in (9000, 30_000):
        got = C.pack_documents(df, budget).orderBy("query_id", "place").collect()
        for q, docs in of.items():
            mine = [(r.document_id, None if r.skipped else len(r.text.removesuffix("\n[... המסמך נחתך עקב מגבלת גודל ...]"))) for r in got if r.query_id == q]
            assert mine == brute_pack(docs, budget)
            assert [r.place for r in got if r.query_id == q] == list(range(1, len(docs) + 1))
    assert len(seen) > 4
    assert C.pack_documents(df.limit(0), 9000).collect() == []


def test_parameter_context(spark):
    p = spark.createDataFrame([("training_fund_favored_deposit_limit", 2025, "20,566", "ILS", "book", "http://x", None, None)], "parameter_key string, tax_year int, value_text string, unit string, source_title string, source_url string, source_page string, source_type string")
    q = spark.createDataFrame([(1, "כמה בקרן השתלמות ב 2025"), (2, "כמה בקרן השתלמות"), (3, "שלום")], "id int, question string")
    got = {r.id: r.parameter_context for r in C.parameter_context(q, p, 2026).collect()}
    assert "20,566 ₪" in got[1] and "לא זמין" in got[1] and got[2] is None and got[3] is None


def test_sections_and_parts(spark):
    text = "פתיח\nסעיף 1 " + "א" * 50 + "\nסעיף 2 קצר\nסעיף 3 " + "ב " * 30 + "\n1. " + "ג" * 45
    docs = spark.createDataFrame([(1, text), (2, "no sections"), (3, " "), (4, None), (5, "w " * 20_000)], "document_id long, text string")
    got = K.chunk_documents(docs).orderBy("document_id", "chunk_index").collect()
    assert [(r.chunk_index, r.section_header) for r in got if r.document_id == 1] == [(0, "סעיף 1"), (1, "סעיף 3"), (2, "1.")]
    assert [(r.section_header, r.content) for r in got if r.document_id == 2] == [("קטע 1", "no sections")]
    assert not [r for r in got if r.document_id in (3, 4)]
    parts = [r for r in got if r.document_id == 5]
    assert len(parts) > 1 and all(K.estimated(r.content) <= K.MOST_TOKENS for r in parts)


def test_split_to_limit():
    words = [f"w{i}" for i in range(3000)]
    parts = K.split_to_limit(" ".join(words), 700, 10)
    assert all(K.estimated(p) <= 700 for p in parts)
    for a, b in zip(parts, parts[1:]):
        assert a.split()[-10:] == b.split()[:10]
    assert parts[0].split()[0] == "w0" and parts[-1].split()[-1] == "w2999"
    assert "".join(K.split_to_limit("x" * 5000, 100)) == "x" * 5000


def test_pages_keep_numbers(spark):
    pages = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (1, 3, " ")], "document_id long, page_number int, text string")
    assert [(r.chunk_index, r.content, r.page_start) for r in K.chunk_pages(pages).orderBy("chunk_index").collect()] == [(0, "first", 1), (1, "second", 2)]
    both = spark.createDataFrame([(1, "flat", [(1, "page")]), (2, "flat", None)], "document_id long, text string, pages array<struct<page_number:int,text:string>>")
    assert {(r.document_id, r.content, r.page_start) for r in K.chunk(both).collect()} == {(1, "page", 1), (2, "flat", None)}


def test_embedding_in_batches(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(45)], "id int, content string")
    assert all(r.embedding == [float(len(r.content))] for r in K.embed(df, lambda ts: [[float(len(t))] for t in ts]).collect())
    with pytest.raises(Exception, match="embeddings"):
        K.embed(df, lambda ts: [[0.0]]).collect()


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "query_id int, item int, rank int")
    gold = spark.createDataFrame([(1, 2), (1, 4), (1, 9), (2, 1)], "query_id int, item int")
    got = {r.query_id: r for r in E.ranking_metrics(ranked, gold, 3).collect()}
    assert got[1].recall == pytest.approx(1 / 3) and got[1].precision == pytest.approx(1 / 3) and got[1].reciprocal_rank == 0.5 and got[1].average_precision == pytest.approx(1 / 3)
    assert list(got[2])[1:] == [0.0, 0.0, 0.0, 0.0]


def test_ranking_scores(spark):
    cases = spark.createDataFrame([("a", ["Doc  One", "Two"], None, ["Bad"]), ("b", None, ["two"], None)], "id string, relevant_documents array<string>, expected_documents array<string>, distractor_documents array<string>")
    ranked = spark.createDataFrame([("a", 1, "the doc one (long)", ""), ("a", 2, "bad thing", ""), ("b", 1, "x", "TWO")], "id string, rank int, title string, source_ref string")
    got = {r.id: r for r in E.score_rankings(cases, ranked).collect()}
    assert got["a"].found == ["Doc  One"] and got["a"].missing == ["Two"] and got["a"].distractors == ["Bad"] and not got["a"].passed
    assert got["b"].passed and got["b"].recall == 1.0


def test_answers(spark):
    schema = "id string, answer string, expected_citation_prefixes array<string>, any_citation_prefixes array<string>, must_include array<string>, must_not_include array<string>, expected_conclusion array<string>, required_concepts array<string>, required_actions array<string>, requires_clarification boolean, clarification_terms array<string>"
    df = spark.createDataFrame([("a", "yes [D1-P2] x", ["[D1"], ["[D9", "[D1"], ["yes"], ["no"], ["yes"], ["x", "z"], None, True, ["z"]), ("b", "no", None, ["[D9"], None, None, None, None, None, None, None)], schema)
    got = {r.id: r for r in E.guardrails(df).collect()}
    assert got["a"].passed and not got["b"].passed and got["b"].missing_any_citations == ["[D9"]
    got = {r.id: r for r in E.rubric(df).collect()}
    assert got["a"].required_concepts_score == 0.5 and got["a"].missing_required_concepts == ["z"] and not got["a"].passed and got["b"].conclusion_score == 1.0


def test_runs(spark):
    schema = "run string, id string, category string, passed boolean, error string, conclusion_score double, required_concepts_score double, actionability_score double, clarification_score double"
    df = spark.createDataFrame([("b", "1", "x", True, None, 1.0, 1.0, 1.0, 1.0), ("b", "2", None, False, "e", None, None, None, None), ("c", "1", "x", False, None, 0.0, 0.0, 0.0, 0.0), ("c", "3", "x", True, None, 1.0, 1.0, 1.0, 1.0)], schema)
    stats = {(r.run, r.category): r for r in E.run_stats(df).collect()}
    assert stats["b", None].conclusion_score == 0.5 and stats["b", "uncategorized"].errors == 1
    b, c = df.where("run = 'b'"), df.where("run = 'c'")
    assert {(r.id, r.only_in) for r in E.unpaired(b, c).collect()} == {("2", "base"), ("3", "candidate")}
    assert E.verdict(E.paired(b, c)).first().verdict == "candidate REGRESSED"


def test_catalog(spark):
    d = migrate(spark.createDataFrame([(1, "a 2024-1-2"), (2, "b"), (3, "c")], "id long, title string"), DOCUMENTS, DOCUMENT_DEFAULTS)
    c = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (9, 0, "z")], "document_id long, chunk_index int, document_title string")
    filled = {r.id: r for r in M.backfill(d, c).collect()}
    assert (filled[1].index_status, filled[1].chunk_count, filled[1].effective_date) == ("ready", 2, "2024-01-02") and filled[2].index_status == "failed"
    change = spark.createDataFrame([(1, "new", None, None, None)], "id long, title string, topic string, document_type string, lifecycle_status string")
    d2, c2 = M.set_metadata(d, c, change)
    assert {r.title for r in d2.collect()} == {"new", "b", "c"} and sorted(r.document_title for r in c2.collect()) == ["new", "new", "z"]
    with pytest.raises(Exception, match="unknown lifecycle"):
        M.set_metadata(d, c, change.withColumn("lifecycle_status", F.lit("odd")))[0].collect()
    status = spark.createDataFrame([(1, "failed", "why", None, None)], "id long, index_status string, index_error string, chunk_count long, at timestamp")
    assert {(r.id, r.index_error, r.chunk_count) for r in M.set_status(d, status).collect()} == {(1, "why", 0), (2, None, 0), (3, None, 0)}
    assert M.replace_chunks(c, c.where("false")).count() == 3  # nothing new deletes nothing
    gone = M.delete_documents(d, c, d.where("id = 1"))
    assert gone[0].count() == 2 and gone[1].count() == 1 and M.delete_documents(d, c, d.where("id = 1"), cascade=False)[1].count() == 3
    s = spark.createDataFrame([("k", "old", 1)], "key string, value string, at int")
    assert sorted((r.key, r.value, r.at) for r in M.upsert(s, spark.createDataFrame([("k", None, 2), ("n", "x", 2)], "key string, value string, at int"), ["key"], keep=("at",)).collect()) == [("k", None, 1), ("n", "x", 2)]
    assert M.insert_or_ignore(s, s.withColumn("value", F.lit("new")), ["key"]).first().value == "old"
    assert {(r.id, r.is_active) for r in M.archive(d, d.where("id = 2")).collect()} == {(1, True), (2, False), (3, True)}


def test_audit(spark):
    d = migrate(spark.createDataFrame([(1, "a", "text", True), (2, "b", None, True), (3, "c", "", False)], "id long, title string, text string, is_active boolean"), DOCUMENTS, DOCUMENT_DEFAULTS)
    a = audit.documents(d, spark.createDataFrame([(1,)], "document_id long"), "2024-01-01")
    assert {r.id: r.issues for r in a.collect()} == {1: [], 2: ["missing_text_file", "no_chunks"], 3: ["empty_extraction"]}
    assert audit.summary(a).first().unindexed == 1 and {r.issue for r in audit.issue_histogram(a).collect()} == {"missing_text_file", "no_chunks", "empty_extraction"}
    assert '"issues": {"empty_extraction":1' in audit.report(a).first().line


def test_conversations(spark):
    m = spark.createDataFrame([(1, 1, "user", "q1"), (2, 1, "assistant", "a1"), (3, 1, "user", "q2"), (4, 1, "assistant", "a2"), (5, 2, "assistant", "x")], "id long, conversation_id long, role string, content string").withColumn("created_at", F.lit("2024-01-02 10:00:00").cast("timestamp"))
    c = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s")], "id long, session_id string").withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    assert {r.id: (r.first_question, r.message_count) for r in A.conversation_list(c, m).collect()} == {1: ("q1", 4), 2: (None, 1), 3: (None, 0)}
    assert {r.id: r.question for r in A.logs(m).collect()} == {2: "q2", 4: "q2", 5: None}
    assert {r.id: r.question for r in A.question_before(m).collect()} == {2: "q1", 4: "q2", 5: None}
    assert A.logs(m, "2024-01-03").count() == 0 and A.logs(m, None, "2024-01-02").count() == 3


def test_sources(spark, tmp_path):
    assert S.page_text("<head><title>t</title><style>x</style></head><nav>n</nav><p>a &amp; b</p><footer>f<p>g</footer><p>c") == "t\na & b\nc"
    buf = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.html").write_text("<p>hello</p>")
    (tmp_path / "c.doc").write_bytes(b"x")
    got = {r.url.rsplit("/", 1)[1]: (r.text, r.error) for r in S.extract(S.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": ("one\ntwo", None), "b.html": ("hello", None), "c.doc": (None, "legacy format")}
    (tmp_path / "cases.jsonl").write_text('{"id": "a", "n": 1}\n\n{"id": "a", "n": 2}\n')
    from pyspark.sql.types import StructType

    rows = S.read_cases(spark, str(tmp_path / "cases.jsonl"), StructType.fromDDL("id string, n int"))
    assert E.last_of_each(rows.withColumn("nth", F.col("n")), "id", "nth").first().n == 2
    (tmp_path / "r.csv").write_text('doc,title,url\na, b, c,T,http://x\nd,"T, U",http://y\n')
    assert sorted(tuple(r) for r in S.read_register(spark, str(tmp_path / "r.csv"), ["doc", "title", "url"]).collect()) == [("a, b, c", "T", "http://x"), ("d", "T, U", "http://y")]
    lines = spark.createDataFrame([(1, 1, 'data: {"text": "a"}'), (1, 2, ""), (1, 3, 'data: {"text": "b"}')], "id int, nth int, line string")
    assert S.event_text(lines).first().text == "ab"
    errors = spark.range(1).select(S.upload_errors(F.lit("a.exe"), F.lit(99_999_999_999), F.lit(" "))).first()[0]
    assert errors == ["too_large", "unsupported_type", "no_text"]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert M.versions(spark, path) == []
    for n in (1, 2):
        M.publish(spark.range(n), path)
    assert len(M.versions(spark, path)) == 2 and M.current(spark, path).count() == 2


def test_streaming(spark, tmp_path):
    schema = "document_id long, text string, added_at timestamp"
    spark.createDataFrame([(1, "first", None), (2, "other", None)], schema).write.parquet(str(tmp_path / "in"))
    for text in (None, "second"):
        if text:
            spark.createDataFrame([(1, text, None)], schema).withColumn("added_at", F.current_timestamp()).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.index_arrivals(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.content for r in incremental.indexed(spark, str(tmp_path / "out")).collect()) == ["other", "second"]
    incremental.compact(spark, str(tmp_path / "out"), str(tmp_path / "compact"))
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 2
    usage = spark.createDataFrame([("assistant", 1.5, "2024-01-01 10:00:00"), ("user", 9.0, "2024-01-01 10:00:00"), ("assistant", 2.0, "2024-01-05 10:00:00")], "role string, cost_usd double, at string")
    usage.withColumn("created_at", F.col("at").cast("timestamp")).drop("at").write.parquet(str(tmp_path / "u"))
    windows = incremental.cost_windows(spark.readStream.schema("role string, cost_usd double, created_at timestamp").parquet(str(tmp_path / "u")))
    incremental.to_memory(windows, "costs", "complete").awaitTermination()
    assert sorted(r.cost for r in spark.table("costs").collect()) == [1.5, 2.0]


def test_term_score(spark):
    df = spark.createDataFrame([("cat cat dog bird", "cats cat dog")], "d string, q string")
    assert df.select(R.term_score(T.tokenize(F.col("q")), T.tokenize(F.col("d")))).first()[0] == pytest.approx(0.5 + 0.25)
