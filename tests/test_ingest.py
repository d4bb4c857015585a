"""Uploads to chunks and statuses; pages of rows by counts; metrics of a hot query."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from lexforge import scan
from lexforge.operators import analytics as A, catalog as M, evaluation as E, ingest
from lexforge.schemas import CHUNKS, DOCUMENTS
from lexforge.sources import pdf


def docx(text):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in text) + "</w:body></w:document>")
    return buf.getvalue()


def test_ingest_keeps_failures_apart(spark, tmp_path):
    def embedder(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("no vector")
        return [[float(len(t)), 1.0] for t in texts]

    old = [(2, "old.pdf", "pdf", "old.pdf", "before", None, "c", 1, True, "ready", None, None, 1), (9, "other", "pdf", "o", "text", None, None, 1, True, "ready", None, None, 1)]
    documents = spark.createDataFrame([(*r, *[None] * 7) for r in old], DOCUMENTS)
    chunks = spark.createDataFrame([(k, d, f"chunk of {d}", "", 0, "t", "r", None, None, None, None, [0.5]) for k, d in enumerate((2, 9))], CHUNKS)
    uploads = [
        (1, "a.pdf", pdf.write([["First page"], ["Second page"]])), (2, "old.pdf", pdf.write([["some poison here"]])), (3, "c.docx", docx(["one", "two"])), (4, "d.docx", docx(["poison"])),
        (5, "e.txt", b"plain"), (6, "f.pdf", b"broken"), (7, "g.doc", b"old format"), (8, None, b"x"), (10, "h.pdf", None),
    ]
    docs, kept, outcomes = ingest.ingest(documents, chunks, spark.createDataFrame(uploads, "id long, title string, content binary").repartition(3), embedder, "2024-01-02 03:04:05")
    state = {r.id: r for r in outcomes.collect()}
    assert {i: (r.status, r.chunks) for i, r in state.items()} == {1: ("ready", 2), 2: ("failed", 0), 3: ("ready", 1), 4: ("failed", 0), 5: ("refused", 0), 6: ("refused", 0), 7: ("refused", 0), 8: ("refused", 0), 10: ("refused", 0)}
    assert "no vector" in state[2].error and "unsupported_type" in state[5].error and "no_text" in state[6].error
    now = {r.id: r for r in docs.collect()}
    assert set(now) == {1, 2, 3, 4, 9}
    assert (now[1].index_status, now[1].chunk_count, str(now[1].indexed_at), now[1].text) == ("ready", 2, "2024-01-02 03:04:05", "First page\n\nSecond page")
    assert (now[2].index_status, now[2].chunk_count, now[2].text, now[2].source_checksum) == ("failed", 1, "before", "c") and "no vector" in now[2].index_error
    assert (now[4].index_status, now[4].chunk_count) == ("failed", 0) and now[9].index_status == "ready"
    got = sorted((r.document_id, r.chunk_index, r.content, r.page_start, r.embedding) for r in kept.collect())
    assert got == [(1, 0, "First page", 1, [10.0, 1.0]), (1, 1, "Second page", 2, [11.0, 1.0]), (2, 0, "chunk of 2", None, [0.5]), (3, 0, "one\ntwo", None, [7.0, 1.0]), (9, 0, "chunk of 9", None, [0.5])]
    where = M.publish_all({"documents": docs, "chunks": kept}, str(tmp_path / "v"))
    assert M.versions(spark, str(tmp_path / "v")) == [x for x in M.versions(spark, str(tmp_path / "v")) if x.endswith(where.rsplit("/", 1)[1])]
    assert spark.read.parquet(f"{where}/chunks").count() == 5
    again = ingest.ingest(documents, chunks, spark.createDataFrame([], "id long, title string, content binary"), embedder, "2024-01-02 03:04:05")
    assert [x.count() for x in again] == [2, 2, 0]


def test_pages_by_counts(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, f"2024-01-{rng.randint(1, 4):02d} 00:00:{rng.randint(0, 2):02d}.{rng.randint(0, 3)}"])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("created_at")).repartition(4)
    want = [r.id for r in df.orderBy(F.desc("created_at"), F.desc("id")).collect()]
    for number in (1, 2, 7, 8, 9, 20):
        assert [r.id for r in A.page(df, number, 20).collect()] == want[(number - 1) * 20 : number * 20]
    assert A.page(df.limit(0), 1).collect() == []


def test_log_filter_goes_down_to_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-{1 + i % 9:02d} 23:59:59.{i}") for i in range(40)] + [(99, None)], "id long, t string").select("id", F.col("t").cast("timestamp").alias("created_at"))
    df.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    got = rows.where(A.log_filter(F.col("created_at"), "2024-01-03", "2024-01-05"))
    assert "GreaterThanOrEqual(created_at" in got._jdf.queryExecution().toString() and "LessThan(created_at" in got._jdf.queryExecution().toString()
    assert sorted(r.id for r in got.collect()) == [i for i in range(40) if 3 <= 1 + i % 9 <= 5]
    assert rows.where(A.log_filter(F.col("created_at"), "2024-01-1", "2024-01")).count() == 0  # by letters: "2024-01 23:59:59" is below any day


def test_metrics_of_a_hot_query(spark, monkeypatch):
    monkeypatch.setattr(scan, "FAN", 16)
    rng = random.Random(2)
    ranked = [(q, f"i{rng.randint(0, 300)}", r) for q in ("hot", "b") for r in range(1, 401 if q == "hot" else 6)]
    gold = [(q, f"i{k}") for q in ("hot", "b", "c") for k in range(0, 300, 7)]
    got = {r.query_id: r for r in E.ranking_metrics(spark.createDataFrame(ranked, "query_id string, item string, rank int"), spark.createDataFrame(gold, "query_id string, item string"), 50).collect()}
    for q in ("hot", "b", "c"):
        right = {x for p, x in gold if p == q}
        hit = [r for p, x, r in ranked if p == q and x in right]
        shown = sum(p == q and r <= 50 for p, _, r in ranked)
        want = (sum(r <= 50 for r in hit) / len(right), sum(r <= 50 for r in hit) / shown if shown else 0, 1 / hit[0] if hit else 0, sum((k + 1) / r for k, r in enumerate(hit)) / len(right))
        assert [round(x, 9) for x in got[q][1:]] == [round(x, 9) for x in want]
