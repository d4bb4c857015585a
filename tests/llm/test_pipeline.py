"""The pipeline: stages take effect, keep the columns and clean documents, and agree on reruns."""

from pathlib import Path

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stages(spark):
    from lexforge.llm import decontaminate, near_copies
    from lexforge.llm.common import stored, table

    docs = table(spark, DATA, "documents")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, DATA), "test-stage")
        assert out.columns == docs.columns
        counts.append(out.count())
        if stage is corpus_pipeline.drop_near_copies:
            groups = near_copies.groups(docs, corpus_pipeline.SHINGLE, corpus_pipeline.SHARE).where("doc_id = component_id").select("doc_id")
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in groups.collect()}
        if stage is corpus_pipeline.decontaminate_benchmark:
            bad = decontaminate.digest(decontaminate.scan(docs, table(spark, DATA, "benchmark"))).where("contaminated")
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - {r.doc_id for r in bad.collect()}
        docs = out
    assert counts[0] >= counts[1] > counts[2] > counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == counts[-1]
    a, b = (sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) for _ in range(2))
    assert a == b == sorted(map(str, last.collect()))


def test_odd_rows(spark):
    """Nulls, empty, long and repeated texts, an empty table, and columns named like those of the stages."""
    from test_operators import odd_texts

    texts = [(i, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else "s", 1) for k, (i, t) in enumerate(odd_texts())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} {t}" for c, t in (("c0", "int"), ("lang_pred", "string"), ("score", "double"), ("n_hit", "int"), ("items", "string"), ("component_id", "long"), ("copies", "int"), ("mix_key", "string"), ("src", "long"), ("row", "string")))
    docs = spark.createDataFrame([(*r, 1, "x", 0.5, 7, "y", 3, 9, "k", 4, "r") for r in texts], schema)
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, DATA).cache()
            assert name == "tokens" or out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            assert out.count() > 0 if rows is docs else out.count() == 0
            if name != "tokens":
                assert {str(r) for r in out.collect()} <= {str(r) for r in docs.collect()}
    kept = corpus_pipeline.STAGES[1][1](spark, docs, DATA)
    assert kept.where("doc_id in (3, 4, 5)").count() == 3 and kept.where("doc_id = 7").count() == 1
