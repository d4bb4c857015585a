"""Bounded retrieval against ranks over all pairs; scores against loops."""

import math
import random

import numpy as np
import pytest

from lexforge.functions import rules
from lexforge.operators import ranking as R, scoring

CHUNK = "document_id long, chunk_index int, content string, section_header string, document_title string, document_ref string, effective_date string, embedding array<double>"
DOCUMENT = "id long, is_active boolean, superseded_by long, valid_until string, document_type string, effective_date string"
WORDS = ["alpha", "beta", "gamma", "delta", "מעלה", "קצבה", "alphabet", "eta", "2016-9-17", "50%", "סעיף 9"]


def corpus(spark, seed=1, n=400, hot=150):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
    ids = [(1, i) for i in range(hot)] + [(2 + k // 5, k % 5) for k in range(n - hot)]
    vector = lambda: rng.choice([None, [1.0], [None, 1.0, 0.0]]) if rng.random() < 0.03 else [float(rng.choice([-1, 0, 0, 1])) for _ in range(3)]
    chunks = [(d, i, text(8), rng.choice([None, "", "סעיף 9"]), f"{text(2)}", rng.choice([None, "ref", "alpha ref"]), None, vector()) for d, i in ids]
    docs = [(d, d % 11 != 0, 7 if d % 5 == 0 else None, None, rng.choice([None, "חוק", "תקנה"]), None) for d in sorted({d for d, _ in ids})]
    questions = [(q, f"{text(5)} {rng.choice(['', 'מותר'])}", [vector() for _ in range(rng.randint(0, 2))]) for q in range(12)] + [(50, "zz", [[1.0, 0.0, 0.0]])]
    q = spark.createDataFrame(questions, "query_id long, question string, vectors array<array<double>>").withColumnRenamed("question", "ranking_question").selectExpr("*", "ranking_question AS question")
    return q, spark.createDataFrame(chunks, CHUNK).repartition(3), spark.createDataFrame(docs, DOCUMENT), questions, chunks


COLUMNS = ["query_id", "rank", "document_id", "chunk_index", "score", "lexical", "bonus", "penalty", "dense_rank", "lexical_rank", "fused", "forced"]


def rows(df):
    return sorted(tuple(-9 if x is None else x for x in r) for r in df.select(*COLUMNS).collect())


def every_pair(q, chunks, docs, how, forced=rules.FORCED):
    scored = R.scores(q, R.joined(chunks, docs, "2024-01-01"), how, forced)
    return R.top(R.cap_and_force(R.fuse(scored, how), how), how)


@pytest.mark.parametrize("first", [8, 1])
def test_bounded_retrieval_is_exact(spark, monkeypatch, first):
    monkeypatch.setattr(R, "FIRST", first)  # 1: too few candidates, asked again
    seen = []
    monkeypatch.setattr(R, "stored", lambda df, name, f=R.stored: seen.append((name, f(df, name))) or seen[-1][1])
    monkeypatch.setattr(R, "release", lambda *frames: None)
    q, chunks, docs, _, _ = corpus(spark)
    how = R.Retrieval(k=6)
    got = rows(R.retrieve(q, chunks, docs, how, "2024-01-01"))
    assert [name for name, _ in seen if name == "scored"] == []  # no table of all pairs
    classes, sizes = 2 * 4, [x.groupBy("query_id").count().agg({"count": "max"}).first()[0] or 0 for name, x in seen if name == "candidates"]
    most = first * how.k
    assert len(sizes) > (first == 1)
    for k, size in enumerate(sizes):
        assert size <= 2 * classes * most * R.MORE**k
    assert got == rows(every_pair(q, chunks, docs, how))


def test_groups_forced_and_own_k(spark, monkeypatch):
    monkeypatch.setattr(R, "GROUP", 5)
    q, chunks, docs, _, _ = corpus(spark, 2, 120, 30)
    how, forced = R.Retrieval(k=5), {"all": ["alpha"], "markers": ["beta"]}
    got = rows(R.retrieve(q, chunks, docs, how, "2024-01-01", forced))
    want = rows(every_pair(q, chunks, docs, how, forced))
    assert got == want and any(r[-1] for r in got)
    own = q.selectExpr("*", "CAST(IF(query_id % 2 = 0, 2, NULL) AS INT) AS k")
    assert rows(R.retrieve(own, chunks, docs, how, "2024-01-01", forced)) == [r for r in want if r[1] <= (2 if r[0] % 2 == 0 else 5)]
    assert rows(R.retrieve(q.limit(0), chunks, docs, how, "2024-01-01")) == [] and rows(R.retrieve(q, chunks.limit(0), docs, how, "2024-01-01")) == []


def test_scores_by_loops(spark):
    q, chunks, docs, questions, plain = corpus(spark, 3, 60, 10)
    how = R.Retrieval()
    asked = {r.query_id: r for r in R._asked(q, how, rules.FORCED).collect()}
    got = {(r.query_id, r.document_id, r.chunk_index): r for r in R.scores(q, R.joined(chunks, docs, "2024-01-01"), how).collect()}
    assert len(got) == len(questions) * sum(d % 11 != 0 for d, *_ in plain)
    for (qid, d, i), r in got.items():
        _, _, content, section, title, ref, _, v = next(c for c in plain if c[:2] == (d, i))
        t, f, s, c = ((x or "").lower() for x in (title, ref, section, content))
        a = asked[qid]
        points = sum(100.0 for x in a.circulars if x in t or x in f) + sum(50.0 for x in a.sections if x in t or x in f or x in s or x in c) + sum(20.0 for x in a.percentages if x in c)
        for w in a.words:
            for part, value in ((t, 5.0), (f, 3.0), (c, 0.2)):
                points += value * any(x in part for x in w)
        assert r.lexical == points
        similar = []
        for u in next(x for x in questions if x[0] == qid)[2]:
            if u and v and len(u) == len(v) and None not in u and None not in v:
                similar.append(sum(x * y for x, y in zip(u, v)) / (math.sqrt(sum(x * x for x in u)) * math.sqrt(sum(x * x for x in v)) + 1e-10))
        best = max(similar) + 0.01 * max(sum(x >= 0.35 for x in similar) - 1, 0) if similar else None
        assert r.score == best


def test_dominated_chunks():
    rng = random.Random(6)
    n = 300
    score, lexical = np.array([float(rng.randint(0, 9)) for _ in range(n)]), np.array([float(rng.randint(0, 9)) for _ in range(n)])
    document, place = np.array([rng.randint(0, 2) for _ in range(n)]), np.array(rng.sample(range(n), n))
    zero = np.zeros(n, np.int64)
    out = scoring.dominated(zero, zero, document, score, lexical, place, 3)
    for x in range(n):
        better = sum(document[y] == document[x] and (-score[y], place[y]) < (-score[x], place[x]) and (-lexical[y], place[y]) < (-lexical[x], place[x]) for y in range(n))
        assert out[x] == (better >= 3)
