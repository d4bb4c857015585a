"""Places by ranges of packed blocks against sorted lists; F8 and F20 of round 3."""

import random

import numpy as np
import pytest

from lexforge.operators import ranges, ranking as R, scoring

PAIR = "query_id string, document_id long, chunk_index int, score double, lexical double, bonus double, penalty double, marked boolean"


def pairs(seed=4, n=900):
    rng = random.Random(seed)
    of = lambda q, i: (q, i // 4, i % 4, rng.choice([None, 0.1, 0.1, 0.5, float("nan")]) if i % 3 else 0.5, rng.choice([0.0, 5.0, 5.2]), rng.choice([0.0, 0.04]), rng.choice([0.0, 0.001]), q == "a" and rng.random() < 0.4)
    out = [of(q, i) for q, many in (("a", n), ("b", n // 3), ("c", 1)) for i in range(many)]
    rng.shuffle(out)
    return out


def ranked(rows, how):
    """Both ranks, the fused score, places in documents and the final list of one question, by sorting all of its rows."""
    large = lambda x: (2, 0) if x is None else (0, 0) if x != x else (1, -x)
    dense = {r[1:3]: i for i, r in enumerate(sorted(rows, key=lambda r: (large(r[3]), *r[1:3])), 1)}
    words = {r[1:3]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[4], *r[1:3])), 1)}
    fused = {r[1:3]: 1 / (how.rrf + dense[r[1:3]]) + 1 / (how.rrf + words[r[1:3]]) + 0.01 * r[4] + r[5] - r[6] for r in rows}
    best, nth, seen = sorted(fused, key=lambda k: (-fused[k], *k)), {}, {}
    for k in best:
        nth[k] = seen[k[0]] = seen.get(k[0], 0) + 1
    forced = sorted((r[1:3] for r in rows if r[7] and nth[r[1:3]] > how.per_document), reverse=True)
    final = [(k, True) for k in forced] + [(k, False) for k in best if nth[k] <= how.per_document]
    return {k: (dense[k], words[k], fused[k], nth[k]) for k in fused}, {k: (i, f) for i, (k, f) in enumerate(final, 1)}


@pytest.mark.parametrize("most", [40, 1 << 19])
def test_ranks_by_bounded_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(ranges, "ROWS", most)
    monkeypatch.setattr(ranges, "SAMPLED", 20)
    made, how, cuts = pairs(), R.DEFAULT, []
    keep = ranges.Cuts.__init__
    monkeypatch.setattr(ranges.Cuts, "__init__", lambda self, *x: cuts.append(self) or keep(self, *x))
    df = spark.createDataFrame(made, PAIR).repartition(3)
    fused = R.fuse(df, how)
    got = {(r.query_id, r.document_id, r.chunk_index): (r.dense_rank, r.lexical_rank, r.fused, r.nth) for r in fused.collect()}
    final = {(r.query_id, r.document_id, r.chunk_index): (r["rank"], r.forced) for r in R.cap_and_force(R.fuse(df, how, packed=True, keep=("fused", "nth", "marked")), how).collect()}
    capped = {(r.query_id, r.document_id, r.chunk_index): r["rank"] for r in R.cap(fused.drop("nth"), how).collect()}
    want, last = {}, {}
    for q in "abc":
        ranks, places = ranked([r for r in made if r[0] == q], how)
        want |= {(q, *k): v for k, v in ranks.items()}
        last |= {(q, *k): v for k, v in places.items()}
        assert [k for k, v in sorted(((k, v) for k, v in capped.items() if k[0] == q), key=lambda x: x[1])] == [(q, *k) for k, (_, f) in sorted(places.items(), key=lambda x: x[1]) if not f]
    assert got == want and final == last and any(f for _, f in final.values())
    # no range holds all of a question's rows, ties or not
    assert (most > 40) == (not cuts[0].of.get("a")) and (most > 40 or len(cuts[0].of["a"]) > 5)


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], PAIR)
    assert R.fuse(none).collect() == [] and R.cap_and_force(R.fuse(none)).collect() == []


def test_last_rows_of_classes():
    rng = random.Random(9)
    q, kind, value = (np.array([rng.randint(0, 3) for _ in range(200)], float) for _ in range(3))
    place = np.array(rng.sample(range(200), 200))
    for most in (1, 5, 12, 500):
        kept = scoring.cut(q, kind, value, place, most)
        want = set()
        for key in {*zip(q, kind)}:
            mine = sorted((r for r in range(200) if (q[r], kind[r]) == key), key=lambda r: (-value[r], place[r]))
            assert set(mine[:most]) == {r for r in mine if kept[r]}
            want |= set(mine[most - 1 : most])
        assert set(scoring.last_of(q, kind, value, place, most).tolist()) == want


def test_a_question_is_asked_once_and_joins_are_done_once(spark, monkeypatch):
    seen, scanned = [], []
    keep, candidates = R.stored, R.candidates
    monkeypatch.setattr(R, "stored", lambda df, name: seen.append(name) or keep(df, name))
    monkeypatch.setattr(R, "candidates", lambda *x: scanned.append(x[2]) or candidates(*x))
    rng = random.Random(3)
    n = 3000
    # two classes: the 48 first of one are some 96 of all, which closes what the 49th of a class alone would leave open
    chunks = [(i // 5, i % 5, rng.choice(["alpha", "beta", ""]), "", "t", "r", None, [rng.random(), rng.random()]) for i in range(n)]
    c = spark.createDataFrame(chunks, "document_id long, chunk_index int, content string, section_header string, document_title string, document_ref string, effective_date string, embedding array<double>").repartition(3)
    d = spark.createDataFrame([(i, True, 7 if i % 2 else None, None, None, None) for i in range(n // 5)], "id long, is_active boolean, superseded_by long, valid_until string, document_type string, effective_date string")
    q = spark.createDataFrame([(k, "alpha", "alpha", [[1.0, k / 9]]) for k in range(6)], "query_id long, question string, ranking_question string, vectors array<array<double>>")
    own = q.selectExpr("*", "CAST(query_id % 4 + 3 AS INT) AS k")
    got = sorted(map(tuple, R.retrieve(own, c, d).select("query_id", "rank", "document_id", "chunk_index", "fused").collect()))
    assert seen.count("searched") == 1 and scanned == [R.FIRST * 6]
    every = R.top(R.cap_and_force(R.fuse(R.scores(own, R.joined(c, d, "9999-12-31")))), own=own)
    assert got == sorted(map(tuple, every.select("query_id", "rank", "document_id", "chunk_index", "fused").collect())) and len(got) == sum(k % 4 + 3 for k in range(6))
