"""Registered queries against their SQL, on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
NAMES = [
    "hybrid_topk", "r06_forced", "r13_own_k", "h02_answer_context", "f20_term_scores", "r12_pack_documents", "k03_token_cap", "k04_parts", "e01_ranking_metrics", "a12_compared", "f26_deltas",
    "m06_insert_or_ignore", "m14_chunks", "s18_report", "s20_review_sheet", "j14_parameter_lookup",
    "s05_s10_fetched", "h05_ingest", "m15_apply", "r14_fetched_parameters", "s21_event_text", "h02_answer_stream",
]


def canon(rows):
    return sorted(str([round(x, 4) if isinstance(x, float) and math.isfinite(x) else x for x in r]) for r in rows)


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        out.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return out


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, db, name):
    import __spark_entry__ as e

    df = e.queries()[name](spark, DATA)
    got = canon(df.select(*df.columns).collect())
    cur = db.execute(e.oracle_sql()[name])
    place = [[c[0] for c in cur.description].index(c) for c in df.columns]
    assert got == canon([r[i] for i in place] for r in cur.fetchall()) and got
