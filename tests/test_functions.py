"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T


def values(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert values(spark, T.clean_text, ["a\n\n\n\nb", " \t a  b ", "\n \n \n", None, "x\x1c"]) == ["a\n\nb", "a b", "", None, "x"]


def test_estimate_tokens(spark):
    assert values(spark, T.estimate_tokens, [None, "", "a", "x" * 90, "שלום"]) == [0, 0, 1, 62, 5]


def test_tokens(spark):
    assert values(spark, T.tokenize, ["The קופה של x Gemel_1 a"]) == [["קופה", "gemel_1"]]
    assert values(spark, T.query_tokens, ["ab abc 123 12a abc"]) == [["abc", "12a", "abc"]]
    assert values(spark, T.variants, ["והקופה", "ובא", "xyz"]) == [["והקופה", "הקופה"], ["ובא"], ["xyz"]]


def test_links(spark):
    assert values(spark, T.first_url, ["see `https://a.b/c` x", "none", None]) == ["https://a.b/c", None, None]
    assert values(spark, T.drive_id, ["https://d/file/d/A_1-x/view", "https://d/open?id=B2&z", "https://x/d/C3/e", "x"]) == ["A_1-x", "B2", "C3", None]


def test_dates_and_years(spark):
    cases = ["חוזר 2024-9-8 x", "a 2024.12.31", "2024-13-1 2024-1-1", "12024-1-1", "2024-1-123", None, "0000-1-1", "1/2/2024"]
    assert values(spark, T.title_date, cases) == ["2024-09-08", "2024-12-31", None, None, None, None, None, None]
    assert values(spark, lambda c: T.question_year(c, F.lit(2026)), ["in 2024?", "12024", "1999", None]) == [2024, 2026, 2026, 2026]


def test_tags(spark):
    assert values(spark, T.confidence, ["x confidence:  high", "CONFIDENCE: none", None]) == ["HIGH", None, None]
    assert values(spark, T.amount_by_phrase, ["עד 20,566  הפקדה\nמוטבת", "הפקדה מוטבת 15,000", "x"]) == ["20,566", "15,000", None]


def test_citation_and_header(spark):
    df = spark.createDataFrame([(23, 0, 17, 18), (23, 0, 17, 17), (7, 4, None, 3)], "d int, c int, s int, e int")
    assert [r[0] for r in df.select(T.citation(*(F.col(x) for x in "dcse"))).collect()] == ["D23-P17-18", "D23-P17", "D7-C5"]
    df = spark.createDataFrame([("t", "", "2024-01-01", "expired"), ("t", "r", None, "current")], "t string, r string, e string, v string")
    assert [r[0] for r in df.select(T.header(*(F.col(x) for x in "trev"))).collect()] == ["=== t | תוקף: 2024-01-01 | [פג תוקף] ===", "=== t | r ==="]


def test_validity(spark):
    df = spark.createDataFrame([(5, None), (None, "2024-01-01"), (None, "2024-06-01"), (None, ""), (None, None)], "s int, v string")
    assert [r[0] for r in df.select(T.validity(F.col("s"), F.col("v"), F.lit("2024-06-01"))).collect()] == ["superseded", "expired", "current", "current", "current"]


def test_authority(spark):
    df = spark.createDataFrame([(None, "חוק הפיקוח"), ("  ", "תקנות"), ("x", "חוק"), (None, None)], "k string, t string")
    assert [r[0] for r in df.select(T.authority(F.col("k"), F.col("t"))).collect()] == ["חוק", "תקנה", "x", "אחר"]
    assert values(spark, lambda c: T.authority_bonus(F.lit("מותר?"), c), ["חוק", "x"]) == [0.04, 0.0]
    assert values(spark, lambda c: T.authority_bonus(F.lit("hello"), c), ["חוק"]) == [0.0]


def test_questions(spark):
    assert values(spark, T.is_parameter_question, ["מה התקרה של קרן השתלמות", "קרן השתלמות", None]) == [True, False, False]
    df = spark.createDataFrame([("why so", 2), ("why so", 1), ("a " * 13, 4), ("תפרט " + "a " * 13, 4)], "q string, n int")
    assert [r[0] for r in df.select(T.is_follow_up(F.col("q"), F.col("n"))).collect()] == [True, False, False, True]


def test_costs_and_deltas(spark):
    row = spark.range(1).select(T.cost(F.lit(1_000_000), F.lit(500_000)), T.signed_delta(F.lit(0.181), F.lit(0.278)), T.signed_delta(F.lit(0.5), F.lit(0.5))).first()
    assert list(row) == [0.45, "0.181 -> 0.278 (+0.097)", "0.500 -> 0.500 ( 0.000)"]


def test_markdown(spark):
    shown = lambda c: T.markdown_to_html(c, {"ul": 'class="x"'})
    assert values(spark, shown, ["**a** <b>\n- x", None]) == ['<strong>a</strong> &lt;b&gt;<br><ul class="x"><li>x</li></ul>', ""]


@pytest.mark.parametrize(("name", "want"), [("a.PDF", "pdf"), ("a.tar.gz", "gz"), ("none", "")])
def test_extension(spark, name, want):
    assert values(spark, T.extension, [name]) == [want]
