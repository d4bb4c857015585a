"""Parameters that are missing are fetched once, from a server of the test's own."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lexforge.functions import rules as R
from lexforge.operators import context as C
from lexforge.schemas import PARAMETERS
from lexforge.sources import pdf

ASKED = []


@pytest.fixture
def web():
    files = {"/2024.pdf": pdf.write([["x"], [f"some {R.PARAMETER_PHRASE} 20,520 a year"]]), "/2023.pdf": pdf.write([["nothing"]]), "/2022.pdf": b"broken"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            ASKED.append(self.path)
            self.send_response(200 if self.path in files else 404)
            self.end_headers()
            self.wfile.write(files.get(self.path, b""))

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_missing_years_are_fetched_once(spark, web):
    ask = f"{R.PARAMETER_TERMS[0]} {R.PARAMETER_SUBJECT}"
    questions = spark.createDataFrame([(i, f"{ask} {y}") for i, y in enumerate([2024, 2024, 2024, 2023, 2022, 2021, 2020, 2019])] + [(50, "2024 something else"), (51, ask)], "query_id long, question string").repartition(4)
    old = spark.createDataFrame([(1, R.PARAMETER_KEY, 2020, "1", "u", "t", "http://x", "3", "official", None), (2, "other", 2024, "9", "u", "t", "http://x", None, None, None)], PARAMETERS)
    sources = spark.createDataFrame([(y, f"booklet {y}", f"{web}/{y}.pdf", "12") for y in (2020, 2021, 2022, 2023, 2024)], "tax_year int, source_title string, source_url string, source_page string")
    ASKED.clear()
    now, outcomes = C.complete_parameters(questions, old, sources, 2024, "2024-02-03 00:00:00")
    got = {r.tax_year: (r.value_text, r.error) for r in outcomes.collect()}
    assert sorted(ASKED) == ["/2021.pdf", "/2022.pdf", "/2023.pdf", "/2024.pdf"]
    assert got[2024] == ("20,520", None) and got[2023] == (None, "no amount") and got[2019] == (None, "no address") and got[2022][1] == "unreadable" and "404" in got[2021][1]
    rows = {(r.parameter_key, r.tax_year): r for r in now.collect()}
    assert len(rows) == 3 and (rows[R.PARAMETER_KEY, 2024].unit, rows[R.PARAMETER_KEY, 2024].source_type, rows[R.PARAMETER_KEY, 2024].source_page) == ("ILS_PER_YEAR", "official_web_fallback", "12")
    shown = {r.query_id: r.parameter_context for r in C.parameter_context(questions, now, 2024).collect()}
    assert "20,520" in shown[0] and shown[0] == shown[1] == shown[51] and shown[50] is None and shown[3] is None
    ASKED.clear()
    C.complete_parameters(questions.where("query_id < 3"), now, sources, 2024, "2024-02-03 00:00:00")[1].collect()
    assert ASKED == []  # what is there is not fetched again
