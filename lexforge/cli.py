"""Command line: ``python -m lexforge.cli compare|audit|retrieval|answers|review|reindex|reingest``.

Tables are Parquet folders, cases and results JSON lines.  Exit codes: 0 if all went
well, 1 if a candidate regressed, cases failed or documents could not be fetched.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import audit, catalog, evaluation as E
from .session import session
from .sources import files


def _show(df: DataFrame) -> None:
    for r in df.collect():
        print("\t".join("" if v is None else str(v) for v in r))


def _results(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("nth", F.monotonically_increasing_id())
    score = "struct<passed:boolean,error:string," + ",".join(f"{c}:double" for c in E.SCORES) + ">"
    rows = lines.select("nth", F.from_json("value", f"id string, category string, error string, score {score}").alias("r")).select("nth", "r.*")
    return E.flat_runs(E.last_of_each(rows, "id", "nth"))


def compare(spark: SparkSession, a: argparse.Namespace) -> int:
    base, candidate = _results(spark, a.baseline), _results(spark, a.candidate)
    _show(E.unpaired(base, candidate).orderBy("only_in", "id"))
    deltas = [f"{c}_delta" for c in ("passed", "errors", *E.SCORES)]
    _show(E.compared(base, candidate).select(F.coalesce("category", F.lit("OVERALL")), "n", *deltas))
    pairs = E.paired(base, candidate)
    _show(pairs.where("flip is not null").select("flip", "id").orderBy("flip", "id"))
    v = E.verdict(pairs).first()
    print(f"{v.verdict} ({v.base_passed} -> {v.candidate_passed})")
    return v.exit_code


def audit_corpus(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = audit.report(audit.documents(spark.read.parquet(a.documents), spark.read.parquet(a.chunks), a.as_of)).select("line")
    if a.out:
        lines.withColumnRenamed("line", "value").write.mode("overwrite").text(a.out)
    else:
        for r in lines.toLocalIterator():
            print(r.line)
    return 0


def retrieval(spark: SparkSession, a: argparse.Namespace) -> int:
    cases = spark.read.schema("id string, relevant_documents array<string>, expected_documents array<string>, distractor_documents array<string>").json(a.cases)
    ranked = spark.read.schema("id string, rank int, title string, source_ref string").json(a.ranked)
    scored = E.score_rankings(cases, ranked, a.k)
    _show(scored.orderBy("id"))
    _show(E.means(scored.select(F.col("id").alias("query_id"), "recall", "precision", "reciprocal_rank", "average_precision")))
    return int(bool(scored.where("not passed").take(1)))


_TERMS = "expected_conclusion required_concepts required_actions clarification_terms must_include must_not_include expected_citation_prefixes any_citation_prefixes".split()


def answers(spark: SparkSession, a: argparse.Namespace) -> int:
    schema = "id string, category string, answer string, requires_clarification boolean, " + ", ".join(f"{c} array<string>" for c in _TERMS)
    cases = spark.read.schema(schema).json(a.cases)
    scored = (E.rubric if a.rubric else E.guardrails)(cases)
    _show(scored.orderBy("id"))
    r = scored.agg(F.count("*").alias("n"), F.count_if("passed").alias("passed")).first()
    print(f"{r.passed}/{r.n}")
    return int(r.passed < r.n)


def review(spark: SparkSession, a: argparse.Namespace) -> int:
    lists = ", ".join(f"{c} array<string>" for c in _TERMS)
    schema = f"id string, question string, source_type string, reference_url string, url string, primary_source string, reference_answer string, answer string, requires_clarification boolean, {lists}"
    cases = [spark.read.schema(schema).json(p).withColumn("executed", F.lit(done)) for p, done in ((a.executed, True), (a.bank, False))]
    files.write_review(cases[0].unionByName(cases[1]), a.out, a.title)
    return 0


def reindex(spark: SparkSession, a: argparse.Namespace) -> int:
    chunks, outcomes = catalog.reindex(spark.read.parquet(a.documents), spark.read.parquet(a.chunks))
    catalog.publish(chunks, a.out)
    _show(catalog.tally(outcomes))
    return int(bool(outcomes.where("outcome = 'failed'").take(1)))


def reingest(spark: SparkSession, a: argparse.Namespace) -> int:
    ids = spark.createDataFrame([(i,) for i in a.ids], "id long") if a.ids else None
    docs, chunks, outcomes = catalog.reingest(spark.read.parquet(a.documents), spark.read.parquet(a.chunks), files.fetch_documents, ids, a.apply)
    if a.apply:
        catalog.publish(docs, f"{a.out}/documents")
        catalog.publish(chunks, f"{a.out}/chunks")
    _show(catalog.tally(outcomes))
    return int(bool(outcomes.where("outcome = 'failed'").take(1)))


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexforge")
    sub = parser.add_subparsers(required=True)

    def command(f, name: str, *names: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=f)
        for n in names:
            p.add_argument(n)
        return p

    command(compare, "compare", "baseline", "candidate")
    p = command(audit_corpus, "audit", "documents", "chunks")
    p.add_argument("--as-of", required=True)
    p.add_argument("--out")
    command(retrieval, "retrieval", "cases", "ranked").add_argument("--k", type=int, default=20)
    command(answers, "answers", "cases").add_argument("--rubric", action="store_true")
    command(review, "review", "executed", "bank", "out").add_argument("--title", default="Cases")
    command(reindex, "reindex", "documents", "chunks", "out")
    p = command(reingest, "reingest", "documents", "chunks", "out")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--ids", type=int, nargs="*")
    a = parser.parse_args(argv)
    return a.run(session(), a)


if __name__ == "__main__":
    sys.exit(main())
