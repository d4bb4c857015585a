"""Scores of rankings and answers, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import scan
from ..functions import text as T

SCORES = ("conclusion_score", "required_concepts_score", "actionability_score", "clarification_score")


def strings(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Recall, precision, reciprocal rank and average precision of each query.

    ``ranked`` has query_id, item and rank; ``relevant`` query_id and item.  As labels
    may repeat in a ranking, recall and average precision can exceed 1.  Precision is
    over what was returned, not over k; reciprocal rank and average precision are uncut.
    """
    gold = relevant.distinct()
    n = gold.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    # hits alone are counted up, in ranges of ranks whose sums are scanned: no task has all of a query's
    hits = ranked.join(gold, ["query_id", "item"], "left_semi").withColumn("range", F.floor(F.col("rank") / scan.FAN).cast("long"))
    top = hits.agg(F.max("range")).first()[0] or 0
    before = scan.before(hits.groupBy("query_id", "range").agg(F.count("*").alias("n")), ["query_id"], "range", ["n"], top)
    before = before.select(F.col("query_id").alias("of_query"), F.col("range").alias("of_range"), "before_n")
    nth = F.row_number().over(W.partitionBy("query_id", "range").orderBy("rank"))
    rows = hits.withColumn("nth", nth).join(before, scan.same(hits, before, [("query_id", "of_query"), ("range", "of_range")]))
    found = rows.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum((F.col("before_n") + F.col("nth")) / F.col("rank")).alias("precisions"),
    )
    per = ranked.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("shown")).join(found, "query_id", "left")
    every = ranked.select("query_id").unionByName(relevant.select("query_id")).distinct().join(per, "query_id", "left").join(n, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "query_id", zero(F.col("hits") / F.col("n_relevant")).alias("recall"), zero(F.when(F.col("shown") > 0, F.col("hits") / F.col("shown"))).alias("precision"),
        zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("precisions") / F.col("n_relevant")).alias("average_precision"),
    )


def means(metrics: DataFrame) -> DataFrame:
    """E05, A13"""
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(F.count("*").alias("queries"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names))


def _matches(gold: Column, title: Column, ref: Column) -> Column:
    """Equal to title or source, or part of the title; an empty label matches nothing."""
    g, t, r = T.normalize(gold), T.normalize(title), T.normalize(ref)
    return (g != "") & ((g == t) | (g == r) | F.contains(t, g))


def score_rankings(cases: DataFrame, ranked: DataFrame, k: int = 20) -> DataFrame:
    """Metrics over labels, and which documents were found, missed or should not be there.

    ``cases`` has id, relevant_documents, expected_documents and distractor_documents;
    ``ranked`` has id, rank, title and source_ref.
    """
    c = cases.select("id", strings(F.coalesce("relevant_documents", "expected_documents")).alias("relevant"), strings("distractor_documents").alias("distractors"))
    rows = ranked.where(F.col("rank") <= k).join(c, "id")
    right, wrong = (F.try_element_at(F.filter(names, lambda g: _matches(g, F.col("title"), F.col("source_ref"))), F.lit(1)) for names in ("relevant", "distractors"))
    label = F.coalesce(T.blank_to_null(right), F.concat(F.lit("distractor:"), wrong), F.concat(F.lit("non:"), (F.col("rank") - 1).cast("string")))
    items = rows.select("id", "rank", label.alias("item"))
    gold = c.select(F.col("id").alias("query_id"), F.explode("relevant").alias("item"))
    m = ranking_metrics(items.withColumnRenamed("id", "query_id"), gold, k).withColumnRenamed("query_id", "id")
    seen = items.groupBy("id").agg(F.collect_set("item").alias("items"))
    out = c.join(m, "id", "left").join(seen, "id", "left").withColumn("items", strings("items"))
    found, missing = F.filter("relevant", lambda g: F.array_contains("items", g)), F.filter("relevant", lambda g: ~F.array_contains("items", g))
    bad = F.filter("distractors", lambda g: F.array_contains("items", F.concat(F.lit("distractor:"), g)))
    zero = [F.coalesce(x, F.lit(0.0)).alias(x) for x in ("recall", "precision", "reciprocal_rank", "average_precision")]
    return out.select("id", *zero, found.alias("found"), missing.alias("missing"), bad.alias("distractors"), ((F.size(missing) == 0) & (F.size(bad) == 0)).alias("passed"))


def context_score(titles: Column, evidence: Column) -> Column:
    """E07"""
    titles = strings(titles)
    found = F.filter(titles, lambda t: F.contains(evidence, t))
    missing = F.filter(titles, lambda t: ~F.contains(evidence, t))
    return F.struct((F.size(missing) == 0).alias("passed"), found.alias("found"), missing.alias("missing"))


def _citations(answer: Column) -> tuple[Column, Column]:
    missing = F.filter(strings("expected_citation_prefixes"), lambda p: ~F.contains(answer, p))
    any_ = strings("any_citation_prefixes")
    none = F.when(F.exists(any_, lambda p: F.contains(answer, p)), F.array().cast("array<string>")).otherwise(any_)
    return missing, none


def guardrails(cases: DataFrame) -> DataFrame:
    """``cases`` have an answer and what it must and must not have."""
    a = F.col("answer")
    missing, none = _citations(a)
    terms = F.filter(strings("must_include"), lambda t: ~F.contains(a, t))
    bad = F.filter(strings("must_not_include"), lambda t: F.contains(a, t))
    passed = (F.size(missing) == 0) & (F.size(none) == 0) & (F.size(terms) == 0) & (F.size(bad) == 0)
    return cases.select("id", passed.alias("passed"), missing.alias("missing_citations"), none.alias("missing_any_citations"), terms.alias("missing_terms"), bad.alias("prohibited"))


def rubric(cases: DataFrame) -> DataFrame:
    """Shares of the conclusion, concepts, actions and clarifications that an answer has; all must be whole."""
    a = F.col("answer")
    parts = {s: T.fraction_found(a, strings(c)) for s, c in zip(SCORES, ("expected_conclusion", "required_concepts", "required_actions", "clarification_terms"), strict=True)}
    missing, none = _citations(a)
    bad = F.filter(strings("must_not_include"), lambda t: F.contains(a, t))
    clear = ~F.coalesce("requires_clarification", F.lit(False)) | (parts[SCORES[3]]["share"] == 1.0)
    passed = clear & (F.size(missing) == 0) & (F.size(none) == 0) & (F.size(bad) == 0)
    for s in SCORES[:3]:
        passed = passed & (parts[s]["share"] == 1.0)
    return cases.select("id", passed.alias("passed"), *(v["share"].alias(k) for k, v in parts.items()), *(v["missing"].alias("missing_" + k.removesuffix("_score")) for k, v in parts.items()), bad.alias("prohibited"))


def last_of_each(lines: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key, the last."""
    cols = [c for c in lines.columns if c not in (key, order)]
    return lines.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")


def flat_runs(lines: DataFrame) -> DataFrame:
    """Result lines (id, category, error, score) with the score's fields as columns.

    ``score`` is a struct; a line is an error if it or its score says so.
    """
    fields = lines.schema["score"].dataType.fieldNames()
    out = {c: F.col(f"score.{c}") if c in fields else F.lit(None).cast("double") for c in SCORES}
    passed = F.coalesce(F.col("score.passed"), F.lit(False)) if "passed" in fields else F.lit(False)
    error = F.coalesce(F.col("error").cast("string"), F.col("score.error").cast("string") if "error" in fields else F.lit(None).cast("string"))
    return lines.withColumns({**out, "passed": passed, "error": error}).drop("score")


def _category() -> Column:
    return F.coalesce(T.blank_to_null(F.col("category")), F.lit("uncategorized"))


def _stats() -> list[Column]:
    out = [F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if(F.col("error").isNotNull()).alias("errors")]
    return out + [F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in SCORES]


def run_stats(runs: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """Numbers, pass rate and mean scores of each run by category and, as null, over all."""
    r = runs.withColumn("category", _category())
    cube = r.groupingSets([[*keys, "category"], [*keys]], *keys, "category").agg(*_stats(), F.grouping("category").alias("overall"))
    rate = F.when(F.col("n") > 0, F.col("passed") / F.col("n")).otherwise(0.0)
    return cube.select(*keys, F.when(F.col("overall") == 1, F.lit(None)).otherwise(F.col("category")).alias("category"), "n", "passed", "errors", rate.alias("pass_rate"), *SCORES)


def compared(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both runs over the cases that both have, by the baseline's category and, as null, over all.

    Returns category, n, and for passed, errors and each score what the baseline and the
    candidate have and the change as it is shown; over all first, then large categories first.
    """
    b = base.select("id", _category().alias("category"), "passed", "error", *SCORES, F.lit("base").alias("run"))
    shared = b.select("id", "category").join(candidate.select("id"), "id", "left_semi")
    rows = b.join(candidate.select("id"), "id", "left_semi").unionByName(candidate.select("id", "passed", "error", *SCORES, F.lit("candidate").alias("run")).join(shared, "id"))
    numbers = ("passed", "errors", *SCORES)
    of = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c)))
    wide = run_stats(rows).groupBy("category").agg(F.max("n").alias("n"), *(of(run, c).alias(f"{run}_{c}") for c in numbers for run in ("base", "candidate")))
    deltas = [T.signed_delta(F.col(f"base_{c}"), F.col(f"candidate_{c}"), as_int=c in ("passed", "errors")).alias(f"{c}_delta") for c in numbers]
    out = wide.select("category", "n", *(f"{run}_{c}" for c in numbers for run in ("base", "candidate")), *deltas)
    return out.orderBy(F.col("category").isNotNull(), F.desc("n"), "category")


def paired(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Cases of both runs, with the change of their outcome."""
    b = base.select("id", _category().alias("category"), F.coalesce("passed", F.lit(False)).alias("base_passed"))
    both = b.join(candidate.select("id", F.coalesce("passed", F.lit(False)).alias("candidate_passed")), "id")
    flip = F.when(~F.col("base_passed") & F.col("candidate_passed"), "gained").when(F.col("base_passed") & ~F.col("candidate_passed"), "lost")
    return both.withColumn("flip", flip)


def unpaired(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Ids that one run alone has."""
    a, b = base.select("id").distinct(), candidate.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("only_in", F.lit("base")).unionByName(b.join(a, "id", "left_anti").withColumn("only_in", F.lit("candidate")))


def verdict(pairs: DataFrame) -> DataFrame:
    """Passes of both runs, flips, whether the candidate holds its ground, and the exit code of that."""
    out = pairs.agg(
        F.count("*").alias("n"), F.count_if("base_passed").alias("base_passed"), F.count_if("candidate_passed").alias("candidate_passed"),
        F.count_if(F.col("flip") == "gained").alias("gained"), F.count_if(F.col("flip") == "lost").alias("lost"),
    )
    holds = F.col("candidate_passed") >= F.col("base_passed")
    words = F.when(F.col("n") == 0, "no shared cases").when(holds, "candidate >= baseline").otherwise("candidate REGRESSED")
    return out.withColumns({"verdict": words, "exit_code": F.when((F.col("n") > 0) & holds, 0).otherwise(1)})
