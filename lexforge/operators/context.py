"""From ranked chunks to the evidence that a question is given."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R, text as T
from ..functions.tokens import ESTIMATE, Estimate, Library
from ..scratch import stored
from ..session import ship
from ..sources import files as S, pdf
from . import catalog, ranking

BUDGET, WINDOW = 50_000, 1
#: Chunks that a follow-up question gets.
FOLLOW_UP_K = 5


def neighbours(ranked: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct (query_id, document_id, chunk_index) within ``window`` of a ranked chunk."""
    near = F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window))
    return ranked.select("query_id", "document_id", near.alias("chunk_index")).distinct()


def expanded(ranked: DataFrame, chunks: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ranked chunks with their neighbours, and each document's place, status and date."""
    of_doc = ranked.groupBy("query_id", "document_id").agg(
        F.min("rank").alias("place"), F.max_by("validity_status", "rank").alias("validity_status"), F.max_by("effective_date", "rank").alias("own_date")
    )
    own = [c for c in chunks.columns if c not in ("document_id", "chunk_index", "effective_date", "embedding")]
    out = neighbours(ranked, window).join(chunks.select("document_id", "chunk_index", "effective_date", *own), ["document_id", "chunk_index"]).join(of_doc, ["query_id", "document_id"])
    return out.withColumn("effective_date", F.coalesce(T.blank_to_null(F.col("own_date")), F.col("effective_date"))).drop("own_date")


def blocks(expanded_chunks: DataFrame) -> DataFrame:
    """(query_id, blocks): a header block and a block per chunk for each document.

    Headers speak of the first chunk of the document that is there, not of the best.
    """
    c = F.col
    cite = T.citation(c("document_id"), c("chunk_index"), c("page_start"), c("page_end"))
    block = T.source_block(cite, c("document_title"), c("page_start"), c("page_end"), c("section_header"), c("document_ref"), c("content"))
    head = T.header(c("document_title"), c("document_ref"), c("effective_date"), c("validity_status"))
    rows = expanded_chunks.select("query_id", "document_id", "place", F.struct("chunk_index", head.alias("head"), block.alias("block")).alias("x"))
    docs = rows.groupBy("query_id", "document_id", "place").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    docs = docs.select("query_id", "place", F.concat(F.array(F.element_at("xs", 1)["head"]), F.transform("xs", lambda x: x["block"])).alias("blocks"))
    every = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "blocks"))).alias("d"))
    return every.select("query_id", F.flatten(F.transform("d", lambda x: x["blocks"])).alias("blocks"))


def fit(parts: Column, budget: int | Column = BUDGET, sizer: Estimate | Library = ESTIMATE) -> Column:
    """The blocks, in order, that still fit; one that doesn't is skipped, and the next is tried."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    sized = F.zip_with(parts, sizer.of_each(parts), lambda x, n: F.struct(x.alias("x"), n.cast("long").alias("n")))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(a: Column, b: Column) -> Column:
        n = a["used"] + b["n"]
        return F.when(n <= budget, F.struct(n.alias("used"), F.array_append(a["kept"], b["x"]).alias("kept"))).otherwise(a)

    return F.aggregate(sized, start, step, lambda a: a["kept"])


def context(ranked: DataFrame, chunks: DataFrame, window: int = WINDOW, budget: int = BUDGET, sizer: Estimate | Library = ESTIMATE) -> DataFrame:
    """(query_id, context) of each question."""
    return blocks(expanded(ranked, chunks, window)).select("query_id", F.array_join(fit(F.col("blocks"), budget, sizer), "\n\n").alias("context"))


#: Neighbouring documents of a question that one task walks along at a time.
BLOCK = 4096
#: Documents given to all questions that are broadcast to the texts; more are joined by shuffle.
FEW = 1_000_000
_DECIDED = "query_id {0}, place long, document_id long, what string, room long"


def _walk(budget: int, least_left: int):
    """Walk along one block of a question's documents, best first, from where it was left."""

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        rows = block.sort_values("place")
        rows = rows[rows["place"] > rows["after"]]
        q, used, out = block["query_id"].iloc[0], int(block["used"].iloc[0]), []
        for place, doc, score, n in zip(rows["place"], rows["document_id"], rows["score"], rows["tokens"], strict=True):
            left = budget - used
            if n <= left:
                used += int(n)
                out.append((q, place, doc, "whole", used))
            elif left > least_left and score > 0:  # how much of its text fits is found outside
                out.append((q, place, doc, "cut", used))
                break
        else:
            out.append((q, block["place"].max(), None, "end", used))
        return pd.DataFrame(out, columns=["query_id", "place", "document_id", "what", "room"]).astype({"document_id": "Int64"})

    return walk


def pack_documents(scored: DataFrame, budget: int, least_left: int = 3000, least_chars: int = 500, sizer: Estimate | Library = ESTIMATE, texts: DataFrame | None = None) -> DataFrame:
    """Whole documents by falling score while they fit; the best of the rest cut to size.

    ``scored`` has query_id, document_id, title, score and text; or, where all questions see the same
    texts, tokens (:meth:`sizer.of` the text), and ``texts`` has (document_id, text), so that no text is there
    once for each question.  A document that
    doesn't fit is cut if enough is left and it scores at all: to 0.8 of the share
    that would fit, then by 0.8 again and again until it does; or it is skipped.

    Places of documents are found by counted ranges.  A round walks along one block of BLOCK places of each question, by ids,
    scores and sizes: the next one in which a document may fit (by its smallest size) or may be
    cut.  What is left only falls, so blocks that are passed over hold nothing but skipped and
    empty documents.  Only texts that are given or cut are joined.  A walk stops at a document that is to be cut; that text alone is
    looked at, and the walk goes on after it.  A cut takes most of what is left, so there are few rounds.  Returns
    query_id, place, document_id, title, text and skipped.
    """
    spark = scored.sparkSession
    ship(spark)
    kind = dict(scored.dtypes)["query_id"]
    key = F.col("document_id").cast("long").alias("document_id")
    if texts is None:
        texts, on, tokens = scored.select("query_id", key, "text"), ["query_id", "document_id"], sizer.of(F.col("text"))
    else:
        texts, on, tokens = texts.select(key, "text"), ["document_id"], F.col("tokens")
    placed = ranking.placed(scored.select("query_id", key, "title", "score", tokens.cast("long").alias("tokens")), "query_id", [F.desc("score"), F.col("document_id")], "place")
    placed = placed.withColumn("block", F.floor((F.col("place") - 1) / BLOCK).cast("long"))
    hope = F.coalesce(F.max((F.col("score") > 0) & (F.col("tokens") > 0)), F.lit(False))
    blocks = stored(placed.groupBy("query_id", "block").agg(F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("smallest"), hope.alias("hope"), F.max("place").alias("last"), F.count_if(F.col("tokens") == 0).alias("empty")), "pack-blocks")
    state, rounds = blocks.select("query_id").distinct().withColumns({"used": F.lit(0).cast("long"), "after": F.lit(0).cast("long")}), []
    while True:
        left = F.lit(budget) - F.col("used")
        due = blocks.join(state, "query_id").where((F.col("last") > F.col("after")) & ((F.col("smallest") <= left) | ((left > least_left) & F.col("hope"))))
        due = due.groupBy("query_id").agg(F.min("block").alias("block"), F.first("used").alias("used"), F.first("after").alias("after"))
        rows = placed.join(F.broadcast(due), ["query_id", "block"]).select("query_id", "place", "document_id", "score", "tokens", "used", "after")
        done = stored(rows.groupBy("query_id").applyInPandas(_walk(budget, least_left), _DECIDED.format(kind)), "pack")
        if not done.take(1):
            break
        rounds.append(done.where("what = 'whole'").select("query_id", "place", "what", F.lit(None).cast("long").alias("chars")))
        ends = done.where("what = 'end'").select("query_id", F.col("room").alias("used"), F.col("place").alias("after"))
        cuts = done.where("what = 'cut'")
        if cuts.take(1):
            found = texts.join(F.broadcast(cuts), on)
            left = F.lit(budget) - F.col("room")
            first = F.floor(F.length("text") * (left / sizer.of(F.col("text"))) * 0.8).cast("long")
            found = found.withColumns({"left": left, "first": first}).withColumn("tries", F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.aggregate(F.sequence(F.lit(0), i), F.col("first"), lambda a, j: F.when(j == 0, a).otherwise(F.floor(a * 0.8)))))
            found = found.withColumn("cut", F.transform("tries", lambda n: F.substring(F.col("text"), F.lit(1), n.cast("int")))).withColumn("sizes", sizer.of_each(F.col("cut")))
            fits = F.filter(F.arrays_zip("tries", "sizes"), lambda x: (x["sizes"] <= F.col("left")) | (x["tries"] <= least_chars))
            found = found.withColumn("fit", F.element_at(fits, 1))
            enough = F.col("fit.tries") > least_chars
            found = found.select("query_id", "place", F.when(enough, "cut").otherwise("skipped").alias("what"), (F.col("room") + F.when(enough, F.col("fit.sizes")).otherwise(0)).alias("room"), F.col("fit.tries").alias("chars"))
            found = stored(found, "pack-cut")
            rounds.append(found.where("what = 'cut'").select("query_id", "place", "what", "chars"))
            ends = ends.unionByName(found.select("query_id", F.col("room").alias("used"), F.col("place").alias("after")))
        state = ends
    rows = placed.select("query_id", "place", "document_id", "title", F.when(F.col("tokens") == 0, "whole").otherwise("skipped").alias("else"))
    if rounds:
        decided = stored(reduce(DataFrame.unionByName, rounds), "decided")
        few = F.broadcast if decided.count() + blocks.agg(F.sum("empty")).first()[0] <= FEW else lambda df: df
        rows = rows.join(few(decided), ["query_id", "place"], "left")
    else:
        few = lambda df: df
        rows = rows.withColumns({"what": F.lit(None).cast("string"), "chars": F.lit(None).cast("long")})
    rows = rows.withColumn("what", F.coalesce("what", "else")).drop("else")
    given = texts.join(few(rows.where("what != 'skipped'")), on)
    cut = F.col("what") == "cut"
    title = F.when(cut, F.concat("title", F.lit(R.CUT_TITLE))).otherwise(F.col("title"))
    text = F.when(cut, F.concat(F.substring(F.col("text"), F.lit(1), F.col("chars").cast("int")), F.lit(R.CUT_TEXT))).when(F.col("what") == "whole", F.col("text"))
    given = given.select("query_id", "place", "document_id", title.alias("title"), text.alias("text"), F.lit(False).alias("skipped"))
    return given.unionByName(rows.where("what = 'skipped'").select("query_id", "place", "document_id", "title", F.lit(None).cast("string").alias("text"), F.lit(True).alias("skipped")))


def complete_parameters(
    questions: DataFrame, parameters: DataFrame, sources: DataFrame, as_of_year: int, verified_at: str, fetch: Callable[[DataFrame], DataFrame] = S.fetch, key: str = R.PARAMETER_KEY,
    phrase: str = R.PARAMETER_PHRASE, unit: str = "ILS_PER_YEAR", subject: str = R.PARAMETER_SUBJECT, terms: list[str] = R.PARAMETER_TERMS, pdf_reader: Callable[[bytes], list[str]] = pdf.read,
) -> tuple[DataFrame, DataFrame]:
    """The parameters with those that questions ask for, and no table has yet; and what was fetched.

    ``sources`` (tax_year, source_title, source_url, source_page) are the curated addresses.
    A year that is asked for and missing is fetched once, however many questions ask for it;
    its amount stands next to ``phrase`` in the pages of a PDF.  Years without an address,
    addresses that fail and pages without the amount leave no row: outcomes (tax_year,
    value_text, error) say so, and the next call tries again.  ``fetch`` takes rows (tax_year,
    url) and adds content and error.
    """
    ship(questions.sparkSession)
    about = T.is_parameter_question(F.col("question"), subject, terms)
    years = questions.where(about).select(T.question_year(F.col("question"), F.lit(as_of_year)).cast("int").alias("tax_year")).distinct()
    missing = years.join(parameters.where(F.col("parameter_key") == key).select("tax_year"), "tax_year", "left_anti")
    known = sources.select(F.col("tax_year").cast("int").alias("tax_year"), "source_title", "source_url", "source_page")
    got = fetch(missing.join(known, "tax_year").select("tax_year", F.col("source_url").alias("url")))
    pages = S.extract(got.select("tax_year", "url", "content", F.lit("application/pdf").alias("content_type"), "error"), pdf_reader=pdf_reader)
    amount = T.amount_by_phrase(F.col("text"), phrase)
    found = stored(pages.select("tax_year", amount.alias("value_text"), F.when(F.col("error").isNull() & amount.isNull(), "no amount").otherwise(F.col("error")).alias("error")), "parameters")
    new = found.where("value_text IS NOT NULL AND error IS NULL").select("tax_year", "value_text").join(known, "tax_year").withColumns({
        "parameter_key": F.lit(key), "unit": F.lit(unit), "source_type": F.lit("official_web_fallback"), "verified_at": F.lit(verified_at).cast("timestamp"),
    })
    new = new.select(*[F.col(c).cast(t).alias(c) for c, t in parameters.dtypes if c in new.columns])
    outcomes = missing.join(found, "tax_year", "left").select("tax_year", "value_text", F.when(F.col("value_text").isNull() & F.col("error").isNull(), "no address").otherwise(F.col("error")).alias("error"))
    return catalog.upsert(parameters, new, ["parameter_key", "tax_year"]), outcomes


def parameter_context(
    questions: DataFrame, parameters: DataFrame, as_of_year: int, fallback: DataFrame | None = None, key: str = R.PARAMETER_KEY, subject: str = R.PARAMETER_SUBJECT, terms: list[str] = R.PARAMETER_TERMS
) -> DataFrame:
    """The evidence block of a yearly parameter, for questions about it; the exact year alone."""
    about = T.is_parameter_question(F.col("question"), subject, terms)
    asked = questions.withColumn("tax_year", F.when(about, T.question_year(F.col("question"), F.lit(as_of_year))))
    rows = parameters.where(F.col("parameter_key") == key)
    if fallback is not None:
        rows = rows.unionByName(fallback.where(F.col("parameter_key") == key).join(rows.select("tax_year"), "tax_year", "left_anti"), allowMissingColumns=True)
    fields = {c: F.col(c).cast("string") for c in ("tax_year", "value_text", "parameter_key", "unit", "source_title", "source_url")}
    fields["source_page"] = F.coalesce(T.blank_to_null(F.col("source_page")), F.lit(R.PARAMETER_NO_PAGE))
    fields["source_type"] = F.coalesce("source_type", F.lit(R.PARAMETER_SOURCE_TYPE))
    block = F.concat(*(fields[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", R.PARAMETER_BLOCK) if x))
    return asked.join(rows.select("tax_year", block.alias("parameter_context")), "tax_year", "left")


def with_sources(answer: Column, evidence: Column, most: int = 8) -> Column:
    """The answer with the list of its sources, unless it has one, which is only mended."""
    found = F.arrays_zip(
        F.regexp_extract_all(evidence, F.lit(r"\[\[SOURCE (D[^|\s]+) \| ([^\]]+)\]\]"), F.lit(1)).alias("id"),
        F.regexp_extract_all(evidence, F.lit(r"\[\[SOURCE (D[^|\s]+) \| ([^\]]+)\]\]"), F.lit(2)).alias("text"),
    )
    ids = F.slice(F.array_distinct(F.transform(found, lambda x: x["id"])), 1, most)
    lines = F.transform(ids, lambda i: F.concat(F.lit("* ["), i, F.lit("] "), F.element_at(F.filter(found, lambda x: x["id"] == i), 1)["text"]))
    pattern = F.lit(rf"(?s)\[\[TAX-PARAM-(\d+)\]\].*?{R.SOURCE_WORD}: ([^|\n]+).*?URL: (https?://[^\s\n]+)")
    taxes = F.arrays_zip(*(F.regexp_extract_all(evidence, pattern, F.lit(i)).alias(n) for i, n in ((1, "y"), (2, "t"), (3, "u"))))
    tax_lines = F.transform(taxes, lambda x: F.concat(F.lit("* [TAX-PARAM-"), x["y"], F.lit("] "), T.strip(x["t"]), F.lit(" | URL: "), x["u"]))
    mended = F.regexp_replace(answer, r"\[D?TAX-PARAM-(\d{4})\]", "[TAX-PARAM-$1]")
    missing = F.filter(tax_lines, lambda x: ~F.contains(mended, x))
    end = F.regexp_replace(mended, r"(?U)[\s\x1c-\x1f]+\z", "")
    listed = F.when(F.size(tax_lines) == 0, answer).when(F.size(missing) == 0, mended).otherwise(F.concat(end, F.lit("\n"), F.array_join(missing, "\n")))
    every = F.concat(lines, tax_lines)
    bare = F.regexp_replace(answer, r"(?U)[\s\x1c-\x1f]+\z", "")
    added = F.concat(bare, F.lit(f"\n\n---\n{R.SOURCES_TITLE}:\n"), F.array_join(every, "\n"))
    return F.when(answer.contains(R.SOURCES_TITLE), listed).when(F.size(every) == 0, answer).otherwise(added)


def with_contract(instructions: Column, contract: Column) -> Column:
    """instructions and the contract on citations, both stripped, an empty line between them."""
    return F.concat(T.strip(instructions), F.lit("\n\n"), T.strip(contract))


def user_message(question: Column, evidence: Column, follow_up: Column) -> Column:
    """F32: what is asked: with evidence, with evidence for a follow-up, or the bare question."""
    found = F.coalesce(evidence, F.lit("")) != ""
    more = F.concat(F.lit(R.FOLLOW_UP_EVIDENCE + "\n"), evidence, F.lit(f"\n\n{R.FOLLOW_UP_QUESTION}: "), question)
    plain = F.concat(F.lit(R.EVIDENCE + "\n\n"), evidence, F.lit("\n\n"), question)
    return F.when(found & follow_up, more).when(found, plain).otherwise(question)


def embed_queries(questions: DataFrame, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """A vector for each of a question's ``queries``."""
    schema = ", ".join(f"{c} {t}" for c, t in questions.dtypes) + ", vectors array<array<double>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            asked = [list(q) for q in pdf["queries"]]
            every = embedder([t for q in asked for t in q]) if asked else []
            it = iter(every)
            yield pdf.assign(vectors=[[[float(v) for v in next(it)] for _ in q] for q in asked])

    return questions.mapInPandas(run, schema)


def answer_context(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, parameters: DataFrame, as_of: str, embedder: Callable[[list[str]], list[list[float]]] | None = None, instructions: str = "",
    contract: str = "", how: ranking.Retrieval = ranking.DEFAULT, window: int = WINDOW, budget: int = BUDGET, sizer: Estimate | Library = ESTIMATE, forced: dict = R.FORCED, fallback: DataFrame | None = None,
    parameter: dict | None = None,
) -> DataFrame:
    """From questions to what a model is asked.

    ``questions`` has query_id, question and messages (how many its conversation has);
    vectors too, unless an ``embedder`` gives them for each expanded query.  Follow-ups
    get fewer chunks.  Returns query_id, question, follow_up, context (the parameter's
    block first, then the evidence), message and instructions.  The answer goes through
    :func:`with_sources`.
    """
    follow = T.is_follow_up(F.col("question"), F.col("messages"))
    q = questions.withColumn("follow_up", F.coalesce(follow, F.lit(False)))
    q = ranking.expand(q).withColumn("k", F.when(F.col("follow_up"), F.lit(min(FOLLOW_UP_K, how.k))).otherwise(F.lit(how.k)))
    q = stored(embed_queries(q, embedder) if embedder else q, "questions")
    ranked = ranking.retrieve(q, chunks, documents, how, as_of, forced)
    found = context(stored(ranked.drop("question", "ranking_question"), "evidence"), chunks, window, budget, sizer)
    p = parameter_context(q.select("query_id", "question"), parameters, int(as_of[:4]), fallback, **(parameter or {})).select("query_id", "parameter_context")
    out = q.select("query_id", "question", "follow_up").join(found, "query_id", "left").join(p, "query_id", "left")
    both = F.concat_ws("\n\n", T.blank_to_null(F.col("parameter_context")), T.blank_to_null(F.col("context")))
    out = out.select("query_id", "question", "follow_up", both.alias("context"))
    return out.withColumns({"message": user_message(F.col("question"), F.col("context"), F.col("follow_up")), "instructions": with_contract(F.lit(instructions), F.lit(contract))})
