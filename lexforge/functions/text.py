"""Scalar functions on text, dates and costs: columns to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import rules as R

#: What strip() takes off: Unicode white space and the separators U+001C to U+001F.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_BLANKS = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_text(c: Column) -> Column:
    """at most one empty line, single blanks, stripped; newlines first, so blank lines of blanks stay."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def estimate_tokens(c: Column) -> Column:
    """0.7 tokens a byte, one at least; null and empty have none."""
    n = F.octet_length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest((n * F.lit(0.7)).cast("long"), F.lit(1).cast("long")))


WORD = r"[\p{L}\p{N}_\x{0590}-\x{05FF}]+"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokenize(c: Column, stop: Sequence[str] = R.STOP_WORDS) -> Column:
    """lower-cased words of two letters and more that are no stop words."""
    return F.filter(words(F.coalesce(c, F.lit(""))), lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def query_tokens(c: Column) -> Column:
    """words of three letters and more that are no numbers; repeats stay."""
    return F.filter(words(c), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\p{N}+$"))


def variants(w: Column, prefixes: str = R.PREFIX_LETTERS) -> Column:
    """a word, and without its first letter if that may be a prefix."""
    return F.array_compact(F.array(w, F.when((F.length(w) > 3) & F.substring(w, 1, 1).isin(*prefixes), F.substring(w, 2, 1 << 30))))


def references(c: Column, pattern: str) -> Column:
    """all matches in the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("(?U)" + pattern), F.lit(0))


def first_url(c: Column) -> Column:
    """the first web address, up to white space or a back quote."""
    return blank_to_null(F.regexp_extract(c, r"https?://[^\s`]+", 0))


def drive_id(c: Column) -> Column:
    """the id in a link to a shared file, by the first pattern that fits."""
    return F.coalesce(*(blank_to_null(F.regexp_extract(c, p, 1)) for p in (r"/file/d/([a-zA-Z0-9_-]+)", r"id=([a-zA-Z0-9_-]+)", r"/d/([a-zA-Z0-9_-]+)")))


def title_date(c: Column) -> Column:
    """the first year-first date of a title as yyyy-MM-dd; null if it is none."""
    m = blank_to_null(F.regexp_extract(c, r"(?<!\d)\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)", 0))
    d = F.try_to_date(F.regexp_replace(m, "[/.]", "-"), "yyyy-M-d")
    return F.when(F.year(d) >= 1, F.date_format(d, "yyyy-MM-dd"))


def question_year(c: Column, default: Column) -> Column:
    """the first year 20xx that stands alone, or ``default``."""
    return F.coalesce(blank_to_null(F.regexp_extract(c, r"(?U)\b(20\d{2})\b", 1)).try_cast("int"), default.cast("int"))


def amount_by_phrase(c: Column, phrase: str = R.PARAMETER_PHRASE) -> Column:
    """the number before a phrase, else the one after it."""
    flat = F.regexp_replace(c, _BLANKS, " ")
    return F.coalesce(*(blank_to_null(F.regexp_extract(flat, p, 1)) for p in (rf"(?U)([\d,]+)\s+{phrase}", rf"(?U){phrase}\s+([\d,]+)")))


def confidence(c: Column) -> Column:
    """the first confidence tag, in capitals."""
    return F.upper(blank_to_null(F.regexp_extract(c, r"(?i)CONFIDENCE:\s*(HIGH|MEDIUM|LOW)", 1)))


def normalize(c: Column) -> Column:
    """single blanks, none at the ends, lower case; null is empty."""
    return F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), _BLANKS, " ")))


def citation(document_id: Column, chunk_index: Column, page_start: Column, page_end: Column) -> Column:
    """D<doc>-P<page>, D<doc>-P<from>-<to>, or D<doc>-C<chunk> where a page is missing."""
    d = F.concat(F.lit("D"), document_id.cast("string"), F.lit("-"))
    s, e = page_start.cast("string"), page_end.cast("string")
    pages = F.concat(d, F.lit("P"), F.when(page_start == page_end, s).otherwise(F.concat(s, F.lit("-"), e)))
    chunk = F.concat(d, F.lit("C"), (F.coalesce(chunk_index, F.lit(0)) + 1).cast("string"))
    return F.when(page_start.isNotNull() & page_end.isNotNull(), pages).otherwise(chunk)


def header(title: Column, ref: Column, effective: Column, status: Column) -> Column:
    """the first line of a document's evidence; empty parts are left out."""
    label = F.lit(None).cast("string")
    for k, v in R.VALIDITY_LABELS.items():
        label = F.when(status == k, F.lit(f"[{v}]")).otherwise(label)
    date = F.concat(F.lit(R.EFFECTIVE_LABEL + ": "), blank_to_null(effective))
    return F.concat(F.concat_ws(" | ", F.concat(F.lit("=== "), title), blank_to_null(ref), date, label), F.lit(" ==="))


def source_block(cite: Column, title: Column, page_start: Column, page_end: Column, section: Column, ref: Column, content: Column) -> Column:
    """F16: a chunk as a block of evidence."""
    one = F.concat(F.lit(R.PAGE + " "), page_start.cast("string"))
    many = F.concat(F.lit(R.PAGES + " "), page_start.cast("string"), F.lit("-"), page_end.cast("string"))
    page = F.when(page_start.isNull() | page_end.isNull(), F.lit(R.NO_PAGE)).when(page_start == page_end, one).otherwise(many)
    head = F.concat(
        F.lit("[[SOURCE "), cite, F.lit(f" | {R.DOCUMENT_WORD}: "), F.coalesce(title, F.lit("None")), F.lit(" | "), page, F.lit(f" | {R.SECTION_WORD}: "),
        F.coalesce(blank_to_null(section), F.lit(R.NO_SECTION)), F.lit(" | URL: "), F.coalesce(ref, F.lit("None")), F.lit("]]\n"),
    )
    return F.concat(head, content, F.lit("\n[[/SOURCE "), cite, F.lit("]]"))


def authority(document_type: Column, title: Column) -> Column:
    """the stated type, else by what the title contains."""
    out = F.lit(R.AUTHORITY_OTHER)
    for part, kind in reversed(R.AUTHORITY_TITLES):
        out = F.when(F.lower(F.coalesce(title, F.lit(""))).contains(part), F.lit(kind)).otherwise(out)
    return F.coalesce(blank_to_null(strip(document_type)), out)


def authority_value(kind: Column, bonus: dict[str, float] = R.AUTHORITY_BONUS) -> Column:
    """what an authority adds; unknown kinds add nothing."""
    value = F.lit(0.0)
    for k, v in bonus.items():
        value = F.when(kind == k, F.lit(v)).otherwise(value)
    return value


def authority_bonus(question: Column, kind: Column, terms: Sequence[str] = R.AUTHORITY_TERMS, bonus: dict[str, float] = R.AUTHORITY_BONUS) -> Column:
    """what an authority adds, if the question is a legal one."""
    return F.when(any_in(question, terms), authority_value(kind, bonus)).otherwise(F.lit(0.0))


def any_in(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def all_in(c: Column, terms: Sequence[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & c.contains(t)
    return out


def cost(tokens_in: Column, tokens_out: Column, prices: dict[str, float] = R.PRICES) -> Column:
    """input and output tokens alone."""
    return F.round(tokens_in / 1e6 * prices["input"] + tokens_out / 1e6 * prices["output"], 6)


def cost_parts(counts: dict[str, Column], prices: dict[str, float] = R.PRICES) -> Column:
    """what each kind of token costs, and all."""
    each = {k: F.coalesce(c, F.lit(0)) / 1e6 * prices[k] for k, c in counts.items()}
    total = sum(list(each.values())[1:], list(each.values())[0])
    return F.struct(*(F.round(v, 6).alias(f"{k}_cost") for k, v in each.items()), F.round(total, 6).alias("total"))


def signed_delta(base: Column, other: Column, as_int: bool = False) -> Column:
    """a change with its sign, to three digits, or of whole numbers."""
    d = other - base
    if as_int:
        change = F.when(d == 0, "  0").otherwise(F.format_string("%+d", d.cast("long")))
        return F.concat(F.format_string("%4d -> %4d (", base.cast("long"), other.cast("long")), change, F.lit(")"))
    sign = F.when(d > 1e-9, "+").when(d < -1e-9, "-").otherwise(" ")
    return F.concat(F.format_string("%.3f -> %.3f (", base, other), sign, F.format_string("%.3f)", F.abs(d)))


def elapsed(seconds: Column, ms: bool = False) -> Column:
    """a duration to two digits, or in whole milliseconds."""
    return (seconds * 1000).cast("int") if ms else F.round(seconds, 2)


def vector_to_json(v: Column) -> Column:
    """F28"""
    return F.to_json(v)


def vector_from_json(c: Column) -> Column:
    """null where it is no array of numbers."""
    return F.from_json(c, "array<double>")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, as C and Python print it: one just between two goes to the even one.

    Java takes the larger one there.  For doubles that came as floats this is exact.
    """
    even = F.bround(x, digits)
    return F.format_string(f"%.{digits}f", F.when(even != F.round(x, digits), even).otherwise(x))


def fraction_found(text: Column, terms: Column) -> Column:
    """(share, missing) of terms that a text contains; 1.0 where there are none."""
    terms = F.coalesce(terms, F.array().cast("array<string>"))
    missing = F.filter(terms, lambda t: ~F.contains(text, t))
    n = F.size(terms)
    return F.struct(F.when(n == 0, F.lit(1.0)).otherwise((n - F.size(missing)) / n).alias("share"), missing.alias("missing"))


def extension(name: Column) -> Column:
    """what follows the last full stop, lower-cased."""
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def safe_extension(ext: Column) -> Column:
    """Letters and digits alone, or bin."""
    return F.coalesce(blank_to_null(F.regexp_replace(F.lower(ext), "[^a-z0-9]", "")), F.lit("bin"))


def title_or_url(title: Column, url: Column) -> Column:
    """F33"""
    return F.coalesce(blank_to_null(title), F.substring(url, 1, 80))


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def download_name(title: Column, path: Column | None = None, text: bool = False) -> Column:
    """the name of a download: of the original by title or path, of the text by title without extension."""
    if not text:
        return base_name(F.coalesce(blank_to_null(title), path if path is not None else F.lit(None).cast("string")))
    name = base_name(F.coalesce(blank_to_null(title), F.lit("document")))
    stem = F.regexp_extract(name, r"(?s)^(\.*[^.].*)\.[^.]*\z", 1)  # leading full stops begin no extension
    return F.concat(F.when(stem != "", stem).otherwise(name), F.lit(".txt"))


def validity(superseded_by: Column, valid_until: Column, as_of: Column) -> Column:
    """Superseded, expired (strictly before ``as_of``, compared as text) or current."""
    return F.when(superseded_by.isNotNull(), "superseded").when((F.coalesce(valid_until, F.lit("")) != "") & (valid_until < as_of), "expired").otherwise("current")


def index_status(status: Column, chunks: Column) -> Column:
    """P09"""
    return F.coalesce(blank_to_null(status), F.when(chunks > 0, "ready").otherwise("unknown"))


def is_parameter_question(question: Column, subject: str = R.PARAMETER_SUBJECT, terms: Sequence[str] = R.PARAMETER_TERMS) -> Column:
    """P11"""
    return F.coalesce(question.contains(subject) & any_in(question, terms), F.lit(False))


def is_follow_up(question: Column, messages: Column, words_: int = R.FOLLOW_UP_WORDS, markers: Sequence[str] = R.FOLLOW_UP_MARKERS) -> Column:
    """In a conversation of two messages or more, a short question or one that begins like a follow-up."""
    q = strip(question)
    starts = F.lit(False)
    for m in markers:
        starts = starts | q.startswith(m)
    n = F.when(q == "", 0).otherwise(F.size(F.split(q, _BLANKS)))
    return (messages >= 2) & ((n <= words_) | starts)


def is_quota_error(code: Column, message: Column) -> Column:
    """P13"""
    return F.coalesce(code.isin(*R.QUOTA_CODES), F.lit(False)) | F.coalesce(message.contains(R.QUOTA_CODES[1]), F.lit(False))


def source_class(kind: Column) -> Column:
    """What is said of a source of this kind: official, constructed or secondary."""
    return F.when(kind.isin(*R.OFFICIAL_KINDS), R.OFFICIAL_CLASS).when(kind == R.CONSTRUCTED_KIND, R.CONSTRUCTED_CLASS).otherwise(R.SECONDARY_CLASS)


def markdown_to_html(c: Column, attributes: dict[str, str] | None = None) -> Column:
    """the marks of Markdown as elements, one rule after the other; ``attributes`` by element."""
    out = F.coalesce(c, F.lit(""))
    for pattern, to in R.MARKDOWN:
        for name in ("h1", "h2", "h3", "ul"):
            to = to.replace("{%s}" % name, " " + attributes[name] if attributes and name in attributes else "")
        out = F.regexp_replace(out, pattern, to)
    return out


def shortened(c: Column, most: int = 60) -> Column:
    """a text's beginning, with dots where it goes on."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def shown_seconds(ms: Column) -> Column:
    """milliseconds as seconds with one digit; none and zero as a dash."""
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "-").otherwise(F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))


def shown_cost(usd: Column, digits: int = 4, none: str = "-") -> Column:
    """a cost in dollars; none and zero as ``none``."""
    return F.when(F.coalesce(usd, F.lit(0.0)) == 0, F.lit(none)).otherwise(F.concat(F.lit("$"), F.format_string(f"%.{digits}f", usd)))


def shown_day(date: Column) -> Column:
    """month and day of a date."""
    return F.coalesce(F.substring(date.cast("string"), 6, 5), F.lit(""))
