"""Operator 5: main text of web pages, with repeats on a host found in its suffix array.

The token streams of a host's pages are concatenated; their suffixes, dealt in ranges by
host and first RUN tokens, bring equal beginnings together, and the pages are counted
that each beginning stands on.  Longer repeats are unions of such runs.  What repeats
cover goes, as far as markup leaves room for doubt.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as K
from .common import bucketed, partitions, ship
from .substrings import _pack, _sliding, _unpack, pack_keys, shard_of, unpack_keys

#: Bytes of html of a slice; of the slices of a bucket, and of pages whose suffixes meet in one task.
SLICE, BUCKET, RANGE = 4 << 20, 64 << 20, 64 << 20
#: A run of so many tokens on two distinct pages is a repeat; of so many is an anchor.
RUN, ANCHOR = 8, 4
#: A block in doubt goes when repeats cover this share of its tokens.  A block of the
#: article goes only when runs do that stand on so many pages and on this share of its host's.
COVERED, MANY, MOST = 0.8, 3, 0.5
#: When repeats cover this share of all that a page's text may be, it is a copy, and stays.
COPY = 0.8

# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe svg math canvas object select button title xmp audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that never hold main text; words in class, id or role that mark such, alone or
#: with words that only describe a place.  A form, and what is marked by words, may yet be the
#: page's layout, when its only article is inside.
SIDE_TAGS = frozenset("nav footer aside dialog menu head".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
SIDE_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored "
    "promo promotion promoted cta banner cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup login signin "
    "comment comments commentlist reply replies disqus respond toolbar pager pagination paging copyright masthead topbar".split()
)
PLACE_WORDS = frozenset("box wrapper wrap container block slot area section list bar unit inner outer item items row col column panel module group holder top bottom left right site page global small large widget zone offer offers message link links".split())
#: Words that may mark such; in an article, repeats decide.
DOUBT_WORDS = SIDE_WORDS | frozenset("share sharing social discussion related recommended recommendations teaser widget skip legal search overlay".split())
#: An element named by these, with words that only describe, is no article though its tag is one.
LESSER_WORDS = frozenset("comment comments reply replies teaser related recommended promo promoted ad ads".split())
PLAIN_WORDS = PLACE_WORDS | frozenset("article post entry story content card body text title odd even depth".split())
#: These hold a title and a standfirst (which ends like a sentence; names and dates don't) in an article, and none of it elsewhere.
HEAD_WORDS = frozenset("header".split())
MAIN_WORDS = frozenset("article articlebody content maincontent post postbody entry story main body text".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SENTENCE = re.compile(r"[.!?\u2026\u3002][\"')\]\u00bb\u2019\u201d]*$")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Headings and quotes of an article are FIXED: no repeat removes them.
MAIN, FIXED, DOUBT, SIDE, OPEN = "m", "h", "d", "s", "o"
QUOTES = frozenset("blockquote pre".split())


def _kind(tag: str, attrs: str) -> str:
    """'side', 'soft', 'doubt', 'head', 'main', 'maybe' or '' for an element; attributes count by their whole names."""
    names: list[list[str]] = []
    role = ""
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            value, name = a or b or c, name.lower()
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "side"
            if name == "role":
                role = value.strip().lower()
            elif name in ("class", "id"):
                names += [[w.lower() for w in _WORD.findall(x)] for x in value.split()]
    if tag in SIDE_TAGS or role in SIDE_ROLES:
        return "side"
    if tag in ("html", "body"):
        return ""
    words = {w for n in names for w in n}
    article = tag in ("main", "article") and not any(LESSER_WORDS & set(n) and LESSER_WORDS | PLAIN_WORDS >= set(n) for n in names)
    if not article:
        if tag == "form" or role == "form" or any(SIDE_WORDS & set(n) and SIDE_WORDS | PLACE_WORDS >= set(n) for n in names):
            return "soft"
        if tag == "article" or words & DOUBT_WORDS:
            return "doubt"
    if article or role in ("main", "article"):
        return "main"
    if tag == "header" or words & HEAD_WORDS:
        return "head"
    if words & MAIN_WORDS and tag in ("div", "section", "td"):
        return "maybe"
    return ""


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of each block of a page in order; empty blocks are left out.

    MAIN: in an article or main element (or, without such, in a container named like
    one); FIXED: a heading or quote there; DOUBT: there too, but in something that may be none
    of it.  SIDE: in something marked as a menu, header, footer, sidebar, notice, advert, form
    or comments, or mostly links.  OPEN: anything else.  Forms and containers marked by words
    that hold the page's only article (class="right-sidebar" around all of it) are its layout.
    """
    if not page:
        return []
    out: list[tuple[str, str, str, bool]] = []  # zone, text, strength of the container, whether soft ones hold that
    parts: list[str] = []
    linked = total = links = 0
    stack: list[tuple[str, str]] = []  # (tag, kind)
    side = soft = head = main = maybe = doubt = heading = quote = layout = vague = 0  # layout, vague: soft and doubtful ones around the outermost article
    open_: Counter[str] = Counter()  # tags on the stack
    unclosed: set[str] = set()  # raw elements that nothing closes from here on

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                if side or soft > layout or head and not (main and (heading or _SENTENCE.search(text))):
                    zone = SIDE
                elif main:
                    zone = DOUBT if doubt > vague else FIXED if heading or quote else MAIN
                else:
                    zone = SIDE if linked > 0.6 * total else OPEN
                out.append((zone, text, "main" if main else "maybe" if maybe else "", layout > 0))
        linked = total = 0

    def count(kind: str, by: int) -> None:
        nonlocal side, soft, head, main, maybe, doubt, layout, vague
        if kind in ("main", "maybe") and by > 0 and not main + maybe:
            layout, vague = soft, doubt
        side += by * (kind == "side")
        soft += by * (kind == "soft")
        doubt += by * (kind == "doubt")
        head += by * (kind == "head")
        main += by * (kind == "main")
        maybe += by * (kind == "maybe")
        if not main + maybe:
            layout = vague = 0

    def pop() -> None:
        nonlocal heading, quote
        tag, kind = stack.pop()
        count(kind, -1)
        open_[tag] -= 1
        heading -= tag in HEADINGS
        quote -= tag in QUOTES

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            total += lt - at
            linked += (lt - at) if links else 0
        if lt == n:
            break
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:  # a lone sign, or a tag that the page's end cuts off
            rest = page[lt + 1 : lt + 2]
            if (rest.isalpha() or rest in ("/", "!")) and page.find(">", lt) < 0:
                break
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        close, tag, attrs = m[1], m[2].lower(), m[3]
        if tag in RAW_TAGS:
            if not close and not attrs.endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if not end:
                    unclosed.add(tag)
                at = end.end() if end else n if tag in ("script", "style") else at
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if tag == "a":
            links = 0 if close else 1
        if close:
            if open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID_TAGS or attrs.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in BLOCK_TAGS:  # what a block start ends
            while stack and (stack[-1][0] in ("p", "a", "b", "i", "em", "strong", "span", "font", "u", "small") or stack[-1][0] in HEADINGS) and (open_["p"] or heading):
                pop()
            if tag == "body":
                while open_["head"]:
                    pop()
            for own, ends in (("li", ("ul", "ol", "menu")), ("dd", ("dl",)), ("dt", ("dl",)), ("tr", ("table",)), ("td", ("tr", "table")), ("th", ("tr", "table"))):
                if tag == own and open_[own]:
                    inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in (*ends, own)), -1)
                    if inner >= 0 and stack[inner][0] == own:
                        while len(stack) > inner:
                            pop()
        kind = _kind(tag, attrs)
        if kind or tag in BLOCK_TAGS or tag == "head":
            stack.append((tag, kind))
            open_[tag] += 1
            count(kind, 1)
            heading += tag in HEADINGS
            quote += tag in QUOTES
    flush()
    for strength, zones in (("main", (MAIN, FIXED, DOUBT)), ("maybe", (OPEN,))):
        for held in (False, True):  # an article that nothing soft holds goes before others
            if any(z in zones and how == strength and h == held for z, _, how, h in out):
                mine = lambda how, h, strength=strength, held=held: how == strength and h <= held
                return [((MAIN if z == OPEN else z) if mine(how, h) else SIDE if h else z, t) for z, t, how, h in out]
    return [(SIDE if h else z, t) for z, t, _, h in out]


# -- the suffixes of a host -------------------------------------------------------------

_SLICES = "src long, page_id array<long>, url array<string>, host array<string>, zones array<string>, text array<string>"
_SENT = "k long, src long, keys binary, notes binary"
_REPLY = "src long, keys binary, notes binary"
_TEXT = "page_id long, url string, text string, n_chars long, n_repeated long"


class Stream:
    """The token streams of some pages, one after the other."""

    def __init__(self, texts: list[list[str]], hosts: list[str]):
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.w = K.split(pa.array([b for page in texts for b in page], pa.string()))
        self.block_page = np.repeat(np.arange(len(texts)), n)
        self.page = self.block_page[self.w.doc]
        names, of = np.unique(np.array(hosts, object), return_inverse=True) if hosts else (np.zeros(0, object), np.zeros(0, np.int64))
        salt = [int.from_bytes(hashlib.blake2b(h.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for h in names]
        self.host = np.array(salt, np.uint64)[of.reshape(-1)] if hosts else np.zeros(0, np.uint64)

    def inside(self, size: int) -> np.ndarray:
        """Whether ``size`` tokens from each place on lie on one page."""
        n = len(self.page) - size + 1
        return self.page[:n] == self.page[size - 1 :] if n > 0 else np.zeros(0, bool)

    def suffixes(self, size: int) -> np.ndarray:
        """A number for the host and the first ``size`` tokens of each suffix."""
        h = K.windows(self.w.hash, size)
        return K.mix(h ^ K.mix(self.host[self.page[: len(h)]] + np.uint64(size)))

    def anchors(self) -> np.ndarray:
        """Of each run, the least number of the shorter ones in it."""
        return _sliding(self.suffixes(ANCHOR), RUN - ANCHOR + 1, np.minimum)

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """(block, number) of the blocks that are too short for a run; the number is of the host and all tokens."""
        n = self.w.count
        block = np.flatnonzero((n > 0) & (n < RUN))
        h = K.mix(self.host[self.block_page[block]] + n[block].astype(np.uint64) * np.uint64(K._SEED))
        for j in range(RUN - 1):
            more = n[block] > j
            h[more] = K.mix(h[more] * np.uint64(K._STEP) + self.w.hash[self.w.first[block[more]] + j])
        return block, h


def _pages_of(key: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending, on how many pages each stands)."""
    order = np.lexsort((page, key))
    key, page = key[order], page[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    fresh = new.copy()
    fresh[1:] |= page[1:] != page[:-1]
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(fresh, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)


def _found(keys: np.ndarray, notes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The note of each key of ``x``, 0 for others."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, notes[at], 0)


def _cover(n: int, starts: np.ndarray, run: int) -> np.ndarray:
    """Which of n tokens lie in the runs that begin at ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + run, -1)
    return np.cumsum(step[:n]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that two distinct pages have."""
    h = K.windows(tokens, run)
    at = np.flatnonzero(page[: len(h)] == page[run - 1 : run - 1 + len(h)])
    keys, n = _pages_of(h[at], page[at])
    return _cover(len(tokens), at[_found(keys, n, h[at]) > 1], run)


# -- passes over slices ----------------------------------------------------------------


def _parser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in K.slices(batch, "html", SLICE):
            found = [blocks(h) for h in rows.column("html").to_pylist()]
            whole = pa.array([0, rows.num_rows], pa.int32())
            zones, text = pa.array(["".join(z for z, _ in b) for b in found], pa.string()), pa.array(["\n".join(t for _, t in b) for b in found], pa.string())
            columns = [rows.column("page_id"), rows.column("url"), rows.column("host"), zones, text]
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | nth], pa.int64()), *(pa.ListArray.from_arrays(whole, c) for c in columns)], ["src", "page_id", "url", "host", "zones", "text"])
            nth += 1


def _blocks_of(one: pd.DataFrame) -> tuple[list[list[str]], Stream]:
    r = one.iloc[0]
    each = [t.split("\n") if z else [] for z, t in zip(r["zones"], r["text"], strict=True)]
    return each, Stream(each, list(r["host"]))


def _send(src: int, key: np.ndarray, note: np.ndarray, shards: int) -> pd.DataFrame:
    """Ascending keys with their notes, by the range that each lies in."""
    cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    own = [(int(k), src, slice(cut[k], cut[k + 1])) for k in np.flatnonzero(np.diff(cut))]
    return pd.DataFrame([(k, src, pack_keys(key[x]), _pack(note[x].astype(np.uint32))) for k, src, x in own], columns=["k", "src", "keys", "notes"])


def _anchor_maker(shards: int):
    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(len(pdf)):
                _, s = _blocks_of(pdf.iloc[i : i + 1])
                least, inside = s.anchors(), s.inside(RUN)
                key, n = _pages_of(K.mix(least[inside]), s.page[: len(least)][inside])
                yield _send(int(pdf["src"].iloc[i]), key, np.minimum(n, 2), shards)  # one page, or more

    return make


def _shared(counted: bool):
    """Of one range: the keys that stand on two pages or more, to each slice that has them, and if ``counted`` on how many."""

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        each, n = [unpack_keys(x) for x in pdf["keys"]], [_unpack(x, np.uint32).astype(np.int64) for x in pdf["notes"]]
        key, back = np.unique(np.concatenate(each), return_inverse=True)
        pages = np.bincount(back.reshape(-1), np.concatenate(n), len(key)).astype(np.int64)
        key, pages = key[pages > 1], pages[pages > 1]
        out = []
        for src, k in zip(pdf["src"], each, strict=True):
            total = _found(key, pages if counted else np.ones_like(pages), k)
            own = total > 0
            if own.any():
                out.append((src, pack_keys(k[own]), _pack(np.minimum(total[own], (1 << 32) - 1).astype(np.uint32))))
        return pd.DataFrame(out, columns=["src", "keys", "notes"])

    return shared


def _told(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, notes) that ranges tell a slice, ascending."""
    if not len(replies):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([unpack_keys(x) for x in replies["keys"]])
    notes = np.concatenate([_unpack(x, np.uint32) for x in replies["notes"]]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], notes[order]


def _run_maker(shards: int):
    def make(one: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        """The runs whose anchor stands on two pages, short blocks, and each host's pages."""
        if not len(one):
            return pd.DataFrame(columns=["k", "src", "keys", "notes"])
        _, s = _blocks_of(one)
        keys, notes = _told(replies)
        least = s.anchors()
        at = np.flatnonzero(s.inside(RUN) & (_found(keys, notes, K.mix(least)) > 0)) if len(least) else np.zeros(0, np.int64)
        block, short = s.short()
        key = np.concatenate([s.suffixes(RUN)[at], short, K.mix(s.host)])
        page = np.concatenate([s.page[at], s.block_page[block], np.arange(len(s.host))])
        return _send(int(one["src"].iloc[0]), *_pages_of(key, page), shards)

    return make


def _main_text(one: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    """The pages of one slice; ``replies`` tell what stands on how many pages of a host."""
    if not len(one):
        return pd.DataFrame(columns=["page_id", "url", "text", "n_chars", "n_repeated"])
    r = one.iloc[0]
    each, s = _blocks_of(one)
    keys, notes = _told(replies)
    run = s.suffixes(RUN)
    pages = np.where(s.inside(RUN), _found(keys, notes, run), 0) if len(run) else np.zeros(0, np.int64)
    enough = np.maximum(MANY, np.ceil(MOST * _found(keys, notes, K.mix(s.host))))[s.page[: len(run)]] if len(run) else pages
    n = len(s.page)
    twice, often = _cover(n, np.flatnonzero(pages > 1), RUN), _cover(n, np.flatnonzero((pages > 1) & (pages >= enough)), RUN)
    block, short = s.short()
    size = s.w.count
    in_twice, in_often = (np.diff(np.concatenate([[0], np.cumsum(x)])[s.w.first]) for x in (twice, often))
    wholly = in_twice.copy()  # with blocks too short for a run
    same = _found(keys, notes, short) > 1
    wholly[block[same]] = size[block[same]]
    texts, covered, at = [], [], 0
    for page, zones in zip(each, r["zones"], strict=True):
        own = slice(at, at + len(page))
        at += len(page)
        covered.append(int(in_twice[own].sum()))
        z = np.array(list(zones))
        main = any(x in zones for x in (MAIN, FIXED, DOUBT))  # where a page says what its article is, the rest is none
        may = np.isin(z, [MAIN, FIXED, DOUBT] if main else [OPEN]) if len(z) else np.zeros(0, bool)
        m = size[own]
        copy = in_twice[own][may].sum() >= COPY * max(1, m[may].sum())
        hit = np.where(np.isin(z, [MAIN, FIXED]), in_often[own], wholly[own]) if len(z) else m
        hit[z == FIXED] = 0
        keep = may & (copy | (hit < COVERED * np.maximum(m, 1)))
        texts.append("\n".join(b for b, k in zip(page, keep, strict=True) if k))
    page_id = pd.array([None if x is None or x != x else int(x) for x in r["page_id"]], "Int64")
    return pd.DataFrame({"page_id": page_id, "url": list(r["url"]), "text": texts, "n_chars": [len(t) for t in texts], "n_repeated": covered})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated of each row of ``pages`` (page_id, url, html).

    A page's blocks are cut at block elements and their references decoded.  What is
    surely a menu, header, footer, sidebar, notice, advert, form, script, style or reader
    comment goes by its markup.  Of the rest, the article is taken where the page has one,
    else all; and repeats on the host decide: blocks outside of articles, and blocks in
    them that may be none of it, go when runs on two distinct pages cover them (or all of a
    block that is shorter than a run repeats); blocks of the article itself only when
    runs cover them that stand on MANY pages and MOST of the host's, since an article may
    quote another, and never its headings and quotes.  A page whose text such runs cover is a copy and keeps it.
    n_repeated counts the tokens of all blocks in runs of two pages or more.

    Pages are parsed once, into a table of slices; slices send each kind of anchor, and
    then each kind of run whose anchor repeats, once, dealt by host and tokens.  So the
    whole of a host is compared, and no task holds a host.  Runs are told apart by 64-bit
    hashes of host and words.

    Null html: empty text, 0 characters.  Null or odd urls share one host ''.  Null
    page_ids stay null.  Repeated rows give a row each and are pages of their own, so
    they are copies.  Elements that nothing closes end with the page; an empty table gives
    an empty one.
    """
    spark = pages.sparkSession
    ship(spark)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    buckets, shards = (max(partitions(spark), -(-size // most)) for most in (BUCKET, RANGE))
    slices = bucketed(rows.mapInArrow(_parser, _SLICES), "html-slices", "src", buckets, level=9)
    by_src = slices.groupBy("src")
    anchors = slices.select("src", "host", "zones", "text").mapInPandas(_anchor_maker(shards), _SENT).groupBy("k").applyInPandas(_shared(False), _REPLY)
    runs = by_src.cogroup(anchors.groupBy("src")).applyInPandas(_run_maker(shards), _SENT).groupBy("k").applyInPandas(_shared(True), _REPLY)
    return by_src.cogroup(runs.groupBy("src")).applyInPandas(_main_text, _TEXT)
