"""Operators against brute force, on odd rows: nulls, empty and long texts, ties, repeats, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from lexforge.llm import bit_sliced, decontaminate, html_text, huffman, kneser_ney, language, mixing, near_copies, pieces, substrings, token_count, token_file, words  # noqa: E402
from lexforge.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, key int, copies int"


def rows(texts, seed=1):
    rng = random.Random(seed)
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), None, "x", 1, 9) for i, t in texts]


def odd_texts(seed=3, n=60):
    rng = random.Random(seed)
    base = [str(rng.randint(0, 60)) for _ in range(400)]
    out = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, None), (4, ""), (5, " \n\t"), (6, "A b"), (6, "a b"), (7, "x"), (7, "x"), (8, "é ü 漢字   z"), (9, "w " * 30_000)]
    for k in range(n):
        a = rng.randint(0, 350)
        out.append((100 + k, " ".join(base[a : a + rng.randint(0, 50)] + [str(rng.randint(0, 9)) for _ in range(4)])))
    return out


def frame(spark, texts, parts=3):
    return spark.createDataFrame(rows(texts), DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# words and codes


def test_words_and_windows():
    texts = [None, "", " a  bc\t", "bc a", "é x \x0b y", "a" * 3_000_000 + " b"]
    w = words.split(pa.array(texts))
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2] and len(set(w.hash.tolist())) == 6
    for k in (1, 2, 3, 7, 13, 20):
        h = np.arange(50, dtype=np.uint64)
        a = words.windows(h, k)
        assert len(a) == 51 - k and len(set(a.tolist())) == 51 - k
        assert (words.windows(h[5:], k) == a[5:]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 300, 60_000])
def test_huffman_round_trip(n):
    counts = np.random.default_rng(1).zipf(1.3, n).clip(0, 10**9)
    code = huffman.Code(huffman.code_lengths(counts))
    assert code.bits <= 16 and (n == 1 or abs((2.0 ** -code.length[code.length > 0]).sum() - 1) < 1e-9)
    ids = np.random.default_rng(2).choice(n, p=counts / counts.sum(), size=2000)
    for m in (0, 1, 511, 512, 513, 2000):
        bits, marks = code.encode(ids[:m])
        assert (code.decode(bits, marks, m) == ids[:m]).all()


def thue_morse(a, b, n=11):
    x = a
    y = b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_hashes_of_structured_words():
    one, two = thue_morse("a", "b")
    assert len(one) == 2048
    for n in (1, 3, 4, 9, 11):
        some = [*thue_morse("a", "b", n), *thue_morse("ab", "ba", n), *thue_morse("aaaaaaaa", "bbbbbbbb", n)]
        w = words.split(pa.array(some))
        assert len(set(w.hash.tolist())) == len(set(some))
    data = np.frombuffer((one + two).encode(), np.uint8)
    at = np.array([0, 0, 2048]), np.array([0, 2048, 2048])
    assert words.same(data, at[0], data, at[1], np.full(3, 2048)).tolist() == [True, False, True]
    assert words.same(data, at[0], data, at[1], np.array([7, 1, 700])).tolist() == [True, False, True]
    vocabulary = words.split(pa.array(["a b"])).hash
    runs = np.array([[vocabulary[int(c == "b")] for c in x] for x in thue_morse("a", "b", 5)])
    assert len({words.windows(r, 32)[0] for r in runs}) == 2


def weak(data, start, end, seed=0):
    """A hash under which words of equal length collide, unless another seed is asked for."""
    return words.mix((end - start).astype(np.uint64)) if seed % 8 == 0 else good_hash(data, start, end, seed)


good_hash = words.span_hashes


def test_equal_hashes_are_not_taken_for_equal_words(monkeypatch):
    monkeypatch.setattr(words, "span_hashes", weak)
    texts = pa.array(["ab cd ab", "cd ab cd", "ab", "cd", "", "ab cd ab cd ab"])
    sets = [{tuple(t.split()[i : i + 3]) if len(t.split()) > 2 else tuple(t.split()) for i in range(max(1, len(t.split()) - 2))} if t else set() for t in texts.to_pylist()]
    for _ in range(2):
        got = near_copies.exact_shingles(texts)
        assert [len(x) for x in got] == [len(x) for x in sets]
        assert all(len(np.intersect1d(got[i], got[j])) == len(sets[i] & sets[j]) for i in range(6) for j in range(6))
    cache = pieces.PieceCache(lambda ts: [[ord(t[0]), len(t)] for t in ts])
    for t in ("ab cd ab xy", "xy cd ab", "zz abc abd"):
        w = words.split(pa.array([t]))
        assert cache.gather(cache.places(w.data, w.start, w.end, w.hash)).tolist() == [y for x in t.split() for y in (ord(x[0]), len(x))]
    grams = decontaminate.Grams([("1", "ab cd"), (None, "ef gh")])
    _, hit, items = grams.scan(pa.array(["ab cd", "cd ab", "gh ef gh ab"]))
    assert hit.tolist() == [True, True, False, False, False, True, True, False] and items == {0: {"1"}}


# 1


def test_kneser_ney_broadcast_and_joined_agree(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate(["the cat sat", "the dog  sat\n on the log é", "a", "", None, "ab ab ab"])]
    df = frame(spark, texts)
    model = kneser_ney.train(df)
    a = sorted((r.doc_id, r.n_chars, round(r.logp, 6)) for r in kneser_ney.scores(df, model).collect())
    monkeypatch.setattr(kneser_ney, "BROADCAST_ROWS", -1)
    assert a == sorted((r.doc_id, r.n_chars, round(r.logp, 6)) for r in kneser_ney.scores(df, model).collect())
    # what follows a history sums to less than one
    top = model.where("n = 2").groupBy(F.substring("gram", 1, 1)).agg(F.sum(F.exp("logp")).alias("p")).agg(F.max("p")).first()[0]
    assert 0 < top < 1


def test_kneser_ney_counts_words(spark):
    texts = [(i, " ".join(f"w{random.Random(i).randint(0, 10**6)}_{j}" for j in range(50))) for i in range(200)]
    model = {r.n: r["count"] for r in kneser_ney.train(frame(spark, texts)).groupBy("n").count().collect()}
    assert model[3] == 200 * 48  # an n-gram of words for each place, however few letters there are
    # the same letters and words in another order cost more
    df = frame(spark, [(0, "the cat sat on the mat and the dog sat on the log"), (1, "log the on sat dog the and mat the on sat cat the")])
    cost = {r.doc_id: -r.logp for r in kneser_ney.scores(df, kneser_ney.train(df.where("doc_id = 0"))).collect()}
    assert 0 < cost[0] < cost[1]


def test_kneser_ney_against_brute_force(spark):
    texts = [(1, "a b c a b d a b c"), (2, "b c a  b\nc d"), (3, "a b x c a b"), (3, "a b x c a b"), (4, "a"), (5, "")]
    df = frame(spark, texts)
    model = kneser_ney.train(df.where("doc_id < 3"))
    assert [r.n_words for r in kneser_ney.scores(df, model).orderBy("doc_id").collect()] == [9, 6, 6, 6, 1, 0]
    c = {3: Counter(g for i, t in texts if i < 3 for w in [t.split()] for g in zip(w, w[1:], w[2:]))}
    for n in (2, 1):
        c[n] = Counter(g[1:] for g in c[n + 1])
    kinds = len(c[1]) + 1

    def discount(n):
        k = Counter(c[n].values())
        if not k[1] or not k[2]:
            return 0.5, 0.75, 0.9
        y = k[1] / (k[1] + 2 * k[2])
        d = [1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        return tuple(min(max(x, 0.05), j + 0.95) for j, x in enumerate(d))

    lose = {n: {g: min(discount(n)[min(x, 3) - 1], x) for g, x in c[n].items()} for n in c}

    def p(g):
        if not g:
            return 1 / kinds
        n, own = len(g), {k: x for k, x in c[len(g)].items() if k[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        total = sum(own.values())
        return max(0, own.get(g, 0) - lose[n].get(g, 0)) / total + sum(lose[n][k] for k in own) / total * p(g[1:])

    want = {i: sum(np.log(p(tuple(w[max(0, k - 2) : k + 1]))) for w in [t.split()] for k in range(len(w))) for i, t in texts}
    for r in kneser_ney.scores(df, model).collect():
        assert r.logp == pytest.approx(want[r.doc_id], abs=1e-6)


def test_quality_classifier_keeps_unseen_texts(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(vocabulary, range(60, 0, -1), k=40))
    docs = frame(spark, [(i, text()) for i in range(120)] + [(200 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(5)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in kneser_ney.classify(docs, labels).collect()}
    assert sum(got[i] for i in range(80, 120)) >= 36 and not any(got[200 + i] for i in range(5))


def test_quality_classifier_whatever_is_labelled(spark):
    """Labels that a hash of the id chooses leave both parts of the trusted texts filled."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)]
    docs = frame(spark, [(i, " ".join(rng.choices(vocabulary, range(60, 0, -1), k=40))) for i in range(240)])
    for part in (0, 1):
        labels = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == part).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
        seen = {r.doc_id for r in labels.collect()}
        got = {r.doc_id: r.keep for r in kneser_ney.classify(docs, labels).collect()}
        assert sum(got[i] for i in range(240) if i not in seen) >= 0.8 * (240 - len(seen))
    one = docs.where("doc_id = 3").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert {r.doc_id for r in kneser_ney.classify(docs, one).where("keep").collect()} >= {3}


def test_quality_classifier(spark):
    good = [(i, "the cat sat on the mat and the dog on the log " * 3 + str(i % 3)) for i in range(40)]
    docs = frame(spark, [*good, (90, "%$# @@ !! QZX " * 9), (91, None), (92, " "), (None, good[0][1])])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(90, 0, 0), (30, 1, 1), (31, 1, 0), (31, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert len(got) == 44 and got[90].keep is False and got[91].perplexity is None and got[92].keep is False
    assert sum(got[i].keep for i in range(40)) >= 38
    assert kneser_ney.classify(empty(spark), labels).collect() == []
    assert not any(r.keep for r in kneser_ney.classify(docs, labels.where("false")).collect())


# 2


def test_bit_sliced_search(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 320)]
    odd = [(None, [1.0] * 6), (404, [1.0, 2.0]), (405, [3.0, -2.0]), (5, v[5][1]), (20, v[21][1]), (406, [1e6, 0.0, 0.0, 0.0, 0.0, 0.0]), (407, [1e30] * 6), (408, [-0.0] * 6)] + [(40, v[40][1])] * 30
    bad = [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6)]
    df = spark.createDataFrame([(*x, "z") for x in v + odd + bad], "vec_id long, embedding array<float>, block string").repartition(3)
    got = defaultdict(list)
    for r in bit_sliced.search(df, df.where("vec_id % 20 = 0 or vec_id = 404"), 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    q = [(i, [int(np.floor(64 * float(np.float32(c)))) if abs(c) < 1e9 else 64 * int(np.float32(c)) for c in x]) for i, x in v + odd]
    want = defaultdict(list)
    for i, w in {(i, tuple(w)) for i, w in q if i is not None and (i % 20 == 0 or i == 404)}:  # rows that repeat id and vector are one query
        others = list(q)
        others.remove((i, list(w)))
        scores = [(j, min(max(sum(a * b for a, b in zip(w, u)), -(2**63)), 2**63 - 1)) for j, u in others if len(u) == len(w)]
        top = sorted(scores, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:20]
        want[i] += [(k + 1, *x) for k, x in enumerate(top)]
    assert set(got) == set(want) == {*range(0, 320, 20), 404}
    for i in want:
        assert sorted(map(str, got[i])) == sorted(map(str, want[i]))
    assert len(got[20]) == 40 and (1, 406, 0) not in got[0] and any(j == 406 for _, j, _ in got[0] + got[20])
    assert bit_sliced.search(df.where("false"), df.where("false")).collect() == []


# 3


def test_language(spark):
    en, fr = "the cat and the dog with this thing that other", "le chat et les chiens avec cette chose que une"
    texts = [(i, " ".join(random.Random(i).choices((en if i % 2 else fr).split(), k=12))) for i in range(120)]
    odd = [(500, None), (501, ""), (502, "123 !"), (503, "THE Cat"), (None, en), (503, "le chat"), (504, "z" * 200_000)]
    df = spark.createDataFrame([(i, t, ("en" if i % 2 else "fr") if i is not None and i < 500 else None, "s") for i, t in texts + odd], "doc_id long, text string, lang string, score string")
    got = [r for r in language.identify(df).collect()]
    assert len(got) == 127
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 500}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by.items())
    assert np.mean([r.lang_pred == ("en" if i % 2 else "fr") for i, r in by.items()]) > 0.98
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (500, 501, 502)) and all(0 <= r.score <= 1 for r in got)
    kept = language.known(df)
    assert kept.columns == df.columns and kept.count() == 123  # not the text that nothing learned resembles
    language_group, language.GROUP = language.GROUP, 1  # languages in several passes
    try:
        again = [r for r in language.identify(df).collect()]
    finally:
        language.GROUP = language_group
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert language.identify(df.where("false")).collect() == []
    assert {r.lang_pred for r in language.identify(df.where("doc_id = 1").withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_grams(text):
    """N-grams of each word between fences, by falling frequency, then length, then code points."""
    low, words_ = (text or "").lower(), [""]
    for c in low:
        words_[-1:] = [words_[-1] + c] if c.isalpha() else [words_[-1], ""]
    n = Counter(f"_{w}_"[i : i + k] for w in words_ if w for k in (1, 2, 3) for i in range(len(w) + 3 - k))
    n.pop("_", None)
    return n


def brute_order(n):
    return sorted(n, key=lambda g: (-n[g], len(g), [ord(c) for c in g]))


@pytest.mark.parametrize("held", [language.HELD, 50])
def test_language_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(language, "HELD", held)
    rng, size = random.Random(8), 30
    alphabets = {"aa": "abcdeé", "bb": "abxyzü", "zh": "漢字仮名交", "tie": "abcdeé"}
    texts = []
    for i in range(120):
        lang = rng.choice(list(alphabets))
        texts.append((i, " ".join("".join(rng.choices(alphabets[lang], k=rng.randint(1, 7))) for _ in range(rng.randint(0, 30))) + rng.choice(["", "!? 12", "\n"]), rng.choice([lang, lang, None])))
    texts += [(200, None, "aa"), (201, "123", "bb"), (202, "Ab ab", None), (None, "ab", "aa"), (203, "ωω", None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    total = defaultdict(Counter)
    for i, t, lang in texts:
        if i is not None and lang and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            total[lang] += brute_grams(t)
    profiles = {lang: {g: k for k, g in enumerate(brute_order(n)[:size])} for lang, n in total.items() if n}
    want = []
    for i, t, _ in texts:
        top = brute_order(brute_grams(t))[:size]
        far = {lang: sum(min(abs(ranks.get(g, 10 * size) - k), size) for k, g in enumerate(top)) for lang, ranks in profiles.items()}
        best = min(sorted(far), key=far.get) if top else "und"
        want.append((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, best, round(1 - far[best] / (size * len(top)), 9) if top else 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language.identify(df, size).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


# 4


def bench(spark):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:20])), (2, " ".join(w[10:24])), (3, "Short ITEM here"), (10, "the"), (4, None), (5, "!!"), (None, "w1"), (1, "other words of one")]
    return spark.createDataFrame(items, "item_id long, text string"), w, items


def brute_hits(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, hit, found = low(text), set(), set()
    for i, t in items:
        w = low(t)
        n = min(13, len(w))
        if not n:
            continue
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(d) - n + 1):
            if tuple(d[k : k + n]) in grams:
                hit.update(range(k, k + n))
                if i is not None:  # hits, but has no name
                    found.add(str(i))
    return len(d), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 12])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    benchmark, w, items = bench(spark)
    texts = [(1, "x " * 300 + " ".join(w[3:17]).upper()), (2, " ".join(w[8:30])), (3, "a short-item/here"), (4, None), (5, ""), (6, "w1 w2"), (None, " ".join(w[:13])), (7, "the end"), (7, "the end"), (8, "é the"), (9, "y " * 100_000)]
    df = frame(spark, texts)
    got = sorted(map(str, (tuple(r) for r in decontaminate.digest(decontaminate.scan(df, benchmark)).collect())))
    assert got == sorted(str((i, *brute_hits(t, items))) for i, t in texts)
    kept = decontaminate.clean(df, benchmark)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in texts if not brute_hits(t, items)[-1])
    assert decontaminate.scan(empty(spark), benchmark).collect() == []
    assert decontaminate.digest(decontaminate.scan(df, benchmark.where("false"))).where("contaminated").count() == 0


# 5

PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><div id="cookie-notice">We use cookies</div><header><a href=/>Home</a><h1>Site</h1></header>
<div class="sidebar"><p>side</div><main><article><header><h1>Tit &amp; le</h1><p class=byline>By me</p></header><p>One <b>two</b>&nbsp; three<br>four<div class="ad-slot"><p>Buy</p></div>
<ul><li>i1<li>i2</ul><p class="notice">Sign<p>Five < six <form><input>q</form>end<section class="comments"><article><p>nice</p></article></section></article></main><footer>f</footer><script>var a="</p>";</script>"""


def test_html(spark):
    plain = lambda k: f"<body><div><a href=/>Home</a> <a href=/n>News of the day and more</a></div><p>Buy our paper every day for less than one coin now</p><p>Story {k} " + " ".join(f"s{k}_{j}" for j in range(20)) + "</p>"
    pages = [(1, "http://a.b/1", PAGE), (2, None, None), (3, "bad url", ""), (None, "http://a.b/2", PAGE), (None, "http://a.b/2", PAGE)] + [(10 + k, f"https://Plain.example/{k}", plain(k)) for k in range(9)]
    df = spark.createDataFrame([(*p, "x", 3) for p in pages], "page_id long, url string, html string, host string, shards int")
    got = [r for r in html_text.extract(df).collect()]
    by = {r.page_id: r.text for r in got}
    assert len(got) == 14 and by[1] == "Tit & le\nOne two three four\ni1\ni2\nFive < six\nend" and by[2] == by[3] == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert all(by[10 + k].startswith(f"Story {k} ") and "\n" not in by[10 + k] for k in range(9))  # the repeated notice goes
    assert html_text.extract(df.where("false")).collect() == []


def test_html_repeats_on_a_large_host(spark):
    rng = random.Random(5)
    prose = lambda k: " ".join(f"p{k}_{rng.randint(0, 999)}" for _ in range(30))
    notes = [" ".join(f"n{j}_{i}" for i in range(12)) for j in range(60)]
    # each notice stands on two pages of a host of 120, so mostly in different shards
    pages = [(k, f"http://large.example/{k}", f"<body><p>{prose(k)}</p><p>{notes[k % 60]}</p>") for k in range(120)]
    other = (500, "http://small.example/1", f"<body><p>{prose(500)}</p><p>{notes[0]}</p>")  # another host: no repeat
    df = spark.createDataFrame([*pages, other], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert len(got) == 121
    assert all(got[k].n_repeated == 12 and "n" not in got[k].text for k in range(120))
    assert got[500].n_repeated == 0 and notes[0] in got[500].text


def test_html_repeats_inside_articles(spark):
    line = "This story first ran in our weekly paper for all readers of the region"
    page = lambda k: "<body><article><p>" + " ".join(f"s{k}_{j}" for j in range(40)) + f"</p><p>{line}</p></article></body>"
    pages = [(k, f"http://a.example/{k}", page(k)) for k in range(6)] + [(10 + k, f"http://a.example/copy{k}", page(99)) for k in range(2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(line not in got[k] and got[k].startswith(f"s{k}_0 ") for k in range(6))
    assert got[10] == got[11] and got[10].endswith(line)  # copies of a page keep theirs
    few = spark.createDataFrame([*pages[:2], *((20 + k, f"http://a.example/{k}", f"<article><p>{' '.join(f'z{k}_{j}' for j in range(30))}</p></article>") for k in range(6))], "page_id long, url string, html string")
    assert sum(line in r.text for r in html_text.extract(few).collect()) == 2  # two of eight may quote the same


def brute_main_text(pages):
    """The rules of html_text.extract with sets of token sequences, page by page."""
    host = lambda u: (re.match(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", u or "") or ["", ""])[1].lower()
    parsed = [(host(u), html_text.blocks(h)) for _, u, h in pages]
    stands, hosts = defaultdict(set), Counter(h for h, _ in parsed)
    for k, (h, b) in enumerate(parsed):
        tokens = [x for _, t in b for x in WORD.findall(t)]
        for i in range(len(tokens) - 7):
            stands[h, tuple(tokens[i : i + 8])].add(k)
        for _, t in b:
            if 0 < len(WORD.findall(t)) < 8:
                stands[h, "short", tuple(WORD.findall(t))].add(k)
    out = []
    for (page_id, url, _), (h, b) in zip(pages, parsed):
        per = [WORD.findall(t) for _, t in b]
        tokens, of = [x for w in per for x in w], [j for j, w in enumerate(per) for _ in w]
        twice, often = set(), set()
        for i in range(len(tokens) - 7):
            n = len(stands[h, tuple(tokens[i : i + 8])])
            twice.update(range(i, i + 8) if n > 1 else ())
            often.update(range(i, i + 8) if n > 1 and n >= max(3, hosts[h] / 2) else ())
        share = lambda which, j: sum(1 for i in which if of[i] == j)
        main = any(z in "md" for z, _ in b)
        may = [j for j, (z, _) in enumerate(b) if z in ("md" if main else "o")]
        copy = sum(share(twice, j) for j in may) >= 0.8 * max(1, sum(len(per[j]) for j in may))
        kept = []
        for j in may:
            n = len(per[j])
            hit = share(often, j) if b[j][0] == "m" else n if 0 < n < 8 and len(stands[h, "short", tuple(per[j])]) > 1 else share(twice, j)
            if copy or hit < 0.8 * max(1, n):
                kept.append(b[j][1])
        out.append((page_id, url, "\n".join(kept), len(twice)))
    return out


def test_html_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words_ = lambda k, n: " ".join(f"{k}{rng.randint(0, 10**6)}" for _ in range(n))
    bars = [words_("b", n) for n in (3, 5, 7, 8, 9, 20, 40)]
    pages = []
    for k in range(90):
        host = rng.choice(["a.example", "A.example", "b.example", "c.example"])
        parts = [f"<p>{words_('t', rng.randint(1, 30))}</p>" for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 4)):
            mark = rng.choice(["", "", ' class="share"', ' class="ad box"', ' id="discussion"'])
            parts.insert(rng.randint(0, len(parts)), f"<div{mark}>{rng.choice(bars)}</div>")
        body = "".join(parts)
        if rng.random() < 0.6:
            body = f"<p>{rng.choice(bars)}</p><article>{body}</article><p>{rng.choice(bars)}</p>"
        pages.append((k, f"http://{host}/{k}", rng.choice([f"<body>{body}</body>", f"<html><body><nav>menu</nav>{body}"])))
    pages += [(200 + j, f"http://b.example/copy{j}", pages[3][2]) for j in range(3)] + [(300, None, None), (None, "odd", pages[4][2]), (None, "odd", pages[4][2]), (301, "http://d.example/", "<svg>" * 2000 + "<p>x</p>")]
    want = brute_main_text(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    for size in (html_text.SLICE, 3000):  # a host in one slice, or in many
        monkeypatch.setattr(html_text, "SLICE", size)
        got = [(r.page_id, r.url, r.text, r.n_repeated) for r in html_text.extract(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    alone = [(i, u, "\n".join(t for z, t in html_text.blocks(h) if z in ("md" if any(y in "md" for y, _ in html_text.blocks(h)) else "o"))) for i, u, h in pages]
    assert sum(a != w[:3] for a, w in zip(alone, want)) > 30  # what repeats decides


def test_html_marks_in_doubt(spark):
    page = lambda k: f"""<main><p>{" ".join(f"s{k}_{j}" for j in range(30))}</p><section id="discussion"><p>{" ".join(f"d{k}_{j}" for j in range(9))}</p></section>
    <div class="market-share">Shares of {k} rose by {k} percent in one long day of trade</div><div class="cta-box">Join our club today</div><div class="social">Tell a friend of yours</div></main>"""  # noqa: E731
    df = spark.createDataFrame([(k, f"http://n.example/{k}", page(k)) for k in range(3)], "page_id long, url string, html string")
    for r in html_text.extract(df).collect():
        assert f"d{r.page_id}_8" in r.text and "Shares of" in r.text and "club" not in r.text and "friend" not in r.text


def test_html_unclosed_elements_take_linear_time():
    import time

    for piece in ("<svg>", "<div>", "<select>", "<p><b>", "<li>", "<!--", "<a href='"):
        html_text.blocks(piece * 100)
        began = time.process_time()
        html_text.blocks(piece * 60_000)
        assert time.process_time() - began < 8


def test_repeated_runs():
    rng = random.Random(2)
    for _ in range(20):
        pages = [[rng.randint(0, 3) for _ in range(rng.randint(0, 40))] for _ in range(4)]
        t, p = np.array([x for q in pages for x in q], np.uint64), np.repeat(np.arange(4), [len(q) for q in pages])
        seen = defaultdict(set)
        for k, q in enumerate(pages):
            for i in range(len(q) - 7):
                seen[tuple(q[i : i + 8])].add(k)
        want = [any(len(seen[tuple(q[i : i + 8])]) > 1 for i in range(max(0, j - 7), min(j, len(q) - 8) + 1)) for q in pages for j in range(len(q))]
        assert html_text.repeated(t, p).tolist() == want


# 6 and 7


def test_token_file(spark):
    path = P.path("word_bpe_49k.json")
    texts = odd_texts() + [(200, "Don't <|endoftext|> stop Σας é"), (201, " ".join(thue_morse("a", "b"))), (None, None), (7, "y")]
    rng = random.Random(12)
    bits = ["The", "THE", "cat", ".", ",", ".,", "..", "1", "9.", "x1.", "don't.", "I'LL,", "J\u030c", "I\u0307", "\u0130.", "É.", "é,", "<|EndOfText|>", "<|endoftext|>.", "<|", "A<", "漢.", "ß.", "K\u212a", "-", "a-b.", "…", "'S"]
    texts += [(400 + k, "".join(rng.choice(bits) + rng.choice(["", " ", "\n", "\x1c", "\u00a0"]) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    df = frame(spark, texts)
    tok = pieces.library(path)
    got = [r for r in token_file.round_trip(df, path).orderBy("start").collect()]
    assert len(got) == len(texts)
    at = 0
    want = Counter()
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in got if r.doc_id is not None]
    assert ids == sorted(ids)
    assert token_file.round_trip(empty(spark), path).collect() == []


def test_token_counts(spark):
    path = P.path("byte_bpe_50k.json")
    tok = pieces.library(path)
    rng = random.Random(3)
    alphabet = [" ", " ", "\x85", "a", "b", "the", " ", "  ", "\n", "\t", "'s", "don't", "é", "漢字", "123", "<|endoftext|>", "<|endof", "text|>", "...", "!?", "\x1c", "\U0001f600", "́"]
    texts = odd_texts() + [(300 + k, "".join(rng.choices(alphabet, k=rng.randint(0, 300)))) for k in range(60)] + [(400, "x" * 5000 + " " * 3000), (401, "q" + thue_morse("a", "e")[0]), (402, "q" + thue_morse("a", "e")[1])]
    df = frame(spark, texts)
    want = sorted(str((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512)) for i, t in texts)
    for huge, chunk, overlap in ((token_count.HUGE, token_count.CHUNK, token_count.OVERLAP), (40, 64, 4)):
        got = sorted(str(tuple(r)) for r in token_count.counts(df, path, huge=huge, chunk=chunk, overlap=overlap).collect())
        assert got == want
    assert token_count.counts(empty(spark), path).collect() == []


# 8


def brute_substrings(docs, k):
    key = lambda d: -(10**30) if d is None else d
    at, w = defaultdict(list), [WORD.findall(t or "") for _, t in docs]
    for n, (d, _) in enumerate(docs):
        for i in range(len(w[n]) - k + 1):
            at[tuple(w[n][i : i + k])].append((key(d), n, i))
    gone = [set() for _ in docs]
    for g in at.values():
        least, seen = min(g)[0], set()
        for d, n, i in sorted(g):
            if d > least or n in seen:
                gone[n].update(range(i, i + k))
            seen.add(n)
    return sorted((str(d), len(x), len(r), hashlib.sha256(" ".join(y for i, y in enumerate(x) if i not in r).encode()).hexdigest()) for (d, _), x, r in zip(docs, w, gone))


@pytest.mark.parametrize("size", [300, 8 << 20])
def test_substrings(spark, monkeypatch, size):
    monkeypatch.setattr(substrings, "SLICE", size)
    texts = odd_texts() + [(300, " ".join([thue_morse("a", "b")[0], "l m n o p"])), (301, " ".join([thue_morse("a", "b")[1], "l m n o p"])), (302, "u v " * 40), (303, "v " + "u v " * 9)]
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in substrings.deduplicate(frame(spark, texts), 4).collect())
    assert got == brute_substrings(texts, 4)
    kept = {r.doc_id: r.kept for r in substrings.deduplicate(frame(spark, [(1, "a b  c d e"), (2, "x a b c d e y")]), 4, texts=True).collect()}
    assert kept == {1: "a b c d e", 2: "x y"}
    assert substrings.deduplicate(empty(spark)).collect() == []


def test_substrings_compact_paths():
    w = words.split(pa.array(["x a b c d e f y", "z a b c d e f", "q c d e w"]))
    k = 3
    key, twice = substrings.anchors(w, k)
    edge = substrings._candidates(w, k, key[twice])
    node, note = substrings.nodes(w, k, edge)
    place, n = substrings.paths(w, k, edge, node[note == 0])
    spelt = [" ".join(w.data[a:b].tobytes().decode() for a, b in zip(w.start[p : p + m + k - 1], w.end[p : p + m + k - 1])) for p, m in zip(place, n)]
    # the graph branches where the documents part, and between these nodes edges are one path
    assert {x: spelt.count(x) for x in spelt if spelt.count(x) > 1} == {"a b c d": 2, "c d e": 3, "d e f": 2}
    many = words.split(pa.array(["x a b c d e f y", "z a b c d e f"]))
    key, twice = substrings.anchors(many, k)
    edge = substrings._candidates(many, k, key[twice])
    node, note = substrings.nodes(many, k, edge)
    place, n = substrings.paths(many, k, edge, node[note == 0])
    assert n.max() == 4 and sorted(n.tolist())[-2:] == [4, 4]  # "a b c d e f" is one path in both


def test_substrings_random(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(substrings, "SLICE", 400)
    texts = [(rng.choice([None, *range(25)]), " ".join(rng.choices("abc", k=rng.randint(0, 60)))) for _ in range(40)]
    for k in (2, 3, 5, 8):
        got = sorted((str(r[0]), r[1], r[2], r[3]) for r in substrings.deduplicate(frame(spark, texts), k).collect())
        assert got == brute_substrings(texts, k)


# 9


def brute_groups(docs, size=3, share=90):
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset() for w in (low(t) for _, t in docs)]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def family_texts():
    rng, out = random.Random(5), odd_texts(n=10)
    for fam in range(6):
        base = [str(rng.randint(0, 400)) for _ in range(rng.choice([9, 10, 11, 12, 30, 120]))]
        for c in range(rng.choice([3, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = str(rng.randint(0, 400))
            out.append((1000 + 50 * fam + c, " ".join(w[: len(w) - rng.choice([0, 0, 1, 3])])))
    rng.shuffle(out)
    return out


def test_near_copies(spark):
    texts = family_texts() + [(2000, thue_morse("a", "b")[0]), (2001, thue_morse("a", "b")[1])]
    df = frame(spark, texts)
    want = brute_groups(texts)
    assert sorted(map(str, (tuple(r) for r in near_copies.groups(df).collect()))) == sorted(map(str, want))
    five = near_copies.groups(df, 5, 80).collect()
    assert sorted(map(str, map(tuple, five))) == sorted(map(str, brute_groups(texts, 5, 80)))
    kept = near_copies.one_of_each(df)
    assert kept.columns == df.columns
    expected = Counter({(d, t) for (d, t), (_, _, c) in zip(texts, want) if c == d})
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == expected
    assert near_copies.groups(empty(spark)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if x != 7 or any(7 in e for e in links if e != (7, 7))}


# 10


def test_mixing(spark):
    texts = [t for t in odd_texts(n=200) if t[0] != 6]
    name = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("é"), F.lit(None)), (F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")) % 4 + 1).cast("int"))
    df = frame(spark, texts).withColumn("source", name)
    got = mixing.mix(df).collect()
    assert len(got) == len(texts) and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    source, sizes, targets = {}, Counter(), {}
    for r in df.collect():
        n = len(WORD.findall(r.text or ""))
        source[r.doc_id, n] = r.source  # texts of one id and length share a source here
        sizes[r.source] += n
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights, left, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        targets |= share
        if not over:
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
            open_.discard(s)
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert abs(r.target - targets[s]) < 1e-6
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 30_000 / 2 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: sum(r.taken // r["size"] for r in got if r.doc_id == i and r["size"]) for i in {r.doc_id for r in got}}) - Counter()
    assert mixing.mix(empty(spark)).collect() == []
