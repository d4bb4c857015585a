"""Operator 12 against pairs of words compared by a table of edits, and words cut by a pattern."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lexforge.llm import spelling
from lexforge.llm.trie import Trie

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DOCS = "doc_id long, text string, word string, n long, form string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def counted(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for x in RUN.findall(text or ""):
            x = x.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{x}".encode())
            if h % 97 == 0:
                k = h % len(x)
                x = x[:k] + x[k + 1 :]
            n[x] += 1
    return {x: k for x, k in n.items() if len(x) >= 5 and k >= 3}


def expected(rows):
    n = counted(rows)
    near = {x: [y for y in n if abs(len(x) - len(y)) < 2 and distance(x, y) == 1] for x in n}
    form = {}
    for x, ys in near.items():
        best = min(ys, key=lambda y: (-n[y], y), default=None)
        form[x] = best if best is not None and n[best] >= 2 * n[x] else None

    def root(x):
        return x if form[x] is None else root(form[x])

    return sorted(((x, form[x], root(x), n[x], len(near[x]), n.get(form[x])) for x in n), key=str)


def texts(seed=1):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aabcdé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    stems += ["aaaaa", "aaaaaa", "aaaaaaa", "abaaa", "ÿÿÿÿÿ", "ÀÀÀÀÀ", "÷÷÷÷÷é", "x" * 70, "x" * 71, "é" * 40]

    def word():
        w = rng.choice(stems[: rng.choice([5, 20, 70])])
        if rng.random() < 0.3:
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(["", "a", "é", "Z", w[k] * 2]) + w[k + 1 :]
        return w.upper() if rng.random() < 0.1 else w

    rows = [(i, " ".join(word() + rng.choice(["", ",", "1", "Ā", "漢", "-"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(None, "aaaaa bbbbb"), (None, None), (5, None), (6, ""), (7, "aaaaa " * 20_000), (8, "Aaaaa"), (8, "Aaaaa"), (9, "q" * 5000 + " " + "q" * 5001)] + [(k, "q" * 5000) for k in range(20, 24)]
    return [(*r, "x", 1, "y") for r in rows]


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_variants_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = expected(rows)
    assert len(want) > 100 and any(x[1] for x in want) and any(x[2] not in (x[0], x[1]) for x in want)
    assert got(spelling.variants(df)) == want
    assert got(spelling.variants(df, size=50)) == want  # several shards


def test_variants_empty(spark):
    assert got(spelling.variants(spark.createDataFrame([], DOCS))) == []
    assert got(spelling.variants(spark.createDataFrame([(1, "a b", "x", 1, "y"), (2, None, None, None, None)], DOCS))) == []


def test_counts_of_words():
    rows = texts(2)
    words, n = spelling.counts(["" if r[0] is None else str(r[0]) for r in rows], pa.array([r[1] for r in rows], pa.string()))
    total = Counter()
    for x, k in zip(words.to_pylist(), n.tolist(), strict=True):
        total[x] += k
    assert {x: k for x, k in total.items() if k >= 3} == counted(rows)


def test_trie_neighbours():
    rng = random.Random(3)
    for letters, most in (("ab", 6), ("abz", 5), ("aÀé÷ÿz", 4)):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(150)}, key=str.encode)
        asked = list(dict.fromkeys(words[::2] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(60)]))
        trie = Trie.unpack(Trie.build(pa.array(words), np.arange(len(words))).pack())
        q, x = trie.near(pa.array(asked))
        found = [(asked[a], words[b]) for a, b in zip(q.tolist(), x.tolist(), strict=True)]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b) for a in asked for b in words if distance(a, b) == 1}
        assert trie.words(x).to_pylist() == [b for _, b in found]
