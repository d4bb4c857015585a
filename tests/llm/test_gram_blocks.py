"""Packed blocks of n-grams: the same as joins of n-grams, and no table of n-grams is written."""

import random
from pathlib import Path

import numpy as np
import pytest

from lexforge import scratch
from lexforge.llm import gram_blocks, kneser_ney

DOCS = "doc_id long, text string, lang string"


def labels(spark, ids):
    return spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")


def test_pack():
    a = [np.array([], np.uint64), np.array([2**64 - 1, 5], np.uint64), np.array([1, 2, 3], np.uint16), np.array([0.5, -1e300]), np.array([7], np.uint8)]
    got = gram_blocks.unpack(gram_blocks.pack(*a))
    assert all(x.dtype == y.dtype and (x == y).all() for x, y in zip(a, got)) and len(got) == 5


@pytest.mark.parametrize("ids", [range(60), [3], [6, 402]])
def test_blocks_and_joins_agree(spark, monkeypatch, ids):
    rng = random.Random(7)
    words = [f"v{i}" for i in range(80)]
    texts = [(i, " ".join(rng.choices(words, range(80, 0, -1), k=rng.randint(0, 40))), rng.choice(["en", "fr", None])) for i in range(120)]
    odd = [(400, None, "en"), (401, " ", "fr"), (None, texts[3][1], "en"), (5, texts[5][1], "en"), (6, "a b", "de"), (402, "x", "xx"), (403, "a b a b a b " * 300, "en")]
    docs = spark.createDataFrame(texts + odd, DOCS).repartition(3)
    monkeypatch.setattr(gram_blocks, "SLICE", 2000)

    def rows():
        return sorted(map(tuple, kneser_ney.classify(docs, labels(spark, ids)).collect()), key=str)

    got = rows()
    monkeypatch.setattr(kneser_ney, "_in_blocks", kneser_ney._by_joins)
    want = rows()
    assert len(got) == len(want) == 127
    for x, y in zip(got, want):
        assert x[:3] == y[:3] and x[5] == y[5]
        assert x[3:5] == y[3:5] or x[3:5] == pytest.approx(y[3:5], rel=1e-8)


def test_no_table_of_n_grams_is_written(spark, monkeypatch):
    rng = random.Random(1)
    texts = [(i, " ".join(f"w{rng.randint(0, 10**5)}" for _ in range(200)), "en") for i in range(1500)]
    size = []

    def stored(df, name, real=scratch.stored):
        out = real(df, name)
        size.append(sum(p.stat().st_size for p in Path(out._scratch.removeprefix("file:")).rglob("*.parquet")))
        return out

    for module in (kneser_ney, gram_blocks):
        monkeypatch.setattr(module, "stored", stored)
    docs = spark.createDataFrame(texts, DOCS).repartition(3)
    assert kneser_ney.classify(docs, labels(spark, range(1500))).count() == 1500
    assert 0 < max(size) < sum(len(t[1]) for t in texts)


def test_words_beside():
    w = gram_blocks.K.split(gram_blocks.pa.array(["", "a b c", "d", None, "e f", ""]))
    a, b, c, d, e, f = w.hash.tolist()
    before, after = gram_blocks._beside(w)
    assert before.tolist() == [0, a, b, 0, 0, e] and after.tolist() == [b, c, 0, 0, f, 0]
    none = gram_blocks._beside(gram_blocks.K.split(gram_blocks.pa.array(["", None])))
    assert [len(x) for x in none] == [0, 0]


def test_texts_are_read_few_times(spark, monkeypatch):
    """Each word meets its counts and those of the pair after it in one pass."""
    docs = spark.createDataFrame([(i, f"a b c {i}", "en") for i in range(20)], DOCS)
    read, kind = [], type(docs)

    def passes(df, f, *args, real=kind.mapInArrow):
        read.extend(["text"] * ("text" in df.columns))
        return real(df, f, *args)

    monkeypatch.setattr(kind, "mapInArrow", passes)
    assert kneser_ney.classify(docs, labels(spark, range(10))).count() == 20
    assert 0 < len(read) <= 9
