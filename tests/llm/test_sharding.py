"""Operator 13 against a recursion over lists."""

import hashlib
import random
import zlib

from lexforge.llm import sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size int, uid long, tie int, leaves int"


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "é" * rng.randint(1, 50), "w " * rng.randint(1, 200)])
        out.append((i, text, rng.choice(["en", "fr", None]), "hot" if i % 3 == 0 else rng.choice(["a", "bé", None, "prefix-1", "prefix-2"]), rng.choice([None, len(text or "")])))
    out += [(None, None, None, None, None), (None, "x", "en", "a", 1), (7, "x", "en", "a", 1), (7, "x", "en", "a", 1), (9000, "y " * 30_000, "en", "a", 60_000)]
    return [(*r, "x", 1, 2, 3, 4) for r in out]


def expected(rows, leaves):
    """{(doc_id, size, crc): shard} by the rules; rows that are equal must agree."""

    def num(x):
        return None if x is None else float(int.from_bytes(x.encode()[:6].ljust(6, b"\0"), "big")) if isinstance(x, str) else float(x)

    points = []
    values = [[num(r[k]) for r in rows] for k in (3, 2, 4)]
    ends = [(min(y), max(y)) for y in ([x for x in v if x is not None] for v in values)]
    for i, r in enumerate(rows):
        text = (r[1] or "").encode()
        crc = zlib.crc32(text)
        tie = hashlib.md5(f"{'' if r[0] is None else r[0]}:{crc}".encode()).hexdigest()[:6]
        c = [0 if v[i] is None else int((v[i] - lo) / (hi - lo) * float((1 << 24) - 2)) + 1 if hi > lo else 1 for v, (lo, hi) in zip(values, ends)]
        points.append((r[0], len(text) + 1, crc, tie, c))
    out = {}

    def split(points, shard, leaves):
        if leaves == 1:
            return out.update({p[:3]: shard for p in points})
        dim = max(range(3), key=lambda d: (max((p[4][d] for p in points), default=0) - min((p[4][d] for p in points), default=0), -d))
        points = sorted(points, key=lambda p: (p[4][dim], p[3]))
        left = leaves // 2
        want, n, k = sum(p[1] for p in points) * left / leaves, 0, 0
        while k < len(points) and n + points[k][1] <= want:
            n, k = n + points[k][1], k + 1
        if k < len(points) and n + points[k][1] / 2 <= want:
            k += 1
        split(points[:k], shard, left)
        split(points[k:], shard + left, leaves - left)

    split(points, 0, leaves)
    return out


def test_shards_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, DOCS).repartition(3)
    for leaves in (16, 5):
        found = sharding.shards(df, leaves).collect()
        want = expected(data, leaves)
        assert len(found) == len(data)
        assert {(r.doc_id, r.size, r.text_crc32) for r in found} == set(want)
        repeated = {(7, 2, zlib.crc32(b"x"))}  # equal rows may fall on both sides of a cut
        assert all(want[r[:3]] == r.shard for r in found if tuple(r[:3]) not in repeated)
        for shard in {r.shard for r in found}:
            assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))


def test_shards_of_equal_rows_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 8)
    df = spark.createDataFrame([(1, "same", "en", "a", 4, "x", 1, 2, 3, 4)] * 900 + rows(100), DOCS).repartition(3)
    found = sharding.contract(df).collect()
    assert found[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    for shard in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    same = [sum(r.doc_id == 1 and r.size == 5 and r.shard == s for r in found) for s in range(16)]
    assert sum(same) >= 900 and sum(1 for x in same if x) > 1  # a hot row is no shard's alone


def test_near_equal_bytes(spark):
    rng = random.Random(8)
    data = [(i, "z" * rng.randint(0, 300), "en", "hot" if i % 2 else f"s{i % 7}", i % 50, "x", 1, 2, 3, 4) for i in range(3000)]
    found = sharding.shards(spark.createDataFrame(data, DOCS), 16).groupBy("shard").sum("size").collect()
    size = [r[1] for r in found]
    assert len(size) == 16 and max(size) - min(size) <= 4 * 301


def test_empty_and_target_bytes(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.contract(empty).collect() == []
    data = rows(60)
    df = spark.createDataFrame(data, DOCS)
    total = sum(len((r[1] or "").encode()) + 1 for r in data)
    sharding.write(df, f"{tmp_path}/out", total // 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert sorted(map(str, (tuple(r) for r in back.select("doc_id", "text", "lang", "source", "n_chars", "doc_shard", "size").collect()))) == sorted(str(r[:7]) for r in data)
