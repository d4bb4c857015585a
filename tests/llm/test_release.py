"""Operator 11 against a loop over turns; long conversations over many ranges."""

import random
import zlib
from collections import defaultdict

import numpy as np

from lexforge.llm import release

TURNS = "conv_id long, turn long, role string, text string, part int, p long"


def expected(rows):
    """(conv_id, turn, status, attempts, first_at, last_at, release_no, state) by the rules, turn after turn."""
    by = defaultdict(list)
    for conv, turn, _, text, *_ in rows:
        by[conv].append((turn is not None, turn or 0, zlib.crc32((text or "").encode()), turn))
    out = []
    for conv, turns in by.items():
        turns.sort(key=lambda x: x[:3])
        done = []
        for p, (_, _, crc, turn) in enumerate(turns):
            h = [zlib.crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode()) for k in range(9)]
            d = h[0] % 5
            up = done[p - d] if d and p >= d else None
            if up and up["status"] != "delivered":
                done.append({"status": "blocked", "attempts": 0, "first": None, "last": None})
                continue
            at = first = max(7 * p, up["last"]) if up else 7 * p
            a, status = 1, "delivered"
            while h[1] % 101 < 50 and (at < 7 * p + h[2] % 101 or h[a + 2] % 3 == 0):
                if a == 6:
                    status = "dead"
                    break
                at += 20 * 2 ** (a - 1)
                a += 1
            done.append({"status": status, "attempts": a, "first": first, "last": at})
        state = 0
        for n, p in enumerate(sorted((p for p, x in enumerate(done) if x["status"] == "delivered"), key=lambda p: (done[p]["last"], p)), 1):
            state += n * turns[p][2]
            done[p] |= {"no": n, "state": state}
        out += [(conv, turns[p][3], x["status"], x["attempts"], x["first"], x["last"], x.get("no"), x.get("state")) for p, x in enumerate(done)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def talks(seed=5):
    rng = random.Random(seed)
    rows = [(c, t, "user", rng.choice([None, "", "x", "é" * 5, f"text {c} {t}"]), 0, 0) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(1000, 3 * t, "user", f"hot {t}", 0, 0) for t in range(500)]  # a long one
    rows += [(None, t, None, "n", 0, 0) for t in (None, None, 1, 2, 2, 3)] + [(2000, 1, "a", "same", 0, 0)] * 5 + [(-7, t, "a", "long " * 20_000, 0, 0) for t in range(3)]
    rng.shuffle(rows)
    return rows


def test_release_brute_force(spark):
    rows = talks()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    want = expected(rows)
    assert {x[2] for x in want} == {"delivered", "dead", "blocked"}
    assert got(release.released(df)) == want
    assert got(release.replay(release.facts(df), size=90)) == want  # trees reach over the starts of ranges
    assert got(release.replay(release.facts(df), size=25)) == want  # and over whole ranges


def test_release_empty(spark):
    df = spark.createDataFrame([], TURNS)
    assert got(release.released(df)) == []


def test_release_wraps(spark):
    x = spark.createDataFrame([(d,) for d in ("9223372036854775807", "9223372036854775808", "18446744073709551616", "27670116110564327423")], "x string").selectExpr("cast(x as decimal(38,0)) x")
    assert [r[0] for r in x.select(release._wrapped(x.x)).collect()] == [2**63 - 1, -(2**63), 0, 2**63 - 1]


def test_tour_intervals():
    rng = random.Random(2)
    parent = np.array([-1] + [rng.randint(-1, i - 1) for i in range(1, 300)])
    enter, leave, depth = release.tour(parent)

    def chain(v):
        while v >= 0:
            yield v
            v = parent[v]

    up = [set(chain(v)) for v in range(300)]
    for v in range(300):
        assert depth[v] == len(up[v]) - 1
        assert {u for u in range(300) if enter[v] <= enter[u] < leave[v]} == {u for u in range(300) if v in up[u]}
