"""Running sums in levels against sums of lists."""

import random

from lexforge import scan


def test_scan_before(spark):
    rng = random.Random(4)
    rows = [(k, at, rng.randint(0, 9)) for k in ("a", None, "c") for at in range(200) if rng.random() < 0.5]
    for fan in (1000, 16, 3):
        out = {(r[0], r[1]): r[3] for r in scan.before(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", ["v"], 200, fan).collect()}
        assert out == {(k, at): sum(v for j, b, v in rows if j == k and b < at) for k, at, _ in rows}
