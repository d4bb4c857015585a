"""Operator 11: quarantine of turns and cascading release, by traversal of the forest of turns.

Turns of a conversation arrive one after the other and each may wait for an earlier one,
so that a conversation is a forest.  Ranges of turns are traversed depth first over
arrays of children; a subtree is an interval of the tour, and a difference array over
the tour marks all that lies below dead turns.

A conversation may be of any length.  Ranges are dealt by (conversation, turn), so a long
conversation is many ranges; times are counted from a range's own start and moved
when its place is known, and only trees that reach over the start of a range wait for
the range before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import scan
from .common import partitions, release, ship, stored

#: Seconds between arrivals; attempts before a turn is dead; first wait, doubled each time.
STEP, ATTEMPTS, WAIT = 7, 6, 20
#: Parents are at most so many turns earlier.
REACH = 4
#: Rows of a range.
RANGE = 200_000
#: Turns' worth of seconds whose releases are numbered in one task.
SLICE = 8192

_PENDING, _DELIVERED, _DEAD, _BLOCKED = range(4)
_NAMES = ("", "delivered", "dead", "blocked")
_MADE = "part int, i long, edge boolean, tail boolean, status int, attempts int, first_at long, last_at long, release_no long, state long"


def facts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, span, faulty, repair, fails and weight of each turn, by hashes of its name.

    ``span`` is how many turns earlier the parent is (0: none), ``repair`` the seconds after
    which a faulty turn is mended, bit a - 1 of ``fails`` says that attempt a fails anyhow,
    ``weight`` is the crc32 of the text.
    """

    def h(k: int) -> Column:
        name = F.concat(F.lit(f"{k}:"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit("")))
        return F.crc32(name.cast("binary"))

    fails = sum((F.when(h(a + 2) % 3 == 0, 1 << a - 1).otherwise(0) for a in range(1, ATTEMPTS + 1)), F.lit(0))
    return conversations.select(
        "conv_id", "turn", (h(0) % 5).cast("int").alias("span"), (h(1) % 101 < 50).alias("faulty"), (h(2) % 101).cast("int").alias("repair"),
        fails.cast("int").alias("fails"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("weight"),
    )


def tour(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """When a depth-first traversal enters and leaves each node, and its depth.

    ``parent`` is -1 for roots.  The nodes below v are those entered from enter[v] + 1 to
    leave[v] - 1.
    """
    n = len(parent)
    kids = np.argsort(parent, kind="stable").tolist()  # roots, then the children of node 0, of node 1 ...
    first = np.concatenate([[0], np.cumsum(np.bincount(parent + 1, minlength=n + 1))]).tolist()
    enter, leave, depth = [0] * n, [0] * n, [0] * n
    stack, clock = kids[: first[1]][::-1], 0
    while stack:
        v = stack.pop()
        if v < 0:
            leave[~v] = clock
            continue
        enter[v] = clock
        clock += 1
        own = kids[first[v + 1] : first[v + 2]]
        if own:
            stack.append(~v)
            stack += own
            down = depth[v] + 1
            for c in own:
                depth[c] = down
        else:
            leave[v] = clock
    return np.array(enter, np.int64), np.array(leave, np.int64), np.array(depth, np.int64)


def _below(enter: np.ndarray, leave: np.ndarray, nodes: np.ndarray, itself: bool) -> np.ndarray:
    """Which nodes lie below (or are) one of ``nodes``: intervals of the tour in a difference array."""
    change = np.zeros(len(enter) + 1, np.int64)
    np.add.at(change, enter[nodes] + (not itself), 1)
    np.add.at(change, leave[nodes], -1)
    return np.cumsum(change)[enter] > 0


def outcomes(parent: np.ndarray, arrival: np.ndarray, start: np.ndarray, barred: np.ndarray, waiting: np.ndarray, of: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(status, attempts, first_at, last_at) of a forest of turns.

    ``start`` is when a root may be tried first; ``barred`` roots are blocked, ``waiting``
    ones unknown with all below them.
    """
    n = len(parent)
    enter, leave, depth = tour(parent)
    attempts, first, last, dead = np.ones(n, np.int32), start.copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    order = np.argsort(depth, kind="stable")
    ends = np.cumsum(np.bincount(depth)) if n else []
    begin = 0
    for end in ends:  # a level of all trees at once
        v = order[begin:end]
        if begin:
            first[v] = np.maximum(arrival[v], last[parent[v]])
        at, fixed = first[v], arrival[v] + of["repair"][v]
        tries, done, when = np.full(len(v), ATTEMPTS, np.int32), ~of["faulty"][v], at.copy()
        tries[done] = 1
        for a in range(1, ATTEMPTS + 1):
            t = at + WAIT * ((1 << a - 1) - 1)
            good = ~done & (t >= fixed) & (of["fails"][v] >> a - 1 & 1 == 0)
            tries[good], when[good] = a, t[good]
            done |= good
        when[~done] = at[~done] + WAIT * ((1 << ATTEMPTS - 1) - 1)
        attempts[v], last[v], dead[v] = tries, when, ~done
        begin = end
    status = np.where(dead, _DEAD, _DELIVERED).astype(np.int32)
    status[_below(enter, leave, np.flatnonzero(dead), False) | _below(enter, leave, np.flatnonzero(barred), True)] = _BLOCKED
    status[_below(enter, leave, np.flatnonzero(waiting), True)] = _PENDING
    return status, attempts, first, last


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _runs(column: pa.ChunkedArray) -> np.ndarray:
    """Number of the run of equal values that each row is in."""
    ends = pc.run_end_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, run_end_type=pa.int64())
    ends = ends.chunk(0) if isinstance(ends, pa.ChunkedArray) else ends
    ends = ends.run_ends.to_numpy()
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _given(rows: pa.Table) -> dict[str, np.ndarray]:
    return {k: rows.column(k).to_numpy() for k in ("span", "faulty", "repair", "fails", "weight")}


def _nulls(values: np.ndarray, none: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=none)


def _result(rows: pa.Table, keep: list[str], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _MADE.split(", ")]
    yield from pa.table([*(rows.column(k) for k in keep), *columns], [*keep, *names]).to_batches(max_chunksize=50_000)


def _ranger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of turns in order: all that can be known without other ranges."""
    rows = _whole(batches)
    if rows is None:
        return
    of, n = _given(rows), rows.num_rows
    run = _runs(rows.column("conv_id"))
    place = np.arange(n)
    i = place - np.searchsorted(run, run)
    linked = (of["span"] > 0) & (i >= of["span"])
    parent = np.where(linked, place - of["span"], -1)
    waiting = (of["span"] > 0) & ~linked & (run == 0)  # its parent may lie in an earlier range
    arrival = STEP * i
    status, attempts, first, last = outcomes(parent, arrival, arrival, np.zeros(n, bool), waiting, of)
    edge = (run == 0) | (run == run[-1])
    tail = (run == run[-1]) & (place >= n - REACH)
    # conversations that lie in this range as a whole are released here
    free = np.flatnonzero((status == _DELIVERED) & ~edge)
    free = free[np.lexsort((i[free], last[free], run[free]))]
    number = np.arange(len(free)) - np.searchsorted(run[free], run[free]) + 1
    upto = np.cumsum(number * of["weight"][free])
    upto = upto - np.concatenate([[0], upto])[np.searchsorted(run[free], run[free])]
    release_no, state, none = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    release_no[free], state[free], none[free] = number, upto, False
    idle = (status == _BLOCKED) | (status == _PENDING)
    yield from _result(
        rows, ["conv_id", "turn", "span", "faulty", "repair", "fails", "weight"],
        [
            pa.array(np.full(n, TaskContext.get().partitionId(), np.int32)), pa.array(i), pa.array(edge), pa.array(tail), pa.array(status), pa.array(np.where(idle, 0, attempts), pa.int32()),
            _nulls(first, idle, pa.int64()), _nulls(last, idle, pa.int64()), _nulls(release_no, none, pa.int64()), _nulls(state, none, pa.int64()),
        ],
    )


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that waited for an earlier range, by range and place, with what their parents there came to."""
    rows = _whole(batches)
    if rows is None:
        return
    of, n = _given(rows), rows.num_rows
    p = rows.column("p").to_numpy()
    group = np.cumsum(np.concatenate([[0], (np.diff(_runs(rows.column("conv_id"))) != 0) | (np.diff(rows.column("part").to_numpy()) != 0)]))
    key = group * (int(p.max()) + 1 + REACH) + p  # ascending
    want = key - of["span"]
    at = np.minimum(np.searchsorted(key, want), n - 1)
    inside = (of["span"] > 0) & (p >= of["span"]) & (key[at] == want) & (group[at] == group)
    parent = np.where(inside, at, -1)
    outside = (of["span"] > 0) & (p >= of["span"]) & ~inside
    known = pc.fill_null(rows.column("parent_status"), _PENDING).to_numpy()
    arrival = STEP * p
    start = np.where(outside & (known == _DELIVERED), np.maximum(arrival, pc.fill_null(rows.column("parent_last"), 0).to_numpy()), arrival)
    status, attempts, first, last = outcomes(parent, arrival, start, outside & (known >= _DEAD), outside & (known == _PENDING), of)
    idle = (status == _BLOCKED) | (status == _PENDING)
    out = {"status": pa.array(status), "attempts": pa.array(np.where(idle, 0, attempts), pa.int32()), "first_at": _nulls(first, idle, pa.int64()), "last_at": _nulls(last, idle, pa.int64())}
    yield from pa.table([out[c] if c in out else rows.column(c) for c in _EDGE], _EDGE).to_batches(max_chunksize=50_000)


_EDGE = ["conv_id", "turn", "span", "faulty", "repair", "fails", "weight", "part", "i", "p", "tail", "status", "attempts", "first_at", "last_at"]


def _wrapped(x: Column) -> Column:
    """A decimal as a long, modulo 2**64."""
    half, whole = (F.lit(str(1 << k)).cast("decimal(38,0)") for k in (63, 64))
    return (F.pmod(x + half, whole) - half).cast("long")


def _joined(ranges: DataFrame, parts: int) -> DataFrame:
    """The turns of conversations that may lie in several ranges, at their places among all turns, all outcomes known."""
    spark = ranges.sparkSession
    edges = ranges.where("edge")
    sizes = edges.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    moved = scan.before(sizes, ["conv_id"], "part", ["n"], parts).select(F.col("conv_id").alias("moved_id"), F.col("part").alias("moved_part"), F.col("before_n").alias("moved"))
    edges = edges.join(moved, scan.same(edges, moved, [("conv_id", "moved_id"), ("part", "moved_part")]))
    edges = edges.withColumns({"p": F.col("i") + F.col("moved"), "first_at": F.col("first_at") + STEP * F.col("moved"), "last_at": F.col("last_at") + STEP * F.col("moved")})
    all_of = [stored(edges.select(*_EDGE), "turn-edges")]
    schema = ", ".join(f"{c} {t}" for c, t in all_of[0].dtypes)
    while True:  # a round for each range that a tree crosses as a whole; nearly always one
        waiting = all_of[-1].where(f"status = {_PENDING}")
        if waiting.isEmpty():
            break
        tails = None
        for x in all_of:
            x = x.where(f"tail AND status <> {_PENDING}").select(F.col("conv_id").alias("tail_id"), F.col("p").alias("tail_p"), F.col("status").alias("parent_status"), F.col("last_at").alias("parent_last"))
            tails = x if tails is None else tails.unionByName(x)
        rows = waiting.withColumn("wants", F.col("p") - F.col("span"))
        rows = rows.join(tails, scan.same(rows, tails, [("conv_id", "tail_id"), ("wants", "tail_p")]), "left").drop("tail_id", "tail_p", "wants")
        rows = rows.repartition(partitions(spark), "conv_id", "part").sortWithinPartitions("conv_id", "part", "p")
        all_of.append(stored(rows.mapInArrow(_joiner, schema), "turn-edges"))
    out = None
    for x in all_of:
        x = x.where(f"status <> {_PENDING}")
        out = x if out is None else out.unionByName(x)
    return out


def _numbered(turns: DataFrame) -> DataFrame:
    """release_no and state of the turns of long conversations: slices of time are numbered, then their sums scanned."""
    freed = turns.where(f"status = {_DELIVERED}").withColumn("slice", F.floor(F.col("last_at") / (STEP * SLICE)).cast("long"))
    freed = freed.select("conv_id", "p", "last_at", "slice", F.col("weight").cast("decimal(38,0)").alias("weight"))
    order = W.partitionBy("conv_id", "slice").orderBy("last_at", "p")
    rows = freed.withColumn("nth", F.row_number().over(order).cast("decimal(38,0)"))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("conv_id", "p", "slice", "nth", F.sum("weight").over(upto).alias("y"), F.sum((F.col("nth") * F.col("weight")).cast("decimal(38,0)")).over(upto).alias("x"))
    rows = stored(rows.select("conv_id", "p", "slice", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("nth", "y", "x")]), "turn-numbers")
    sums = rows.groupBy("conv_id", "slice").agg(F.max("nth").alias("n"), F.max("y").alias("y"), F.max("x").alias("x"))
    top = rows.agg(F.max("slice")).first()[0] or 0
    sums = scan.before(sums, ["conv_id"], "slice", ["n"], top)
    sums = sums.select("conv_id", "slice", F.col("before_n").cast("decimal(38,0)").alias("n"), (F.col("x") + F.col("before_n") * F.col("y")).cast("decimal(38,0)").alias("s"))
    sums = scan.before(sums, ["conv_id"], "slice", ["s"], top).select(F.col("conv_id").alias("sum_id"), F.col("slice").alias("sum_slice"), "n", F.col("before_s").cast("decimal(38,0)").alias("s"))
    out = rows.join(sums, scan.same(rows, sums, [("conv_id", "sum_id"), ("slice", "sum_slice")]))
    return out.select(F.col("conv_id").alias("freed_id"), F.col("p").alias("freed_p"), (F.col("n") + F.col("nth")).cast("long").alias("release_no"), _wrapped(F.col("s") + F.col("x") + F.col("n") * F.col("y")).alias("state"))


def replay(turns: DataFrame, size: int = RANGE) -> DataFrame:
    """What becomes of each turn.

    ``turns`` has what :func:`facts` returns.  A conversation's turns, in the order of turn
    (null first) and weight, arrive STEP seconds apart.  A turn is tried at its arrival, or
    at its parent's delivery if that is later; a faulty one fails until it is repaired and
    where ``fails`` says so, waits, each time twice as long, and is dead after ATTEMPTS
    failures.  All below dead turns is blocked.  Delivered turns are numbered by time and
    turn; ``state`` sums number times weight, modulo 2**64 as a long.

    Returns conv_id, turn, status, attempts, first_at, last_at, release_no and state, a row
    for each row.  Rows of null conv_id are one conversation; repeated rows are turns of
    their own; an empty table gives an empty one.  ``size`` is the rows of a range.
    """
    spark = turns.sparkSession
    ship(spark)
    given = stored(turns.withColumn("uid", F.monotonically_increasing_id()), "turns")
    parts = max(partitions(spark), -(-given.count() // size))
    order = ["conv_id", "turn", "weight", "uid"]
    ranged = given.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = ", ".join(f"{c} {t}" for c, t in turns.select("conv_id", "turn", "span", "faulty", "repair", "fails", "weight").dtypes)
    ranges = stored(ranged.mapInArrow(_ranger, f"{kept}, {_MADE}"), "turn-ranges")
    release(given)
    parts = ranges.agg(F.max("part")).first()[0] or 0
    long = stored(_joined(ranges, parts), "turn-outcomes")
    freed = _numbered(long)
    long = long.drop("release_no", "state").join(freed, scan.same(long, freed, [("conv_id", "freed_id"), ("p", "freed_p")]), "left")
    columns = ["conv_id", "turn", F.element_at(F.array(*map(F.lit, _NAMES)), F.col("status") + 1).alias("status"), "attempts", "first_at", "last_at", "release_no", "state"]
    return ranges.where("NOT edge").select(*columns).unionByName(long.select(*columns))


def released(conversations: DataFrame) -> DataFrame:
    """:func:`replay` of the turns of ``conversations`` (conv_id, turn, text), by :func:`facts`."""
    return replay(facts(conversations))
