"""Places of pairs among all of their question's, found in ranges.

Pairs move as blocks, the rows of a question and a range in one compressed Arrow batch,
and a task sorts the rows of a range in arrays.  Ranges have some ROWS rows, however many
a question has: they are cut at rows of a sample, by the whole order, so equal scores
are in several ranges too.  Cuts decide which task does the work, never a place.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..scratch import stored
from ..session import ship

#: Rows of a range; of these, so many are in the sample that cuts it.
ROWS, SAMPLED = 1 << 19, 32
#: Pairs of all questions that a task makes blocks of at a time.
HELD = 1 << 20

#: What tells chunks apart, and their order wherever scores tie.
ORDER = ("document_id", "chunk_index")

Keys = tuple[np.ndarray, np.ndarray, np.ndarray]


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(blocks: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for x in blocks.chunks for b in x]).combine_chunks()


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return pc.fill_null(rows.column(name).cast(pa.int64()), -(1 << 63)).to_numpy()


def keys(rows: pa.Table, falling: str | None) -> Keys:
    """Arrays by which rows lie in order of ``falling``, if any, the largest first, null last, and ORDER where it ties."""
    if falling is None:
        return np.zeros(rows.num_rows), _numbers(rows, ORDER[0]), _numbers(rows, ORDER[1])
    x = rows.column(falling)
    value = -x.to_numpy().astype(float)
    value[np.isnan(value)] = -np.inf  # Spark takes NaN as the largest
    if x.null_count:
        value[pc.is_null(x).to_numpy()] = np.inf
    return value, _numbers(rows, ORDER[0]), _numbers(rows, ORDER[1])


def _sorted(k: Sequence[np.ndarray]) -> np.ndarray:
    return np.lexsort(tuple(reversed(k)))


def located(k: Keys, cuts: Sequence[tuple]) -> np.ndarray:
    """How many cuts each row lies behind."""
    out = np.zeros(len(k[0]), np.int64)
    for a, b, c in cuts:
        out += (k[0] > a) | (k[0] == a) & ((k[1] > b) | (k[1] == b) & (k[2] > c))
    return out


def runs(new: np.ndarray) -> np.ndarray:
    """Numbers, from 0, in runs that begin where ``new``."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0)) if len(new) else at


def _parts(rows: pa.Table, code: np.ndarray) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each code, in their order."""
    if not len(code):
        return
    if (code == code[0]).all():
        yield int(code[0]), rows
        return
    order = np.argsort(code, kind="stable")
    rows, code = rows.take(pa.array(order)), code[order]
    begin = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
    for a, b in zip(begin, np.append(begin[1:], len(code)), strict=True):
        yield int(code[a]), rows.slice(a, b - a)


@dataclass(frozen=True)
class Blocks:
    """Rows of questions in packed blocks: ``frame`` has query_id, n (rows of a block) and rows; ``ddl`` has the columns of the rows in there."""

    frame: DataFrame
    ddl: str

    @property
    def id(self) -> str:
        return f"query_id {self.frame.schema['query_id'].dataType.simpleString()}"

    @property
    def kind(self) -> pa.DataType:
        return to_arrow_type(self.frame.schema["query_id"].dataType)

    @property
    def schema(self) -> str:
        return f"{self.id}, n long, rows binary"

    def stored(self, name: str) -> Blocks:
        return Blocks(stored(self.frame, name), self.ddl)

    def where(self, kept: Callable) -> Blocks:
        """The rows for which ``kept``, given a table, is true."""
        kind = self.kind

        def run(batches):
            for q, rows in opened(batches):
                rows = rows.filter(pa.array(kept(rows)))
                if rows.num_rows:
                    yield block(q, kind, rows)

        return Blocks(self.frame.mapInArrow(run, self.schema), self.ddl)


def block(q: object, kind: pa.DataType, rows: pa.Table) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([q], kind), pa.array([rows.num_rows], pa.int64()), pa.array([pack(rows)], pa.binary())], ["query_id", "n", "rows"])


def blocked(rows: DataFrame) -> Blocks:
    """Rows with a query_id as blocks."""
    ship(rows.sparkSession)
    out = Blocks(rows.select("query_id", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("rows")), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "query_id"))
    kind = out.kind

    def run(batches):
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if held and (batch is None or n >= HELD):
                all_ = pa.Table.from_batches(held).combine_chunks()
                ids = pc.dictionary_encode(all_.column("query_id"), null_encoding="encode").combine_chunks()
                names = ids.dictionary.to_pylist()
                for k, x in _parts(all_.drop_columns(["query_id"]), ids.indices.to_numpy()):
                    yield block(names[k], kind, x)
                held, n = [], 0

    return Blocks(rows.mapInArrow(run, out.schema), out.ddl)


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table]]:
    """Each block's question and rows."""
    for batch in batches:
        for k, q in enumerate(batch.column("query_id").to_pylist()):
            yield q, unpack(pa.chunked_array([batch.column("rows").slice(k, 1)]))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table]]:
    """Each question's rows of some HELD pairs at a time."""
    held, n = {}, 0
    for q, rows in opened(batches):
        held.setdefault(q, []).append(rows)
        n += rows.num_rows
        if n >= HELD:
            yield from ((k, pa.concat_tables(x).combine_chunks()) for k, x in held.items())
            held, n = {}, 0
    yield from ((k, pa.concat_tables(x).combine_chunks()) for k, x in held.items())


def _sampled(share: float, kind: pa.DataType, falling: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for q, rows in opened(batches):
            k = keys(rows.filter(pa.array(rng.random(rows.num_rows) < share)), falling)
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(k[0]), kind), *map(pa.array, k)], ["query_id", "value", "document", "index"])

    return run


class Cuts:
    """Where ranges of each question's rows by ``falling``, and blocks of documents, begin."""

    def __init__(self, rows: Blocks, falling: str | None):
        self.falling, self.of, self.documents = falling, {}, np.zeros(0, np.int64)
        n = rows.frame.agg(F.max("n"), F.sum("n")).first()[1] or 0
        if n <= ROWS:
            return
        share = min(1.0, SAMPLED / ROWS)
        sample, most = rows.frame.mapInArrow(_sampled(share, rows.kind, falling), f"{rows.id}, value double, document long, index long").collect(), 0
        mine: dict[object, list[tuple]] = {}
        for r in sample:
            mine.setdefault(r[0], []).append(tuple(r)[1:])
        for q, k in mine.items():
            k, many = sorted(k), int(len(k) / share) // ROWS
            self.of[q], most = sorted({k[i * len(k) // (many + 1)] for i in range(1, many + 1)}), max(most, many)
        d = sorted(r[2] for r in sample)
        self.documents = np.unique(np.array([d[i * len(d) // (most + 1)] for i in range(1, most + 1)], np.int64))

    def ranges(self, q: object, rows: pa.Table) -> np.ndarray:
        cuts = self.of.get(q, ())
        return located(keys(rows, self.falling), cuts) if cuts else np.zeros(rows.num_rows, np.int64)

    def blocks(self, rows: pa.Table) -> np.ndarray:
        return np.searchsorted(self.documents, _numbers(rows, ORDER[0]), "right")


def _counted(cuts, kind: pa.DataType, lexical: bool):
    """Rows of each question and range (``points`` null), and of each block of documents with equal lexical points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cuts.value
        for q, rows in _together(batches):
            n = np.bincount(c.ranges(q, rows))
            at, points = np.flatnonzero(n), [None] * np.count_nonzero(n)
            n = n[at]
            if lexical:
                values, code = np.unique(rows.column("lexical").to_numpy(), return_inverse=True)
                many = len(c.documents) + 1
                met, times = np.unique(code.reshape(-1) * many + c.blocks(rows), return_counts=True)
                at, n, points = np.r_[at, met % many], np.r_[n, times], [*points, *values[met // many].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(at), kind), pa.array(at, pa.int32()), pa.array(points, pa.float64()), pa.array(n, pa.int64())], ["query_id", "part", "points", "n"])

    return run


def _dealt(cuts, kind: pa.DataType):
    """Blocks of each question's ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, rows in _together(batches):
            found = [(p, pack(x)) for p, x in _parts(rows, cuts.value.ranges(q, rows))]
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(found), kind), pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["query_id", "part", "rows"])

    return run


def _placed(falling: str | None, name: str, before, out: Callable):
    """The rows of a range with their place among all of their question's."""

    def run(key, blocks):
        rows = unpack(blocks.column("rows"))
        place = np.empty(rows.num_rows, np.int32)
        place[_sorted(keys(rows, falling))] = np.arange(1, rows.num_rows + 1) + before.value[key[0].as_py(), key[1].as_py()]
        return out(key[0], rows.append_column(name, pa.array(place)))

    return run


def _flat(q: pa.Scalar, rows: pa.Table) -> pa.Table:
    return rows.add_column(0, "query_id", pa.repeat(q, rows.num_rows))


class _Ranged:
    """Blocks, written already, that were counted by ranges of ``falling``; ``points``: how many rows come before those of a block of documents with equal lexical points."""

    def __init__(self, rows: Blocks, falling: str | None, lexical: bool = False):
        spark = rows.frame.sparkSession
        ship(spark)
        self.rows, self.falling = rows, falling
        self.cuts = spark.sparkContext.broadcast(Cuts(rows, falling))
        counts = rows.frame.mapInArrow(_counted(self.cuts, rows.kind, lexical), f"{rows.id}, part int, points double, n long")
        counts = stored(counts.groupBy("query_id", "part", "points").agg(F.sum("n").alias("n")), "ranges")
        before, self.total = {}, {}
        for r in sorted(counts.where("points is null").collect(), key=lambda r: r["part"]):
            before[r["query_id"], r["part"]] = self.total.get(r["query_id"], 0)
            self.total[r["query_id"]] = self.total.get(r["query_id"], 0) + r["n"]
        self.before = spark.sparkContext.broadcast(before)
        up = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("points"), "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        self.points = counts.where("points is not null").select("query_id", "part", "points", up.alias("before"))

    def placed(self, name: str, out: Callable, schema: str) -> DataFrame:
        blocks = self.rows.frame.mapInArrow(_dealt(self.cuts, self.rows.kind), f"{self.rows.id}, part int, rows binary")
        return blocks.groupBy("query_id", "part").applyInArrow(_placed(self.falling, name, self.before, out), schema)


def numbered(rows: Blocks, falling: str | None, name: str) -> tuple[DataFrame, dict[object, int]]:
    """``rows`` (written already, as they are read more than once) with their place ``name``, from 1, among all of their question's; and how many each question has."""
    ranged = _Ranged(rows, falling)
    return ranged.placed(name, _flat, f"{rows.id}, {rows.ddl}, `{name}` int"), ranged.total


RANKED = "dense_rank int, lexical_rank int, fused double, nth int"


def both_ranks(rows: Blocks, fused: Callable, of: Sequence[str], packed: bool = False, keep: Sequence[str] | None = None) -> DataFrame | Blocks:
    """``rows`` (written already) with dense_rank, lexical_rank, fused (made by ``fused`` of a table with columns ``of``) and nth, the place by it in a document.

    With ``keep``, only ORDER and these columns go on.

    Rows move twice: to the ranges of their scores, and from there to the blocks of their
    documents, which know how many rows before them have at least as many lexical points.
    """
    ranged = _Ranged(rows, "score", lexical=True)
    cuts, kind = ranged.cuts, rows.kind
    made = StructType.fromDDL(f"{rows.ddl}, {RANKED}")
    names = [f.name for f in made if keep is None or f.name in (*ORDER, *keep)]
    ddl = ", ".join(f"`{n}` {made[n].dataType.simpleString()}" for n in names)

    def out(q, x):
        x = x.select([n for n in x.column_names if n in (*names, *of)])
        found = [(b, pack(y)) for b, y in _parts(x, cuts.value.blocks(x))]
        return pa.table({"query_id": pa.repeat(q, len(found)), "part": pa.array([b for b, _ in found], pa.int32()), "rows": pa.array([y for _, y in found], pa.binary())})

    def finish(key, blocks, before):
        x = unpack(blocks.column("rows"))
        order = _sorted(keys(x, "lexical"))
        points = x.column("lexical").to_numpy()[order]
        values, upto = before.column("points").to_numpy(), before.column("before").to_numpy()
        by = np.argsort(values)
        rank = np.empty(x.num_rows, np.int32)
        rank[order] = upto[by][np.searchsorted(values[by], points)] + runs(np.diff(points, prepend=np.nan) != 0) + 1
        x = x.append_column("lexical_rank", pa.array(rank))
        x = x.append_column("fused", pa.array(fused(x)))
        value, document, index = keys(x, "fused")
        order = _sorted((document, value, index))
        nth = np.empty(x.num_rows, np.int32)
        nth[order] = runs(np.diff(document[order], prepend=document[order[0]] - 1) != 0) + 1
        x = x.append_column("nth", pa.array(nth)).select(names)
        return pa.Table.from_batches([block(key[0].as_py(), kind, x)]) if packed else _flat(key[0], x)

    blocks = ranged.placed("dense_rank", out, f"{rows.id}, part int, rows binary").groupBy("query_id", "part")
    done = blocks.cogroup(ranged.points.groupBy("query_id", "part")).applyInArrow(finish, rows.schema if packed else f"{rows.id}, {ddl}")
    return Blocks(done, ddl) if packed else done
