"""Operator 2: exact top-k inner products on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import partitions, ship, stored

#: Steps of a unit, rows of an index block, queries that meet a block at a time, results.
STEPS, BLOCK, QUERIES, TOP = 64, 16_384, 256, 20
#: Components below this size are quantised in 64-bit integers, others in unbounded ones.
NARROW = float(1 << 50)
LONGS = -(1 << 63), (1 << 63) - 1

_INDEX = "dim int, block int, n int, low string, bits int, ids binary, known binary, slices binary"
_GROUP = "dim int, part int, ids binary, places binary, x binary"
_HITS = "query_id long, query_place long, vec_id long, score long, own boolean"


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, times): the different rows that take part, components as doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))  # not a number is not below
    rows = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(fine)
    return rows.groupBy("vec_id", "x").agg(F.count("*").alias("times")).withColumn("dim", F.size("x"))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(STEPS * x), exactly: 64-bit integers, or Python's where these may not do."""
    if np.abs(x).max(initial=0) < NARROW:
        return np.floor(x * STEPS).astype(np.int64)
    wide = [int(np.floor(v * STEPS)) if abs(v) < NARROW else int(v) * STEPS for v in x.reshape(-1)]
    return np.array(wide, object).reshape(x.shape)


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """(dim, bits, words): bit s of each component as a bitmap over the rows."""
    n, dim = values.shape
    out = np.zeros((dim, bits, -(-n // 64) * 8), np.uint8)
    for s in range(bits):
        out[:, s, : -(-n // 8)] = np.packbits(((values >> s) & 1).astype(np.uint8), axis=0, bitorder="little").T
    return out.view(np.uint64)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["x"].to_numpy()).astype(np.float64).reshape(len(pdf), -1)


def _builder(top: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", na_position="last")
        times = np.minimum(pdf["times"].to_numpy(np.int64), top + 1)  # no more of a repeated row can be wanted
        known = np.repeat(pdf["vec_id"].notna().to_numpy(), times)
        ids = np.repeat(pdf["vec_id"].fillna(0).to_numpy(np.int64), times)
        q = np.repeat(quantised(_matrix(pdf)), times, axis=0)
        low = int(q.min()) if q.size else 0
        bits = max(1, int((int(q.max()) if q.size else 0) - low).bit_length())
        return pd.DataFrame(
            {
                "dim": [q.shape[1]], "block": [pdf["block"].iloc[0]], "n": [len(q)], "low": [str(low)], "bits": [bits],
                "ids": [ids.tobytes()], "known": [known.tobytes()], "slices": [slices_of(q - low, bits).tobytes()],
            }
        )

    return build


def _group(pdf: pd.DataFrame) -> pd.DataFrame:
    x = _matrix(pdf)
    return pd.DataFrame({"dim": [x.shape[1]], "part": [pdf["part"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "places": [pdf["place"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})


def sum_slices(slices: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Bit slices, lowest first, of sum(|w| * v), with v complemented where w < 0.

    A slice of 2**s taken 2**t times has weight 2**(s + t); all slices of a weight are
    added three at a time (sum and carry) until one is left, the carries going up.
    """
    size, bits = np.abs(weights), slices.shape[1]
    flip = np.where((weights < 0).astype(bool), np.uint64((1 << 64) - 1), np.uint64(0))
    column: dict[int, list[np.ndarray]] = {}
    for t in range(int(max(size, default=0)).bit_length()):
        own = np.flatnonzero((size >> t & 1).astype(bool))
        if len(own):
            planes = slices[own] ^ flip[own, None, None]
            for s in range(bits):
                column.setdefault(s + t, []).append(planes[:, s])
    out, weight = [], 0
    while column:
        rows = column.pop(weight, None)
        if rows is None:
            out.append(np.zeros(slices.shape[2], np.uint64))
            weight += 1
            continue
        x = np.concatenate(rows) if len(rows) > 1 else rows[0]
        up = column.setdefault(weight + 1, [])
        while len(x) > 1:
            k = len(x) // 3
            if k:
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                both = a ^ b
                up.append((a & b) | (both & c))
                x = np.concatenate([both ^ c, x[3 * k :]])
            else:
                up.append((x[0] & x[1])[None])
                x = (x[0] ^ x[1])[None]
        if not up:
            del column[weight + 1]
        out.append(x[0])
        weight += 1
    return out


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(total: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """The k rows of ``among`` with the largest sums, ties to smaller rows.

    From the most significant slice downward: rows that are surely in, and rows that
    tie so far.  Rows that tie to the end are the boundary; the first of them fill up.
    """
    sure, tied = np.zeros_like(among), among
    for s in reversed(total):
        both = sure | (tied & s)
        n = int(np.bitwise_count(both).sum())
        if n > k:
            tied = tied & s
        else:
            sure, tied = both, tied & ~s
            if n == k:
                return _positions(sure)
    rows = _positions(sure)
    return np.concatenate([rows, _positions(tied)[: k - len(rows)]])


def _scores(total: list[np.ndarray], rows: np.ndarray, base: int) -> np.ndarray:
    """The sums of some rows: exact, and those beyond a long at its end."""
    wide = len(total) > 61 or abs(base) >= 1 << 61
    score = np.full(len(rows), base, object if wide else np.int64)
    for b, s in enumerate(total):
        bit = (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        score += (bit.astype(object) if wide else bit) << b
    return np.array([min(max(x, LONGS[0]), LONGS[1]) for x in score], np.int64) if wide else score


def _search(top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim, n, bits, low = r["dim"], r["n"], r["bits"], int(r["low"])
                ids, known = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["known"], bool)
                words = -(-n // 64)
                slices = np.frombuffer(r["slices"], np.uint64).reshape(dim, bits, words)
                queries, places = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["places"], np.int64)
                x = np.frombuffer(r["x"], np.float64).reshape(len(queries), dim)
                every = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
                found = []
                for q, place, v in zip(queries, places, x, strict=True):
                    w = quantised(v)
                    total = sum_slices(slices, w)
                    rows = top_rows(total, every, top + 1)  # the query's own row may be among them
                    each = [int(c) for c in w]
                    base = low * sum(each) + ((1 << bits) - 1) * sum(c for c in each if c < 0)
                    score = _scores(total, rows, base)
                    norm = min(sum(c * c for c in each), LONGS[1])
                    found.append((np.full(len(rows), q), np.full(len(rows), place), ids[rows], known[rows], score, known[rows] & (ids[rows] == q) & (score == norm)))
                if found:
                    query, place, vec, is_known, score, own = (np.concatenate(c) for c in zip(*found, strict=True))
                    columns = [pa.array(query), pa.array(place), pa.array(vec, mask=~is_known), pa.array(score.astype(np.int64)), pa.array(own)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_place", "vec_id", "score", "own"])

    return search


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` highest integer inner products of each query with all other rows.

    ``vectors`` and ``queries`` have vec_id and embedding.  Returns query_id, rank
    (from 1), vec_id and score; ties go to the smaller vec_id, null last; a query with
    fewer candidates returns all.  The index is a stored table of blocks of rows, as
    many as there are rows for; each block meets the queries QUERIES at a time, so a
    task holds a block and a group, and ``top`` + 1 rows per query and block go on: of
    them, one that is the query's own row is left out at the end.

    Vectors that are null, or hold null or non-finite components, take no part; nor do
    null ids as queries.  Rows that repeat a vec_id are candidates of their own, also of
    each other; rows that repeat both id and vector are one query.  Vectors of different
    length have no inner product.  Sums are exact; a score beyond a long is returned as
    the long next to it, and such scores tie.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(_rows(vectors), "vectors")
    blocks = -(-rows.count() // BLOCK) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
    index = stored(dealt.groupBy("dim", "block").applyInPandas(_builder(top), _INDEX), "bit-slices")
    place = F.row_number().over(W.partitionBy("vec_id").orderBy("x")).cast("long")
    asked = stored(_rows(queries.where("vec_id is not null")).drop("times").withColumn("place", place), "queries")
    groups = -(-asked.count() // QUERIES) or 1
    parts = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), F.lit(groups)).cast("int")).groupBy("dim", "part").applyInPandas(_group, _GROUP)
    # every block meets every group: both are repeated to the cells of that grid, which are dealt more finely than there are cells
    grid = ["dim", "block", "part"]
    tasks = min(2 * blocks * groups, max(8 * partitions(spark), blocks * groups // 16))
    cells = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(tasks, *grid)
    wanted = parts.withColumnRenamed("ids", "query_ids").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *grid)
    met = cells.join(wanted, grid)
    hits = met.select("dim", "n", "low", "bits", "ids", "known", "slices", "query_ids", "places", "x").mapInArrow(_search(top), _HITS)
    query = W.partitionBy("query_id", "query_place")
    hits = hits.withColumn("nth", F.row_number().over(query.orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))).where(F.col("nth") <= top + 1)
    hits = hits.withColumn("own_nth", F.coalesce(F.min(F.when(F.col("own"), F.col("nth"))).over(query), F.lit(top + 2)))
    rank = F.col("nth") - (F.col("nth") > F.col("own_nth")).cast("int")
    return hits.where("nth != own_nth").withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
