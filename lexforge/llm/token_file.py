"""Operator 6: token ids in a compact file format, written and read back.

A file set is a folder with two Parquet tables.  ``codebook`` has the code length of
each id.  ``segments`` has, in ascending doc_id order by (part, segment), runs of
whole documents: their ids and token counts, the place of the first token among all
tokens, the Huffman bits of all their tokens, and a bit offset for every BLOCK
tokens, from which a block can be decoded alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import huffman as H, pieces as P, words as K
from .common import partitions, release, scratch_path, ship, stored

#: Id that ends each document; tokens that make a segment full.
END_ID = 1
SEGMENT = 1 << 19
#: Bytes of text that make a range of documents.
RANGE = 64 << 20

_STAGED = "part int, segment int, part_start long, doc_ids array<long>, n_tokens array<long>, ids binary"
_SEGMENT = "part int, segment int, start long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, bits binary"
_DOCS = "doc_id long, start long, n_tokens long, ids binary"
_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"

_caches: dict[str, P.PieceCache] = {}


def _cache(path: str) -> P.PieceCache:
    if path not in _caches:
        _caches[path] = P.PieceCache(P.lower_words(path))
    return _caches[path]


def _stager(path: str, end_id: int, full: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = _cache(path), TaskContext.get().partitionId()
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        start = segment = tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal start, segment, held, tokens
            n, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            doc_ids = pa.concat_arrays([h[0] for h in held])
            whole = pa.array([0, len(n)], pa.int32())
            ids = ids.astype("<u4" if ids.max(initial=0) > 0xFFFF else "<u2")
            columns = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.ListArray.from_arrays(whole, doc_ids), pa.ListArray.from_arrays(whole, pa.array(n)), pa.array([ids.tobytes()], pa.binary())]
            start, segment, tokens, held = start + len(ids), segment + 1, 0, []
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "part_start", "doc_ids", "n_tokens", "ids"])

        for batch in batches:
            for rows in K.slices(batch, "text"):
                data, begin, end, first = P.split_lower(rows.column("text"), path)
                at = cache.places(data, begin, end, K.span_hashes(data, begin, end))
                upto = np.concatenate([[0], np.cumsum(cache.size[at], dtype=np.int64)])[first]
                ids = np.insert(cache.gather(at), upto[1:], end_id)
                held.append((rows.column("doc_id"), np.diff(upto) + 1, ids))
                tokens += len(ids)
                if tokens >= full:
                    yield flush()
        if held:
            yield flush()

    return stage


def _unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, ids in zip(batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            c = np.bincount(_unpack(ids, sum(n)))
            if len(c) > len(total):
                c[: len(total)] += total
                total = c
            else:
                total[: len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])


def _encoder(lengths, starts):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first = H.Code(lengths.value), starts.value
        for batch in batches:
            for r in batch.to_pylist():
                bits, marks = code.encode(_unpack(r["ids"], sum(r["n_tokens"])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"]], pa.int32()), pa.array([r["segment"]], pa.int32()), pa.array([first[r["part"]] + r["part_start"]], pa.int64()),
                        pa.array([r["doc_ids"]], pa.list_(pa.int64())), pa.array([r["n_tokens"]], pa.list_(pa.int64())),
                        pa.array([marks.astype("<i8").tobytes()], pa.binary()), pa.array([bits], pa.binary()),
                    ],
                    ["part", "segment", "start", "doc_ids", "n_tokens", "checkpoints", "bits"],
                )

    return encode


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, full: int = SEGMENT) -> None:
    """Tokenize all texts and write them as a file set to ``path``.

    Texts are dealt in ranges of doc_id, as many as their volume needs, and tokenized
    once; the ids rest in a stored table while their counts over all documents give the
    code.  Only the code
    lengths (one per vocabulary entry at most) and one token total per partition come
    to the driver.

    Null and empty texts hold the end id alone.  Null doc_ids come first; rows that
    repeat an id stand next to each other in an order of their texts, and may be dealt to
    several ranges.  A segment is a value of Spark's, so the ids of one document must
    stay under 2 GB.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("nth", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(partitions(spark), -(-size // RANGE))
    staged = rows.repartitionByRange(ranges, "doc_id", "nth").sortWithinPartitions("doc_id", "nth", "text").drop("nth")
    staged = stored(staged.mapInArrow(_stager(tokenizer, end_id, full), _STAGED), "token-ids")
    counts = staged.select("n_tokens", "ids").mapInArrow(_counter, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    lengths = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        lengths[r["id"]] = r["n"]
    lengths = H.code_lengths(lengths)
    tokens = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    starts, at = {}, 0
    for r in staged.groupBy("part").agg(F.sum(tokens).alias("n")).orderBy("part").collect():
        starts[r["part"]] = at
        at += r["n"]
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")
    send = spark.sparkContext.broadcast
    staged.mapInArrow(_encoder(send(lengths), send(starts)), _SEGMENT).write.parquet(f"{path}/segments")
    release(staged)


def _decoder(lengths, digest: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = H.Code(lengths.value)
        for batch in batches:
            for r in batch.to_pylist():
                n = np.array(r["n_tokens"], np.int64)
                ids = code.decode(r["bits"], np.frombuffer(r["checkpoints"], "<i8"), int(n.sum())).astype("<u4")
                upto = np.concatenate([[0], np.cumsum(n)])
                each = (ids[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True))
                last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(list(each), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(upto[:-1] + r["start"], pa.int64()), pa.array(n, pa.int64()), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return decode


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a file set: doc_id, start, n_tokens and ids (little-endian
    unsigned 32-bit integers), or with ``digest`` the CRC-32 of these bytes."""
    ship(spark)
    book = spark.read.parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r["id"]] = r["length"]
    rows = spark.read.schema(_SEGMENT).parquet(f"{path}/segments").select("start", "doc_ids", "n_tokens", "checkpoints", "bits")
    return rows.mapInArrow(_decoder(spark.sparkContext.broadcast(lengths), digest), _DIGEST if digest else _DOCS)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to the shared folder and return what reading gives."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-file")
    write(docs, tokenizer, path)
    return read(spark, path, digest=True)
