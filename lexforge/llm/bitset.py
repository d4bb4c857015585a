"""A filter of fixed size for sets of ids of any size: it never misses, and may let more pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as K
from .common import ship

BITS, CHUNKS = 1 << 26, 64
_CHUNK = "chunk int, blob binary"


def places(ids: np.ndarray) -> np.ndarray:
    return (K.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(BITS - 1)).astype(np.int64)


def has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = places(ids)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


def _set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS // 8, np.uint8)
    for batch in batches:
        at = places(batch.column(0).to_numpy(zero_copy_only=False))
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    for k, x in enumerate(bits.reshape(CHUNKS, -1)):
        if x.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["chunk", "blob"])


def _or(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BITS // 8 // CHUNKS, np.uint8)
    for b in pdf["blob"]:
        total |= np.frombuffer(b, np.uint8)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "blob": [total.tobytes()]})


def gather(ids: DataFrame) -> np.ndarray:
    """The filter of a table with one column of longs, without nulls: BITS / 8 bytes."""
    ship(ids.sparkSession)
    out = np.zeros((CHUNKS, BITS // 8 // CHUNKS), np.uint8)
    for r in ids.mapInArrow(_set, _CHUNK).groupBy("chunk").applyInPandas(_or, _CHUNK).collect():
        out[r["chunk"]] = np.frombuffer(r["blob"], np.uint8)
    return out.reshape(-1)
