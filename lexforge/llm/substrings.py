"""Operator 8: removal of repeated passages, by compaction of a de Bruijn graph of words.

Each ``k`` consecutive words of a document are an edge, from the node of their first
``k`` - 1 words to that of their last.  Documents lie in slices, whose numbers are the
source coordinates of all that follows:

1. anchors: of each edge, the least hash of its shorter runs of words.  Edges whose
   anchor stands at one place alone can't repeat and leave the graph.
2. nodes: a node branches when its occurrences differ in the word before or after it,
   or when one lacks such an edge; counted over all slices.
3. paths: consecutive edges whose common node doesn't branch compact into one path.
   All occurrences of an edge then lie in the same path, so a path is told by a digest of
   its very words, read at its coordinates: this verifies the whole span at once.
4. a join of all paths finds the earliest occurrence of each; the others' words go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import words as K
from .common import bucketed, partitions, release, ship, stored

#: Words of an edge.
EDGE = 20
#: Text of a slice; of the slices of a bucket; text whose anchors or nodes meet in one task.
SLICE, BUCKET, SHARD = 4 << 20, 32 << 20, 64 << 20

_SLICES = "src long, ids binary, sizes binary, texts binary"
_SENT = "k long, src long, keys binary, notes binary"
_REPLY = "src long, kind int, keys binary"
_PATHS = "digest binary, src long, least long, first binary, rest binary"
_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: What a null id sorts as: before all others.
_NULL = -(1 << 63)
#: The note of a node that branches inside one slice already.
_BRANCH = np.uint64(0)
ANCHORS, BRANCHES = 0, 1


def _pack(x: np.ndarray) -> bytes:
    """Integers as byte planes (first all low bytes ...), which compress well if small."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unpack(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0)) if len(x) else x


def pack_keys(x: np.ndarray) -> bytes:
    """Ascending hashes as their steps."""
    return _pack(_steps(x))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ascending hashes to ascending shards."""
    return (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)


# -- slices ----------------------------------------------------------------------------


def _slicer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in K.slices(batch, "text", SLICE):
            raw, off = K.text_bytes(rows.column("text"))
            ids = rows.column("doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False).astype("<i8")
            row = [[part << 32 | nth], [ids.tobytes()], [np.diff(off).astype("<i8").tobytes()], [raw.tobytes()]]
            nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], ["src", "ids", "sizes", "texts"])


def _texts(one: pd.DataFrame) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of a slice."""
    r = one.iloc[0]
    ids, sizes = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["sizes"], "<i8")
    off = np.concatenate([[0], np.cumsum(sizes)])
    return ids, pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(r["texts"])])


# -- the graph -------------------------------------------------------------------------


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` of each ``size`` consecutive numbers."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def _short(k: int) -> int:
    """Words of an anchor."""
    return max(1, k // 2)


def _edges(w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hashes by where they start, each edge's own anchor, whether the edge lies in one document)."""
    g = K.windows(w.hash, _short(k))
    n = len(w.hash) - k + 1
    if n < 1:
        return g, np.zeros(0, np.uint64), np.zeros(0, bool)
    doc = w.doc
    return g, _sliding(g, k - _short(k) + 1, np.minimum), doc[:n] == doc[k - 1 :]


def anchors(w: K.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, twice): the anchors of all edges, ascending, and which stand at two places here."""
    g, least, inside = _edges(w, k)
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    room = np.zeros(k - _short(k), np.uint64)
    chosen = _sliding(np.concatenate([room, np.where(inside, least, 0), room]), k - _short(k) + 1, np.maximum) == g
    key, n = np.unique(K.mix(g[chosen]), return_counts=True)  # least hashes are small; mixed ones spread
    return key, n > 1


def _candidates(w: K.Words, k: int, repeated: np.ndarray) -> np.ndarray:
    """The edges whose anchor stands at two places or more."""
    _, least, inside = _edges(w, k)
    return inside & _among(K.mix(least), repeated)


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _node_hashes(w: K.Words, k: int) -> np.ndarray:
    return K.windows(w.hash, k - 1)


def nodes(w: K.Words, k: int, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, note): the nodes of the given edges, ascending; the note tells the words before and after.

    A node whose occurrences here have different notes gets _BRANCH.
    """
    if not edge.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out = np.concatenate([edge, [False]])  # node p begins edge p and ends edge p - 1
    into = np.concatenate([[False], edge])
    at = np.flatnonzero(out | into)
    node = _node_hashes(w, k)[at]
    before = np.where(into[at], w.hash[np.maximum(at - 1, 0)], np.uint64(1))
    after = np.where(out[at], w.hash[np.minimum(at + k - 1, len(w.hash) - 1)], np.uint64(1))
    note = K.mix(K.mix(before + np.uint64(K._SEED)) * np.uint64(K._STEP) + after) | np.uint64(1)
    order = np.argsort(node, kind="stable")
    node, note = node[order], note[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    low, high = np.minimum.reduceat(note, first), np.maximum.reduceat(note, first)
    return node[first], np.where(low == high, low, _BRANCH)


def _send(src: int, key: np.ndarray, note: np.ndarray, shards: int) -> list[tuple]:
    cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    return [(int(s), src, pack_keys(key[cut[s] : cut[s + 1]]), np.ascontiguousarray(note[cut[s] : cut[s + 1]]).tobytes()) for s in np.flatnonzero(np.diff(cut))]


def _anchor_maker(k: int, shards: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1).to_pandas()
                _, texts = _texts(one)
                out = _send(int(one["src"].iloc[0]), *anchors(K.split(texts), k), shards)
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64() if j < 2 else pa.binary()) for j in range(4)], ["k", "src", "keys", "notes"])

    return make


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard of anchors: those at two places, to each slice that has them."""
    each = [unpack_keys(x) for x in pdf["keys"]]
    twice = np.concatenate([np.frombuffer(x, bool) for x in pdf["notes"]])
    key, back, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    many = n > 1
    many[back[twice]] = True
    return _replies(pdf, each, key[many], ANCHORS)


def _branching(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one shard of nodes: those whose notes differ, to each slice that has them."""
    each = [unpack_keys(x) for x in pdf["keys"]]
    node, note = np.concatenate(each), np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["notes"]])
    order = np.argsort(node, kind="stable")
    node, note = node[order], note[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    low, high = np.minimum.reduceat(note, first), np.maximum.reduceat(note, first)
    return _replies(pdf, each, node[first][(low != high) | (low == _BRANCH)], BRANCHES)


def _replies(pdf: pd.DataFrame, each: list[np.ndarray], wanted: np.ndarray, kind: int) -> pd.DataFrame:
    own = [k[_among(k, wanted)] for k in each]
    out = pd.DataFrame({"src": pdf["src"], "kind": kind, "keys": [pack_keys(k) for k in own]})
    return out[[len(k) > 0 for k in own]]


def _told(replies: pd.DataFrame, kind: int) -> np.ndarray:
    """All keys of a kind that shards tell a slice, ascending."""
    own = [unpack_keys(x) for x in replies["keys"][replies["kind"] == kind]]
    return np.sort(np.concatenate(own)) if own else np.zeros(0, np.uint64)


def _node_maker(k: int, shards: int):
    def make(one: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["k", "src", "keys", "notes"]
        if not len(replies):
            return pd.DataFrame(columns=columns)
        _, texts = _texts(one)
        w = K.split(texts)
        out = _send(int(one["src"].iloc[0]), *nodes(w, k, _candidates(w, k, _told(replies, ANCHORS))), shards)
        return pd.DataFrame(out, columns=columns)

    return make


def paths(w: K.Words, k: int, edge: np.ndarray, branches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, edges): where each path begins among the words, and how many edges it has."""
    at = np.flatnonzero(edge)
    if not len(at):
        return at, at
    joined = np.zeros(len(at), bool)  # to the edge before
    joined[1:] = at[1:] == at[:-1] + 1
    joined &= ~_among(_node_hashes(w, k)[at], branches)
    begins = np.flatnonzero(~joined)
    return at[begins], np.diff(np.concatenate([begins, [len(at)]]))


def _path_maker(k: int):
    def make(one: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        columns = ["digest", "src", "least", "first", "rest"]
        if not len(replies):
            return pd.DataFrame(columns=columns)
        ids, texts = _texts(one)
        w = K.split(texts)
        place, n = paths(w, k, _candidates(w, k, _told(replies, ANCHORS)), _told(replies, BRANCHES))
        if not len(place):
            return pd.DataFrame(columns=columns)
        every, _ = _joined(w, np.ones(len(w.start), bool), w.first)
        upto = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
        text = memoryview(every)
        digests = [hashlib.blake2b(text[a : b - 1], digest_size=16).digest() for a, b in zip(upto[place].tolist(), upto[place + n + k - 1].tolist(), strict=True)]
        number: dict[bytes, int] = {}
        kind = np.fromiter((number.setdefault(d, len(number)) for d in digests), np.int64, len(digests))
        row = w.doc[place]
        spans = np.stack([row, place - w.first[row], n + k - 1], 1).astype("<u4")
        order = np.lexsort((place, row, ids[row], kind))
        kind, row, spans = kind[order], row[order], spans[order]
        new = np.concatenate([[True], kind[1:] != kind[:-1]])
        least = ids[row[new]]  # ids ascend in each kind
        once = new.copy()  # the first place in its row
        once[1:] |= row[1:] != row[:-1]
        early = once & (ids[row] == least[np.cumsum(new) - 1])
        cut = np.concatenate([np.flatnonzero(new), [len(kind)]])
        names = list(number)
        src = int(one["src"].iloc[0])
        out = []
        for d, low, a, b in zip(kind[new].tolist(), least.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            e = early[a:b]
            out.append((names[d], src, low, spans[a:b][e].tobytes(), spans[a:b][~e].tobytes()))
        return pd.DataFrame(out, columns=columns)

    return make


# -- removal ---------------------------------------------------------------------------


def _remover(texts: bool):
    def remove(one: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        ids, column = _texts(one)
        w = K.split(column)
        step = np.zeros(len(w.start) + 1, np.int64)
        if len(spans):
            row, start, n = np.frombuffer(b"".join(spans["spans"]), "<u4").reshape(-1, 3).astype(np.int64).T
            at = w.first[row] + start
            np.add.at(step, at, 1)
            np.add.at(step, at + n, -1)
        keep = np.cumsum(step[:-1]) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[w.first]
        out, upto = _joined(w, keep, kept)
        each = (out[a : max(a, b - 1)].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True))
        last = [x.decode() for x in each] if texts else [hashlib.sha256(x).hexdigest() for x in each]
        doc_id = pd.array(ids, "Int64")
        doc_id[ids == _NULL] = pd.NA
        return pd.DataFrame({"doc_id": doc_id, "n_words": w.count, "n_removed": w.count - np.diff(kept), "kept" if texts else "kept_sha256": last})

    return remove


def _joined(w: K.Words, keep: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words, each with a blank after it; offsets of the documents."""
    start, size = w.start[keep], (w.end - w.start)[keep] + 1
    total = np.concatenate([[0], np.cumsum(size)])
    if not len(start):
        return np.zeros(0, np.uint8), total[kept]
    source = np.arange(total[-1]) + np.repeat(start - total[:-1], size)
    source[total[1:] - 1] = 0
    out = w.data[source]
    out[total[1:] - 1] = 0x20
    return out, total[kept]


def deduplicate(docs: DataFrame, k: int = EDGE, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (or, with ``texts``, kept) per row.

    Words are runs of anything but ASCII white space.  Each word inside ``k``
    consecutive words that also start earlier goes: earlier is a smaller doc_id, or a
    smaller start in the same row.  What is earlier is judged on the input.

    Documents are written once, as slices in buckets; what slices tell each other goes
    by hash to as many tasks as there is text, each kind of anchor, node or path once
    per slice, so that a passage which a third of all documents share is no heavier than
    the number of slices.  Hashes only leave edges out of the graph that stand at one
    place, or cut paths; words go where the words of two paths have one digest.

    Null and empty texts: no words, the hash of an empty string.  Null doc_ids are
    earlier than all others but not than each other; rows that repeat an id are not
    earlier than each other either, so repeated rows keep their words unless a smaller
    id has them.  An empty table gives none.
    """
    if k < 2:
        raise ValueError("an edge has two words at least")
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = (max(partitions(spark), -(-size // most)) for most in (SHARD, BUCKET))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_slicer, _SLICES)
    slices = bucketed(rows, "substring-slices", "src", buckets)
    by_src = slices.groupBy("src")
    sent = slices.mapInArrow(_anchor_maker(k, shards), _SENT)
    shared = stored(sent.groupBy("k").applyInPandas(_repeated, _REPLY), "substring-anchors")
    sent = by_src.cogroup(shared.groupBy("src")).applyInPandas(_node_maker(k, shards), _SENT)
    branches = sent.groupBy("k").applyInPandas(_branching, _REPLY)
    told = shared.unionByName(branches)
    every = stored(by_src.cogroup(told.groupBy("src")).applyInPandas(_path_maker(k), _PATHS), "substring-paths")
    least = every.groupBy("digest").agg(F.min("least").alias("earliest"))
    later = F.col("least") > F.col("earliest")
    spans = every.join(least, "digest").select("src", F.when(later, F.concat("first", "rest")).otherwise(F.col("rest")).alias("spans")).where(F.octet_length("spans") > 0)
    spans = stored(spans, "substring-spans")
    release(shared, every)
    schema = _DIGEST.replace("kept_sha256", "kept") if texts else _DIGEST
    return by_src.cogroup(spans.groupBy("src")).applyInPandas(_remover(texts), schema)
