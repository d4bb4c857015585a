"""Operator 7: token counts; huge texts by overlapping chunks that resynchronise."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import pieces as P, words as K
from .common import ship

#: Characters of a chunk, and how far it runs into the next one at first.
CHUNK, OVERLAP = 32_768, 512
#: Texts of more bytes than this are encoded in chunks.
HUGE = 65_536
LIMIT = 512

#: White space in Unicode beyond ASCII, as the tokenizer's ``\\s`` has it.
_WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[\\t-\\r {_WIDE_SPACE}]*[^\\t-\\r {_WIDE_SPACE}]+|[\\t-\\r {_WIDE_SPACE}]+")
_COUNTED = "doc_id long, n_bytes long, n_tokens long"


def _view(tok, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, tokens before each) of text[start:end] encoded alone.

    A boundary is where a pre-token begins: the first token of another word.
    """
    e = tok.encode(text[start:end], add_special_tokens=False)
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    begin = np.array([a for a, _ in e.offsets], np.int64)
    if not len(word):
        return np.array([end]), np.array([0])
    at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return np.concatenate([begin[at] + start, [end]]), np.concatenate([at, [len(word)]])


def count_huge(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text`` as the library would give them for all of it.

    The tokenizer cuts a text into pre-tokens from left to right; a cut depends on
    what follows it and not on what came before, and a special string is never cut
    through.  A chunk that begins at a true cut gives true cuts up to a guard before
    its end (it may misjudge only what its end touches).  The next chunk begins
    anywhere; where one of its cuts is also a proven cut of the chunk before, both
    agree from there on, and the counts are spliced there.  If the overlap holds no
    common cut, it is doubled.
    """
    guard = 2 + max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0)
    n, total, start, true_from, wide = len(text), 0, 0, 0, max(overlap, 2 * guard)
    end = min(n, start + chunk + wide)
    cuts, before = _view(tok, text, start, end)
    while end < n:
        following = start + chunk
        far = min(n, following + chunk + wide)
        cuts2, before2 = _view(tok, text, following, far)
        proven = cuts[(cuts > true_from) & (cuts >= following) & (cuts <= end - guard)]
        common = proven[np.isin(proven, cuts2[:-1])]
        if not len(common):
            wide *= 2
            end = min(n, start + chunk + wide)
            cuts, before = _view(tok, text, start, end)
            continue
        p = common[0]
        total += int(before[np.searchsorted(cuts, p)] - before[np.searchsorted(cuts, true_from)])
        start, end, cuts, before, true_from = following, far, cuts2, before2, p
    return total + int(before[-1] - before[np.searchsorted(cuts, true_from)])


def _counter(path: str, huge: int, chunk: int, overlap: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cache = P.library(path), _cache(path)
        for batch in batches:
            for part in K.slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                raw, off = K.text_bytes(texts)
                size = np.diff(off)
                n = np.zeros(len(size), np.int64)
                wide = pc.match_substring_regex(texts, f"[{_WIDE_SPACE}]").to_numpy(zero_copy_only=False)
                odd = (size > huge) | wide
                # where white space is ASCII's alone, all pieces are found at once
                w = K.split(texts, hashes=False)
                start, end, first = P.tiles(off, w.end)
                doc = np.repeat(np.arange(len(size)), np.diff(first))
                use = ~odd[doc]
                if use.any():
                    start, end, doc = start[use], end[use], doc[use]
                    at = cache.places(raw, start, end, K.span_hashes(raw, start, end))
                    n += np.bincount(doc, cache.size[at], len(size)).astype(np.int64)
                for d in np.flatnonzero(odd):
                    text = texts[int(d)].as_py()
                    if size[d] > huge:
                        n[d] = count_huge(tok, text, chunk, overlap)
                    else:
                        n[d] = sum(len(e) for e in tok.encode_batch_fast(_PIECE.findall(text), add_special_tokens=False))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


_caches: dict[str, P.PieceCache] = {}


def _cache(path: str) -> P.PieceCache:
    if path not in _caches:
        _caches[path] = P.PieceCache(P.plain(path))
    return _caches[path]


def counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, without a shuffle.

    ``tokenizer`` is the path of a byte-level BPE of the tokenizers library whose
    pre-tokens are a blank and a word.  A cut before white space that follows
    something else is always one of its cuts, so texts are counted by such pieces;
    texts of over ``huge`` bytes by overlapping chunks (:func:`count_huge`).

    Null and empty texts have no bytes and no tokens.  Null ids stay null, repeated
    rows give a row each, further columns are ignored, an empty table gives none.
    """
    ship(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(tokenizer, huge, chunk, overlap), _COUNTED)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
