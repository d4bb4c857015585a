"""Scores of a group of questions against a run of chunks, in arrays.

The questions are broadcast; their words and identifiers are one automaton, so a chunk's
text is read once, however many words the questions have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .ranges import block

#: Pairs of a question and a chunk that are scored at a time.
PAIRS = 1 << 19
#: Places of a word and a text that are looked at together.
FOUND = 1 << 22
#: Titles and sources whose words are remembered.
REMEMBERED = 10_000


@dataclass
class Question:
    """What scoring needs of a question; words come with their variants."""

    id: object
    vectors: list[list[float] | None]
    circulars: list[str]
    sections: list[str]
    percentages: list[str]
    words: list[list[str]]
    asks: bool
    legal: bool

    @property
    def size(self) -> int:
        return 8 * sum(len(v or ()) for v in self.vectors) + 100 * (1 + len(self.circulars) + len(self.sections) + len(self.percentages) + sum(map(len, self.words)))


@dataclass
class Scored:
    """Scores of all questions (rows) with some chunks (columns), these in order of document and index."""

    documents: pa.Array
    indexes: pa.Array
    score: np.ndarray
    lexical: np.ndarray
    bonus: np.ndarray
    penalty: np.ndarray
    marked: np.ndarray


def _norm(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape[0])
    for d in range(x.shape[1]):
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dim`` components, and which rows are whole; other rows are zero."""
    out, good = np.zeros((len(column), dim)), np.zeros(len(column), bool)
    if not dim or not len(column):
        return out, good
    size = np.array([-1 if x is None else x for x in pa.compute.list_value_length(column).to_pylist()])
    values = column.flatten()
    good = size == dim
    if not good.any():
        return out, good
    flat = values.to_numpy(zero_copy_only=False).astype(float)
    if values.null_count:  # a null component makes its vector unusable
        bad = values.is_null().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
        good[row[bad]] = False
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))[:-1]])
    out[good] = flat[start[good][:, None] + np.arange(dim)]
    return out, good


class Scorer:
    """Scores a bounded group of questions."""

    def __init__(self, questions: list[Question], agree: float, bonus: float):
        import ahocorasick

        self.questions, self.agree, self.bonus = questions, agree, bonus
        place: dict[str, int] = {}
        number = lambda x: place.setdefault(x, len(place))
        self.asked = [([number(x) for x in q.circulars], [number(x) for x in q.sections], [number(x) for x in q.percentages], [[number(x) for x in w] for w in q.words]) for q in questions]
        self.automaton = ahocorasick.Automaton()
        for x, k in place.items():
            if x:
                self.automaton.add_word(x, k)
        self.automaton.make_automaton()
        self.always = [place[""]] if "" in place else []  # an empty word is in every text
        self.n_words = len(place)
        by_dim: dict[int, list[tuple[int, list[float]]]] = {}
        for k, q in enumerate(questions):
            for v in q.vectors:
                if v is not None and None not in v:
                    by_dim.setdefault(len(v), []).append((k, v))
        self.vectors = {dim: (np.array([k for k, _ in vs]), np.array([v for _, v in vs], float).reshape(len(vs), dim)) for dim, vs in by_dim.items()}
        self.asks, self.legal = np.array([q.asks for q in questions], bool), np.array([q.legal for q in questions], bool)

    def _dense(self, embedding: pa.Array) -> np.ndarray:
        """The best similarity of each question's vectors and a little for each other that agrees; NaN without any.

        Products are summed from the first component on, so doubles come out the same everywhere.
        """
        n, m = len(self.questions), len(embedding)
        best, agree = np.full((n, m), -np.inf), np.zeros((n, m), np.int64)
        for dim, (owner, v) in self.vectors.items():
            x, good = _matrix(embedding, dim)
            columns, norm, other = np.ascontiguousarray(x.T), _norm(v), _norm(x)
            total = np.zeros((len(v), m))
            for d in range(dim):
                total += v[:, d : d + 1] * columns[d]
            cosine = total / (norm[:, None] * other + 1e-10)
            cosine[:, ~good] = -np.inf
            for j, k in enumerate(owner):  # a question has few vectors
                np.maximum(best[k], cosine[j], out=best[k])
                agree[k] += cosine[j] >= self.agree
        out = best + self.bonus * np.maximum(agree - 1, 0)
        out[np.isneginf(best)] = np.nan
        return out

    def _found(self, texts: list[str], remembered: dict | None = None) -> np.ndarray:
        """[word, text]: which texts have which words."""
        out = np.zeros((self.n_words, len(texts)), bool)
        out[self.always] = True
        for j, t in enumerate(texts):
            at = None if remembered is None else remembered.get(t)
            if at is None:
                at = list({k for _, k in self.automaton.iter(t)}) if len(self.automaton) else []
                if remembered is not None:
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                    remembered[t] = at
            out[at, j] = True
        return out

    def _lexical(self, title: list[str], ref: list[str], section: list[str], content: list[str]) -> np.ndarray:
        """Points for identifiers, then for words in their order, each in title, source and content; some texts at a time."""
        some, texts = max(64, FOUND // max(1, self.n_words)), (title, ref, section, content)
        parts = [self._points(*(x[a : a + some] for x in texts)) for a in range(0, len(title), some)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(self.questions), 0))

    def _points(self, title: list[str], ref: list[str], section: list[str], content: list[str]) -> np.ndarray:
        self.remembered = getattr(self, "remembered", {})
        t, r, c = self._found(title, self.remembered), self._found(ref, self.remembered), self._found(content)
        s = self._found(section, self.remembered)
        out = np.zeros((len(self.questions), len(title)))
        for row, (circulars, sections, percentages, words) in zip(out, self.asked, strict=True):
            for k in circulars:
                row += 100.0 * (t[k] | r[k])
            for k in sections:
                row += 50.0 * (t[k] | r[k] | s[k] | c[k])
            for k in percentages:
                row += 20.0 * c[k]
            for w in words:
                for has, points in ((t, 5.0), (r, 3.0), (c, 0.2)):
                    row += points * (has[w[0]] if len(w) == 1 else has[w].any(0))
        return out

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Scored]:
        """Scores of chunks: document_id, chunk_index, embedding, t, r, s, c (lower-cased texts), mark, penalty, authority."""
        most = max(1, PAIRS // max(1, len(self.questions)))
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                rows = pa.Table.from_batches([batch.slice(a, most)]).sort_by([("document_id", "ascending"), ("chunk_index", "ascending")]).combine_chunks()
                col = {n: rows.column(n).combine_chunks() for n in rows.schema.names}
                col = {n: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for n, x in col.items()}
                yield Scored(
                    col["document_id"], col["chunk_index"], self._dense(col["embedding"]), self._lexical(*(col[n].to_pylist() for n in "trsc")),
                    np.where(self.legal[:, None], col["authority"].to_numpy(zero_copy_only=False), 0.0), col["penalty"].to_numpy(zero_copy_only=False), self.asks[:, None] & col["mark"].to_numpy(zero_copy_only=False),
                )


def _ids(scorer: Scorer, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([q.id for q in scorer.questions], kind).take(pa.array(at))


def pairs(scorer, kind: pa.DataType):
    """Every question with every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for x in s.run(batches):
            n, m = x.score.shape
            flat = np.tile(np.arange(m), n)
            yield pa.RecordBatch.from_arrays(
                [
                    _ids(s, np.repeat(np.arange(n), m), kind), x.documents.take(pa.array(flat)), x.indexes.take(pa.array(flat)), pa.array(x.score.reshape(-1), from_pandas=True), pa.array(x.lexical.reshape(-1)),
                    pa.array(x.bonus.reshape(-1)), pa.array(x.penalty[flat]), pa.array(x.marked.reshape(-1)),
                ],
                ["query_id", "document_id", "chunk_index", "score", "lexical", "bonus", "penalty", "marked"],
            )

    return run


def pair_blocks(scorer, kind: pa.DataType):
    """The rows of :func:`pairs` as packed blocks of a question each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for x in s.run(batches):
            for k, q in enumerate(s.questions):
                columns = [x.documents, x.indexes, pa.array(x.score[k], from_pandas=True), *map(pa.array, (x.lexical[k], x.bonus[k], x.penalty, x.marked[k]))]
                yield block(q.id, kind, pa.table(columns, ["document_id", "chunk_index", "score", "lexical", "bonus", "penalty", "marked"]))

    return run


def cut(q: np.ndarray, kind: np.ndarray, value: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` first rows of each (q, kind) by falling value, then place: a mask."""
    order = np.lexsort((place, -value, kind, q))
    new = np.flatnonzero((np.diff(q[order], prepend=-1) != 0) | (np.diff(kind[order], prepend=np.nan) != 0))
    start = np.zeros(len(order), np.int64)
    start[new] = new
    out = np.zeros(len(order), bool)
    out[order] = np.arange(len(order)) - np.maximum.accumulate(start) < most
    return out


def last_of(q: np.ndarray, kind: np.ndarray, value: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """The row at place ``most`` of each (q, kind) that has so many, in the order of :func:`cut`."""
    order = np.lexsort((place, -value, kind, q))
    at = order[most - 1 :]
    first = order[: len(at)]
    full = (q[first] == q[at]) & (kind[first] == kind[at])
    beyond = np.r_[False, full[:-1] & (q[at[1:]] == q[at[:-1]]) & (kind[at[1:]] == kind[at[:-1]])] if len(at) else full
    return at[full & ~beyond]


def _may_pass(held: dict[str, np.ndarray], place: np.ndarray, x: Scored, score: np.ndarray, most: int) -> np.ndarray:
    """Pairs of ``x`` that can be among the ``most`` of their class by either order, given those that are held: a mask."""
    out = np.ones(score.shape, bool)
    offset, kinds = x.bonus - x.penalty[None, :], held["bonus"] - held["penalty"]
    documents, indexes = (c.to_numpy(zero_copy_only=False) for c in (x.documents, x.indexes))
    lasts = []
    for name, mine in (("score", score), ("lexical", x.lexical)):
        at = last_of(held["q"], kinds, held[name], place, most)
        lasts.append((mine, {(int(held["q"][r]), float(kinds[r])): (held[name][r], held["document"][r], held["index"][r]) for r in at}))
    for (k, c), _ in lasts[0][1].items():
        if (k, c) in lasts[1][1]:
            away = offset[k] == c
            for mine, of in lasts:
                value, document, index = of[k, c]
                away = away & ((mine[k] < value) | (mine[k] == value) & ((documents > document) | (documents == document) & (indexes > index)))
            out[k] &= ~away
    return out


def dominated(q: np.ndarray, kind: np.ndarray, document: np.ndarray, score: np.ndarray, lexical: np.ndarray, place: np.ndarray, most: int) -> np.ndarray:
    """Rows that ``most`` others of the same question, kind and document beat in both orders: a document never shows them."""
    out = np.zeros(len(q), bool)
    order = np.lexsort((place, -score, document, kind, q))
    key = [x[order] for x in (q, kind, document)]
    new = np.concatenate([[True], np.any([np.diff(k) != 0 for k in key], axis=0)]) if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    for a, b in zip(begin, np.append(begin[1:], len(order)), strict=True):
        if b - a <= 4 * most:
            continue
        rows = order[a:b]
        nth = np.empty(b - a, np.int64)
        nth[np.lexsort((place[rows], -lexical[rows]))] = np.arange(b - a)  # lexical order, of rows in dense order
        best: list[int] = []  # the least ``most`` places so far, ascending
        for r, x in zip(rows.tolist(), nth.tolist(), strict=True):
            if len(best) == most and x > best[-1]:
                out[r] = True
            else:
                best = sorted([*best, x])[:most]
    return out


def candidates(scorer, kind: pa.DataType, most: int, per_document: int):
    """Chunks that may be among a question's best: of each class of bonus and penalty the first by either order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held = scorer.value, None
        for x in s.run(batches):
            n, m = x.score.shape
            score, at = np.where(np.isnan(x.score), -np.inf, x.score), np.tile(np.arange(m), n)
            now = {
                "q": np.repeat(np.arange(n), m), "score": score.reshape(-1), "lexical": x.lexical.reshape(-1), "bonus": x.bonus.reshape(-1), "penalty": x.penalty[at],
                "document": x.documents.to_numpy(zero_copy_only=False)[at], "index": x.indexes.to_numpy(zero_copy_only=False)[at],
            }
            if held is not None:
                passing = _may_pass(held, place, x, score, most).reshape(-1)
                now = {k: v[passing] for k, v in now.items()}
            held = now if held is None else {k: np.concatenate([held[k], now[k]]) for k in now}
            place = np.empty(len(held["q"]), np.int64)
            place[np.lexsort((held["index"], held["document"]))] = np.arange(len(place))
            offset = held["bonus"] - held["penalty"]
            live = np.flatnonzero(~dominated(held["q"], offset, held["document"], held["score"], held["lexical"], place, per_document))
            args = held["q"][live], offset[live]
            keep = live[cut(*args, held["score"][live], place[live], most) | cut(*args, held["lexical"][live], place[live], most)]
            held, place = {k: v[keep] for k, v in held.items()}, place[keep]
        if held is None:
            return
        names = {"document": "document_id", "index": "chunk_index"}
        out = {"query_id": _ids(s, held["q"], kind)} | {names.get(k, k): pa.array(v) for k, v in held.items() if k != "q"}
        yield from pa.table(out).to_batches(max_chunksize=50_000)

    return run


def counts(scorer, asked):
    """How many chunks come before each candidate, by score and by lexical points.

    ``asked`` has for each question its candidates: numbers, scores, points, documents and indexes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, wanted = scorer.value, asked.value
        total = {k: np.zeros((2, len(w["number"])), np.int64) for k, w in wanted.items()}
        for x in s.run(batches):
            m = x.score.shape[1]
            documents, indexes = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (x.documents, x.indexes))
            for k, w in wanted.items():
                # how many of these chunks come before a candidate by document and index
                both = np.lexsort((np.r_[np.zeros(len(w["number"])), np.ones(m)], np.r_[w["index"], indexes], np.r_[w["document"], documents]))
                chunk = both >= len(w["number"])
                spot = np.empty(len(w["number"]), np.int64)
                spot[both[~chunk]] = np.cumsum(chunk)[~chunk]
                score = np.where(np.isnan(x.score[k]), -np.inf, x.score[k])
                for j, (mine, theirs) in enumerate(((w["score"], score), (w["lexical"], x.lexical[k]))):
                    values, code = np.unique(np.r_[-mine, -theirs], return_inverse=True)
                    code = code.reshape(-1) * (m + 1)
                    total[k][j] += np.searchsorted(np.sort(code[len(mine) :] + np.arange(m)), code[: len(mine)] + spot)
        for k, w in wanted.items():
            yield pa.RecordBatch.from_arrays([pa.array(w["number"]), pa.array(total[k][0]), pa.array(total[k][1])], ["number", "dense_before", "lexical_before"])

    return run


class Terms:
    """Words of a bounded group of questions, and for each word what asks for it."""

    def __init__(self, questions: list[object], asked: dict[str, list[tuple[int, int]]]):
        words = list(asked)
        self.questions, self.words = questions, pa.array(words, pa.string())
        self.start = np.cumsum([0, *(len(asked[w]) for w in words)])
        self.question = np.array([k for w in words for k, _ in asked[w]], np.int64)
        self.times = np.array([n for w in words for _, n in asked[w]], np.int64)
        self.weight = np.minimum(np.array([len(w) for w in words], float) / 3.0, 2.0)


def term_sums(terms, kind: pa.DataType, keep: list[str]):
    """Rows with the words of a text (_words) to a row for each question that has one of them; no row moves for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = terms.value
        ids, many, n_words = pa.array(t.questions, kind), len(t.questions), max(1, len(t.words))
        most = max(1, PAIRS // max(1, len(t.question)))
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                rows = batch.slice(a, most)
                tokens = rows.column("_words")
                size = pa.compute.fill_null(pa.compute.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                code = pa.compute.fill_null(pa.compute.index_in(tokens.flatten(), value_set=t.words.cast(tokens.type.value_type)), -1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)[code >= 0]
                met, count = np.unique(row * n_words + code[code >= 0], return_counts=True)
                row, code = met // n_words, met % n_words
                asks = t.start[code + 1] - t.start[code]
                at = np.repeat(t.start[code] - np.cumsum(asks) + asks, asks) + np.arange(asks.sum())
                share, weight, row = np.repeat(count / size[row], asks), np.repeat(t.weight[code], asks), np.repeat(row, asks)
                key, back = np.unique(row * many + t.question[at], return_inverse=True)
                score = np.bincount(back.reshape(-1), t.times[at] * share * weight, len(key))
                where = pa.array(key // max(1, many))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(key % max(1, many))), *(rows.column(c).take(where) for c in keep), pa.array(score)], ["query_id", *keep, "score"])

    return run
