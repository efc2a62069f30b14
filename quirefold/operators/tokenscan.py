"""Phrases counted in the token lists of chunks, and what queries make of the counts, a block of chunks at a time.

A task holds one bounded block of queries and the counts of one bounded block of chunks, so memory does not grow with the chunks,
and what leaves a task is the k best chunks of each query or the matches that were asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quirefold.functions import fixed_values as fv
from quirefold.operators.ranking import SCORE_DIGITS

#: Cells of a block (chunks by queries) in a task.
CELLS = 1 << 21
_TIE = 4 * 10.0 ** -SCORE_DIGITS
_NO_ID = np.iinfo(np.int64).min


class PhraseCounter:
    """How often each of the given phrases (lists of tokens) stands in token lists: all phrases in one pass, overlaps included."""

    def __init__(self, phrases: list[list[str]]):
        words = sorted({w for p in phrases for w in p})
        code = {w: i for i, w in enumerate(words)}
        self.n, self.unknown, self.words = len(phrases), len(words), pa.array(words, pa.string())
        self.single, self.first = np.full(len(words) + 1, -1), np.zeros(len(words) + 1, bool)
        levels: list[dict[int, int]] = []  # (state, next token) -> state, for each further token
        ends, states = {}, len(words)
        for k, phrase in enumerate(phrases):
            if len(phrase) == 1:
                self.single[code[phrase[0]]] = k
                continue
            state = code[phrase[0]]
            self.first[state] = True
            for depth, word in enumerate(phrase[1:]):
                if depth == len(levels):
                    levels.append({})
                key = state * (self.unknown + 1) + code[word]
                if key not in levels[depth]:
                    levels[depth][key] = states = states + 1
                state = levels[depth][key]
            ends[state] = k
        self.levels = []
        for level in levels:
            keys = np.array(sorted(level), np.int64)
            after = np.array([level[k] for k in keys.tolist()], np.int64)
            self.levels.append((keys, after, np.array([ends.get(s, -1) for s in after.tolist()], np.int64)))

    def counts(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, times) for every phrase of every list, by row."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), self.unknown).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        one = self.single[codes]
        at = np.flatnonzero(one >= 0)
        found = [row[at] * self.n + one[at]]
        if self.levels:
            end = np.repeat(np.cumsum(sizes), sizes)
            start = np.flatnonzero(self.first[codes])
            state = codes[start]
            for depth, (keys, after, ends) in enumerate(self.levels, 1):
                inside = start + depth < end[start]
                start, state = start[inside], state[inside]
                key = state * (self.unknown + 1) + codes[start + depth]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                known = keys[place] == key
                start, place = start[known], place[known]
                state, done = after[place], ends[place]
                found.append(row[start[done >= 0]] * self.n + done[done >= 0])
        key, times = np.unique(np.concatenate(found), return_counts=True)
        return key // max(self.n, 1), key % max(self.n, 1), times


class Weights:
    """What a phrase weighs in each query that asks for it, by phrase: most queries ask for few phrases, so only these cells are held."""

    def __init__(self, phrase: list[int], query: list[int], value: list[float], n_phrases: int, n_queries: int):
        order = np.argsort(np.asarray(phrase, np.int64), kind="stable")
        self.query, self.value = np.asarray(query, np.int64)[order], np.asarray(value, np.float64)[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(np.asarray(phrase, np.int64), minlength=n_phrases))])
        self.n_queries = n_queries

    def asking(self, phrase: np.ndarray) -> np.ndarray:
        """How many queries ask for each of the phrases."""
        return self.start[phrase + 1] - self.start[phrase]

    def scores(self, row: np.ndarray, phrase: np.ndarray, weight: np.ndarray, n_rows: int) -> np.ndarray:
        """(queries, rows): the sums of the weights of the phrases that a row holds."""
        times = self.asking(phrase)
        at = np.repeat(self.start[phrase] - np.cumsum(times) + times, times) + np.arange(times.sum())
        key = self.query[at] * n_rows + np.repeat(row, times)
        return np.bincount(key, np.repeat(weight, times) * self.value[at], self.n_queries * n_rows).reshape(self.n_queries, n_rows)


@dataclass
class Asked:
    """A block of queries. ``slots`` are rows that are ranked: (query, wanted type, wanted document); "" and 0 want any.

    ``clauses`` has for each query that is bound to clauses its alternatives (phrases that must be there, groups that must not be there as a
    whole), as phrase numbers; ``sides`` has for each query of a Boolean match its three lists.
    """

    query_ids: list
    phrases: list[str]
    counter: PhraseCounter
    weights: Weights  # times a phrase is asked for by its inverse frequency
    slots: list[tuple[int, str, int]]
    mean_length: float
    clauses: dict[int, list[tuple[list[int], list[list[int]]]]] = field(default_factory=dict)
    sides: list[tuple[list[int], list[int], list[int]]] = field(default_factory=list)


@dataclass
class _Block:
    """Some chunks of a batch: which phrases they hold (by row) and what these weigh in them."""

    row: np.ndarray
    phrase: np.ndarray
    weight: np.ndarray
    chunk: pa.Array
    document: pa.Array
    types: np.ndarray | None

    def holds(self, phrases: set[int]) -> dict[int, np.ndarray]:
        """For each of the phrases, whether a row holds it."""
        out = {p: np.zeros(len(self.chunk), bool) for p in phrases}
        wanted = np.isin(self.phrase, np.fromiter(phrases, np.int64, len(phrases)))
        for p, r in zip(self.phrase[wanted].tolist(), self.row[wanted].tolist()):
            out[p][r] = True
        return out


def _all(held: dict[int, np.ndarray], phrases: list[int], n: int) -> np.ndarray:
    return np.logical_and.reduce([held[p] for p in phrases]) if phrases else np.ones(n, bool)


def _blocks(batch: pa.RecordBatch, asked: Asked) -> Iterator[_Block]:
    """A block has so many chunks that neither its cells nor the weights that are added up in them exceed ``CELLS`` by more than a chunk."""
    lists = batch.column("lists")
    copies = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = np.repeat(np.arange(batch.num_rows), copies)
    row, phrase, times = asked.counter.counts(lists.flatten())
    row = inner[row]
    length = pc.fill_null(batch.column("n_tokens"), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    norm = 1 - fv.BM25_B + fv.BM25_B * length / asked.mean_length if asked.mean_length else np.ones(len(length))
    weight = times * (fv.BM25_K1 + 1) / (times + fv.BM25_K1 * norm[row])
    types = np.array(batch.column("file_type").to_pylist(), object) if "file_type" in batch.schema.names else None
    cost = np.bincount(row, asked.weights.asking(phrase), batch.num_rows) + max(len(asked.query_ids), len(asked.slots), 1)
    ends = np.flatnonzero(np.diff(np.cumsum(cost) // CELLS, append=-1)) + 1
    for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
        a, b = np.searchsorted(row, [lo, hi])
        yield _Block(row[a:b] - lo, phrase[a:b], weight[a:b], batch.column("chunk_id").slice(lo, hi - lo),
                     batch.column("document_id").slice(lo, hi - lo), None if types is None else types[lo:hi])


def _unsatisfied(block: _Block, asked: Asked) -> Iterator[tuple[int, np.ndarray]]:
    """Each query that is bound to clauses, and the chunks that satisfy none of them."""
    held = block.holds({p for clauses in asked.clauses.values() for needed, banned in clauses for p in (*needed, *(x for g in banned for x in g))})
    n = len(block.chunk)
    for q, clauses in asked.clauses.items():
        good = np.zeros(n, bool)
        for needed, banned in clauses:
            one = _all(held, needed, n)
            for group in banned:
                one = one & ~_all(held, group, n)
            good |= one
        yield q, ~good


class _Best:
    """The k best chunks of every slot so far, by rounded score and then chunk id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.zeros(n)
        self.kept = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(n)]

    def add(self, scores: np.ndarray, chunk: np.ndarray, document: np.ndarray) -> None:
        """``scores`` has a row per slot; only those that come near a slot's floor are rounded and looked at one by one."""
        slot, column = np.nonzero(scores > np.maximum(self.floor - _TIE, 0)[:, None])
        score = scores[slot, column]
        reach = np.round(score, SCORE_DIGITS) >= self.floor[slot]
        slot, column, score = slot[reach], column[reach], score[reach]
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(slot)).tolist()):
            i, found = slot[a], column[a:b]
            s, c, d = (np.concatenate(x) for x in zip(self.kept[i], (score[a:b], chunk[found], document[found])))
            r = np.round(s, SCORE_DIGITS)
            order = np.lexsort((c, -r))[: self.k]
            self.kept[i] = s[order], c[order], d[order]
            if len(order) == self.k:
                self.floor[i] = r[order[-1]]


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), _NO_ID).to_numpy(zero_copy_only=False)


def _column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == _NO_ID)


def best(asked: Asked, k: int):
    """A task's (query_id, chunk_id, document_id, score): the k best of every slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(len(asked.slots), k)
        query = np.array([q for q, _, _ in asked.slots], np.int64)
        want_doc = np.array([d for _, _, d in asked.slots], np.int64)
        plain = np.array_equal(query, np.arange(len(asked.query_ids)))  # every query stands there once
        for batch in batches:
            for block in _blocks(batch, asked):
                chunk, document = _ids(block.chunk), _ids(block.document)
                scores = asked.weights.scores(block.row, block.phrase, block.weight, len(block.chunk))
                for q, missed in _unsatisfied(block, asked):
                    scores[q, missed] = 0.0
                if not plain:
                    scores = scores[query]
                if want_doc.any():
                    scores[(want_doc != 0)[:, None] & (want_doc[:, None] != document)] = 0.0
                if block.types is not None:
                    for slot, (_, kind, _) in enumerate(asked.slots):
                        if kind:
                            scores[slot, block.types != kind] = 0.0
                top.add(scores, chunk, document)
        sizes = [len(s) for s, _, _ in top.kept]
        s, c, d = (np.concatenate([x[i] for x in top.kept] or [np.empty(0)]) for i in range(3))
        ids = pa.array([asked.query_ids[q] for q in np.repeat(query, sizes)], pa.int64())
        yield pa.RecordBatch.from_arrays([ids, _column(c.astype(np.int64)), _column(d.astype(np.int64)), pa.array(s, pa.float64())],
                                         names=["query_id", "chunk_id", "document_id", "score"])

    return run


def _pairs(asked: Asked, block: _Block, rows: np.ndarray, query: np.ndarray) -> list[pa.Array]:
    at = pa.array(rows)
    return [pa.array([asked.query_ids[q] for q in query.tolist()], pa.int64()), block.chunk.take(at).cast(pa.int64()), block.document.take(at).cast(pa.int64())]


def matches(asked: Asked):
    """(query_id, chunk_id, document_id) of the chunks that satisfy a query's three lists (all of, any of, none of)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch, asked):
                held, n = block.holds({p for sides in asked.sides for side in sides for p in side}), len(block.chunk)
                good = np.zeros((n, len(asked.query_ids)), bool)
                none = lambda phrases: np.logical_and.reduce([~held[p] for p in phrases]) if phrases else np.ones(n, bool)
                for q, (every, some, no) in enumerate(asked.sides):
                    good[:, q] = ~none(some or every) & _all(held, every, n) & none(no)
                rows, query = np.nonzero(good)
                yield pa.RecordBatch.from_arrays(_pairs(asked, block, rows, query), names=["query_id", "chunk_id", "document_id"])

    return run


def phrase_rows(counter: PhraseCounter, phrases: list[str]):
    """(phrase, chunk_id, document_id, n_tokens, tf) of every phrase in every chunk that holds it."""
    names = pa.array(phrases, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lists")
            copies = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            inner = np.repeat(np.arange(batch.num_rows), copies)
            row, phrase, times = counter.counts(lists.flatten())
            row = inner[row]
            again = copies[row]  # chunks under one id: each list meets each
            at, times = pa.array(np.repeat(row, again)), np.repeat(times, again)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(np.repeat(phrase, again))), batch.column("chunk_id").take(at).cast(pa.int64()),
                 batch.column("document_id").take(at).cast(pa.int64()), batch.column("n_tokens").take(at), pa.array(times, pa.int32())],
                names=["phrase", "chunk_id", "document_id", "n_tokens", "tf"])

    return run


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, chunk_id, document_id, n_tokens, tf, positions) of the token lists (chunk_id, document_id, tokens)."""
    for batch in batches:
        lists = batch.column("tokens")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(1, len(coded.dictionary))
        key = np.repeat(np.arange(len(sizes)), sizes) * n + codes
        order = np.argsort(key, kind="stable")
        key = key[order]
        place = (np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(heads, len(key))
        row = key[heads] // n
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(key[heads] % n)), batch.column("chunk_id").take(pa.array(row)), batch.column("document_id").take(pa.array(row)),
             pa.array(sizes[row], pa.int32()), pa.array(np.diff(ends), pa.int32()),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))],
            names=["term", "chunk_id", "document_id", "n_tokens", "tf", "positions"])
