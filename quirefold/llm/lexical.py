"""Ranked lexical search: accumulator-limited term-at-a-time evaluation of whole tables of questions.

1. One pass over the texts leaves for every document its number of terms and its counts of the questions' terms, in the shared
   folder. The corpus figures (documents, terms, documents of a term) are added up from that table.
2. Every task turns its documents, batch by batch, into lists by term and evaluates each question against them: terms rarest
   first; a document gets an accumulator only while the highest scores that the remaining terms can add in this batch, summed, reach
   the k-th highest partial score. After that the accumulators left are updated exactly, by looking up the survivors alone,
   and those that can no longer reach the k-th are let go. The k-th score of a task's earlier batches raises the bar for later ones.
3. Each task returns its k best documents of a question, and those meet in one ranking.

Questions are taken in blocks of bounded size; each block passes over the documents. All scores are integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType

from quirefold.llm.common import give_back, pieces, share, shared, small_batches, spread, utf8
from quirefold.session import materialize

K = 20
#: Parameters of the score: saturation, in hundredths, and the part of it that follows a document's length, in hundredths.
SATURATION, LENGTH_PART = 12, 25
BLOCK_BYTES = 4 << 20
BLOCK_POSTINGS = 1 << 21

#: Bytes of terms in lower case; every other byte becomes a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


@dataclass
class Block:
    """Questions of one block: their ids and, for each, its terms' numbers with how often it has them."""

    ids: list
    terms: list[list[tuple[int, int]]]
    vocabulary: dict[bytes, int]


def question_blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Distinct questions in blocks of about ``block_bytes``: only one block at a time is on the driver.

    Blocks are dealt by a hash; a block found larger than the bound is dealt again into smaller ones, down to single questions.
    """
    rows = materialize(items.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).distinct(), "questions")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64

    def deal(part: DataFrame, seed: int) -> Iterator[Block]:
        total = part.agg(F.sum(size).alias("b"), F.count("*").alias("n")).first()
        if not total["n"]:
            return
        if total["b"] <= block_bytes or total["n"] == 1:
            vocabulary: dict[bytes, int] = {}
            ids, found = [], []
            for row in part.collect():
                counts = Counter(terms(row["text"].encode() if row["text"] is not None else b""))
                ids.append(row["id"])
                found.append([(vocabulary.setdefault(t, len(vocabulary)), c) for t, c in counts.items()])
            yield Block(ids, found, vocabulary)
            return
        n = int(2 * total["b"] // block_bytes) + 2
        for k in range(n):
            yield from deal(part.filter(F.pmod(F.xxhash64("id", "text", F.lit(seed)), F.lit(n)) == k), seed + 1)

    yield from deal(rows, 0)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: length and counts of the vocabulary's terms for each document that has any term at all."""
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    sent = share(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared(sent)
        v = len(known)
        known = known | {b"\0": v}  # ends a document; no term holds this byte
        for batch in pieces(batches):
            texts = [(t or b"").translate(TERM_BYTES) for t in utf8(batch.column(1))]
            words = b" \0 ".join([*texts, b""]).split()
            codes = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
            ends = np.flatnonzero(codes == v)
            n = np.diff(ends, prepend=-1) - 1
            doc = np.repeat(np.arange(len(ends)), n + 1)
            own = (codes >= 0) & (codes < v)
            pairs, tfs = np.unique(doc[own] * max(v, 1) + codes[own], return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(ends) + 1) * max(v, 1))
            found = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), *(
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.astype(np.int32))) for x in (pairs % max(v, 1), tfs)
                )], names=["doc_id", "n", "terms", "tfs"],
            )
            yield found.filter(pa.array(n > 0))

    schema = rows.select("doc_id").schema.add("n", "long").add("terms", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType()))
    with small_batches(docs.sparkSession):
        return materialize(rows.mapInArrow(run, schema), "term-counts")


def corpus_figures(counts: DataFrame, v: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents of each of the ``v`` terms. Tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(v + 2, np.int64)
        for batch in batches:
            found[v] += batch.num_rows
            found[v + 1] += batch.column(0).to_numpy().sum()
            found[:v] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=v)[:v]
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(found[slots])], names=["slot", "value"])

    sums = np.zeros(v + 2, np.int64)
    for row in counts.select("n", "terms").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        sums[row["slot"]] = row["value"]
    return int(sums[v]), int(sums[v + 1]), sums[:v]


def term_weight(documents: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * with_term + 1)))


def plan_terms(found: list[tuple[int, int]], df: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A question's terms that occur and weigh something, rarest first, and their weights times their number in the question."""
    order = sorted((t for t in found if df[t[0]] and weights[t[0]]), key=lambda t: (df[t[0]], t[0]))
    return np.array([t for t, _ in order], np.int64), np.array([weights[t] * c for t, c in order], np.int64)


class Lists:
    """Lists by term of one batch of documents: ``docs`` and what an occurrence's count is worth before its term's weight."""

    def __init__(self, n: np.ndarray, lengths: np.ndarray, codes: np.ndarray, tfs: np.ndarray, documents: int, total: int, v: int):
        self.size = len(n)
        m = 100 - LENGTH_PART + (LENGTH_PART * n * documents) // total
        doc = np.repeat(np.arange(self.size), lengths)
        worth = (1_000_000_000 * tfs) // (1000 * tfs + SATURATION * m[doc])
        order = np.argsort(codes, kind="stable")
        self.docs, self.worth = doc[order], worth[order]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=v))))
        self.most = np.zeros(v, np.int64)
        np.maximum.at(self.most, codes, worth)

    def best(self, own: np.ndarray, weights: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and exact scores of all that can be among the k best above ``bar`` (ties with the k-th included), and
        the number of accumulators that were made."""
        bounds = weights * self.most[own]
        here = bounds > 0
        own, weights, bounds = own[here], weights[here], bounds[here]
        left = np.concatenate((np.cumsum(bounds[::-1])[::-1][1:], [0])) if len(own) else bounds
        scores, seen = np.zeros(self.size, np.int64), 0
        alive: np.ndarray | None = None  # None: documents may still get accumulators
        for term, weight, bound, rest in zip(own, weights, bounds, left):
            at = slice(self.starts[term], self.starts[term + 1])
            docs = self.docs[at]
            seen += int(bound)
            if alive is None:
                scores[docs] += weight * self.worth[at]
            else:
                place = np.searchsorted(docs, alive)
                place[place == len(docs)] = 0
                hit = docs[place] == alive
                scores[alive[hit]] += weight * self.worth[at][place[hit]]
            if rest >= max(seen, bar):
                continue  # no partial score is higher than what is seen, so no bar can be above the rest
            partial = scores if alive is None else scores[alive]
            kth = int(np.partition(partial, len(partial) - k)[len(partial) - k]) if len(partial) >= k else 0
            least = max(kth, bar)
            if rest < least:
                alive = np.flatnonzero(scores) if alive is None else alive
                alive = alive[scores[alive] + rest >= least]
        if alive is None:
            alive = np.flatnonzero(scores)
        made = len(alive)
        found = scores[alive]
        if len(found) > k:
            enough = found >= np.partition(found, len(found) - k)[len(found) - k]
            alive, found = alive[enough], found[enough]
        above = (found > 0) & (found >= bar)
        return alive[above], found[above], made


def _batches_of(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.Table]:
    """Batches gathered until they hold ``postings`` counts: longer lists, fewer steps."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch.column(2).flatten())
        if count >= postings:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of every question, with scores above 0, ties by smaller id, null ids last.

    Null and empty texts have no terms and are not found; a question without terms finds nothing. Rows of one id and text are one
    question; rows of one id with different texts are questions of their own under that id. Repeated documents count as often
    as they occur, also in the result. Very long texts are counted as a whole; an empty table on either side gives no rows;
    further columns are not read, whatever their names.
    """
    found = [_search_block(docs, block, k, id_col, text_col) for block in question_blocks(items, item_col, item_text_col, block_bytes)]
    if not found:
        found = [_search_block(docs.limit(0), Block([], [], {}), k, id_col, text_col)]
    best = reduce(DataFrame.union, found)
    kinds = items.select(F.col(f"`{item_col}`").alias("item_id")).schema["item_id"].dataType
    return best.select(F.col("item_id").cast(kinds).alias("item_id"), "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: Block, k: int, id_col: str, text_col: str) -> DataFrame:
    counts = count_terms(docs, block.vocabulary, id_col, text_col)
    v = max(1, len(block.vocabulary))
    documents, total, df = corpus_figures(counts, v)
    weights = np.array([term_weight(documents, int(x)) for x in df], np.int64)
    sent = share(docs.sparkSession, [plan_terms(t, df, weights) for t in block.terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared(sent)
        best: list[list[tuple]] = [[] for _ in plans]
        for batch in _batches_of(batches, BLOCK_POSTINGS):
            batch = batch.combine_chunks()
            codes = batch.column(2).combine_chunks()
            lists = Lists(
                batch.column(1).to_numpy(), pc.list_value_length(codes).to_numpy().astype(np.int64), codes.flatten().to_numpy().astype(np.int64),
                batch.column(3).combine_chunks().flatten().to_numpy().astype(np.int64), documents, total, v,
            )
            ids = batch.column(0)
            place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
            for item, (own, weight) in enumerate(plans):
                held = best[item]
                at, score, _ = lists.best(own, weight, k, -held[-1][0] if len(held) == k else 0)
                if len(at):
                    first = at[np.lexsort((place[at], -score))[:k]]
                    values = dict(zip(at.tolist(), score.tolist()))
                    new = [(-values[d], x is None, x) for d, x in zip(first.tolist(), ids.take(pa.array(first)).to_pylist())]
                    best[item] = sorted(held + new, key=lambda e: (e[0], e[1], 0 if e[1] else e[2]))[:k]
        rows = [(item, x, -score) for item, held in enumerate(best) for score, _, x in held]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], id_type), pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"]
        )
        give_back()

    id_type = to_arrow_type(counts.schema["doc_id"].dataType)
    schema = counts.select("doc_id").schema
    tops = counts.select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"item int, doc_id {schema['doc_id'].dataType.simpleString()}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(n, None if x is None else str(x)) for n, x in enumerate(block.ids)], "item int, item_id string")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
