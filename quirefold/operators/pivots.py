"""Exact nearest vectors by pivots: blocks of vectors that cannot hold an answer are not read.

Unit vectors are sorted by their nearest pivot and their distance to it, and cut into blocks. A block knows the smallest and the largest
distance of its vectors to every pivot, so by the triangle inequality a question's own distances to the pivots bound how near
any vector of the block can be. The blocks of the best bounds give a cutoff for each question, and only blocks whose bound
reaches it are scored. Answers, ties included, are those of a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.operators.ranking import SCORE_DIGITS, stable, top_k
from quirefold.operators.vectors import _cut, _matrix, _TopK
from quirefold.session import broadcast_if_small, materialize, measured_bytes

PIVOTS = 64
BLOCK_ROWS = 64
QUERY_BYTES = 32 << 20
#: Seed pairs up to this size are sent to the tasks; more meet their blocks by a shuffle.
SEED_BYTES = 4 << 20
#: Blocks per question that are scored first, for the cutoff.
SEED_BLOCKS = 4
#: Scores of seeds that a task holds before it keeps the best.
SEED_ROWS = 1 << 21
SLACK = 10.0 ** -(SCORE_DIGITS - 1)
#: What bounds in single precision can be too low by.
SINGLE = 4e-6
#: Questions and blocks whose bounds are computed at once, and blocks that are scored at once if most questions need them.
TILE = 1 << 9
GROUP = 32


@dataclass
class PivotIndex:
    """``blocks(block, n, low, high, ids, vectors)`` and the pivots; ``low`` and ``high`` are null for blocks of zero vectors."""

    blocks: DataFrame
    pivots: np.ndarray
    key: str


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Lengths of the differences, from the differences themselves: near 0 a cosine is too coarse."""
    return np.stack([np.linalg.norm(vectors - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(vectors), 0))


def choose_pivots(vectors: DataFrame, key: str, number: int = PIVOTS) -> np.ndarray:
    """A sample of at most ``number`` vectors by the hash of their id: any choice gives exact answers, a spread one skips more."""
    rows = vectors.filter(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64(key), key).limit(number)
    table = rows.select(F.col("embedding").cast("array<double>")).toArrow()
    return _matrix(table["embedding"]) if table.num_rows else np.zeros((0, 0))


def build(vectors: DataFrame, key: str = "chunk_id", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> PivotIndex:
    """One sort of the vectors by range; a pivot that very many vectors are near is split by distance like any range."""
    vectors = vectors.select(F.col(key).cast("long").alias(key), "embedding")
    chosen = choose_pivots(vectors, key, pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column(1))
                zero = ~unit.any(axis=1)
                far = _distances(unit, chosen)
                near = far.argmin(axis=1) if len(chosen) else np.zeros(len(unit), np.int64)
                least = far[np.arange(len(unit)), near] if len(chosen) else np.zeros(len(unit))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(unit), pa.list_(pa.float64())), pa.array(np.where(zero, -1, near), pa.int32()), pa.array(least)],
                    names=[key, "unit", "pivot", "away"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pivot = [], None

        def block() -> pa.RecordBatch:
            unit = np.array([u for _, u in held])
            far = _distances(unit, chosen)
            zero = pivot < 0 or not len(chosen)
            kind = pa.list_(pa.float64())
            return pa.RecordBatch.from_arrays([
                pa.array([len(held)], pa.int64()), pa.array([None if zero else far.min(axis=0)], kind), pa.array([None if zero else far.max(axis=0)], kind),
                pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([unit.ravel()], kind),
            ], names=["n", "low", "high", "ids", "vectors"])

        for batch in batches:
            for i, u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and (p != pivot or len(held) == block_rows):
                    yield block()
                    held = []
                pivot = p
                held.append((i, u))
        if held:
            yield block()

    placed = vectors.mapInArrow(place, f"{key} long, unit array<double>, pivot int, away double")
    ranged = placed.repartitionByRange("pivot", "away", key).sortWithinPartitions("pivot", "away", key)
    blocks = ranged.mapInArrow(cut, "n long, low array<double>, high array<double>, ids array<long>, vectors array<double>")
    return PivotIndex(materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "pivot-blocks"), chosen, key)


@dataclass
class Search:
    """``hits(query_id, rnk, key, score)``; ``work(query_id, vectors, scored)``: how many vectors a question was compared with."""

    hits: DataFrame
    work: DataFrame


class _Bounds:
    """What is known of a batch of blocks: the highest cosines that a block's vectors can have, for a tile of questions at a time."""

    def __init__(self, batch: pa.RecordBatch, far: np.ndarray, free: np.ndarray):
        self.far, self.free, self.n = far, free, batch.num_rows
        self.known = np.asarray(batch.column("low").is_valid())
        sides = [np.asarray(batch.column(c).flatten(), dtype=np.float32).reshape(-1, far.shape[1]) if self.known.any() else np.zeros((0, far.shape[1]), np.float32) for c in ("low", "high")]
        self.low, self.high = (np.ascontiguousarray(x.T) for x in sides)

    def of(self, at: int) -> np.ndarray:
        """(questions of the tile that begins at ``at``, blocks); 2 where there is no bound. Single precision: too low by ``SINGLE`` at most."""
        far = self.far[at : at + TILE]
        out = np.full((len(far), self.n), 2.0, np.float32)
        places = np.flatnonzero(self.known)
        for lo in range(0, len(places), TILE):
            width = min(TILE, len(places) - lo)
            least, gap = np.zeros((len(far), width), np.float32), np.empty((len(far), width), np.float32)
            for p in range(far.shape[1]):
                mine = far[:, p, None]
                np.maximum(least, np.subtract(mine, self.high[p, lo : lo + width], out=gap), out=least)
                np.maximum(least, np.subtract(self.low[p, lo : lo + width], mine, out=gap), out=least)
            out[:, places[lo : lo + width]] = 1 - least * least / 2
        out[self.free[at : at + TILE]] = 2
        return out


def _score(index: PivotIndex, query_ids: np.ndarray, queries: np.ndarray, far: np.ndarray, free: np.ndarray, cutoff: np.ndarray, k: int) -> DataFrame:
    """(q, query_id, key, score): the k best of each task in the blocks whose bound reaches a question's cutoff, read where they lie, and
    (q, query_id, scored): how many vectors these blocks have.

    The bounds are computed beside the vectors, so no list of questions and blocks is written, joined or sent. Neighbouring blocks that
    most questions of a tile need are multiplied at once, the others with the questions that need them.
    """
    key = index.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, scored = _TopK(query_ids, queries, k, cutoff), np.zeros(len(far), np.int64)
        for batch in batches:
            bounds, n = _Bounds(batch, far, free), np.asarray(batch.column("n"))
            start = np.append(0, np.cumsum(n))
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
            vectors = np.asarray(batch.column("vectors").flatten()).reshape(len(ids), -1)
            for at in range(0, len(far), TILE):
                bound = bounds.of(at)
                scored[at : at + TILE] += (bound + (SLACK + SINGLE) >= cutoff[at : at + TILE, None]) @ n
                for lo in range(0, len(n), GROUP):
                    reach = bound[:, lo : lo + GROUP] + (SLACK + SINGLE) >= top.floor[at : at + TILE, None]
                    groups = [(lo, lo + reach.shape[1], reach.any(axis=1))] if reach.mean() > 0.5 else [(lo + i, lo + i + 1, reach[:, i]) for i in np.flatnonzero(reach.any(axis=0))]
                    for first, end, need in groups:
                        some = slice(start[first], start[end])
                        top.add(ids[some], vectors[some], at + np.flatnonzero(need))
        for part, values in ((True, top.batch(key)), (False, scored)):
            q = top.rows() if part else np.flatnonzero(scored)
            none = lambda kind: pa.nulls(len(q), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(query_ids[q], pa.int64()), values.column(1) if part else none(pa.int64()),
                 values.column(2) if part else none(pa.float64()), none(pa.int64()) if part else pa.array(scored[q], pa.int64())],
                names=["q", "query_id", key, "score", "scored"])

    return index.blocks.select("n", "low", "high", "ids", "vectors").mapInArrow(run, f"q int, query_id long, {key} long, score double, scored long")


def _score_seeds(index: PivotIndex, seeds: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, key, score): the k best of each task for the pairs ``seeds(block, q)``, a few blocks a question."""
    key = index.key
    asked = seeds.groupBy("block").agg(F.collect_list("q").alias("qs"))
    rows = index.blocks.select("block", "ids", "vectors").join(broadcast_if_small(asked, SEED_BYTES), "block").select("ids", "vectors", "qs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def best() -> tuple:
            return _cut(*[np.concatenate([x[i] for x in held]) for i in range(3)], k)[:3]

        for batch in batches:
            for ids, flat, qs in zip(batch.column(0), batch.column(1), batch.column(2)):
                ids, qs = ids.values.to_numpy(), qs.values.to_numpy()
                scores = queries[qs] @ flat.values.to_numpy().reshape(len(ids), -1).T
                held.append((np.repeat(qs.astype(np.int64), len(ids)), scores.ravel(), np.tile(ids, len(qs))))
                size += scores.size
                if size > SEED_ROWS:
                    held, size = [best()], 0
        if held:
            q, scores, ids = best()
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores)], names=["query_id", key, "score"])

    return rows.mapInArrow(run, f"query_id long, {key} long, score double")


def _search_block(index: PivotIndex, table: pa.Table, k: int) -> Search:
    spark = index.blocks.sparkSession
    query_ids, queries = np.asarray(table["query_id"]), _matrix(table["embedding"])
    free = ~queries.any(axis=1)  # a zero question has the same cosine with all vectors
    far = _distances(queries, index.pivots).astype(np.float32)
    order = [stable(F.col("score")).desc(), F.asc(index.key)]
    summary = index.blocks.select("block", "n", "low", "high")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = min(SEED_BLOCKS, batch.num_rows)
            bounds = _Bounds(batch, far, free)
            for at in range(0, len(far) if n else 0, TILE):
                bound = bounds.of(at)
                best = np.argpartition(-bound, n - 1, axis=1)[:, :n]
                q = np.repeat(np.arange(len(bound)), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + q, pa.int32()), batch.column("block").take(pa.array(best.ravel())), pa.array(bound[q, best.ravel()], pa.float64())], names=["q", "block", "bound"])

    seeds = top_k(summary.mapInArrow(seed, "q int, block long, bound double"), "q", SEED_BLOCKS, [F.desc("bound"), F.asc("block")])
    first = top_k(_score_seeds(index, materialize(seeds.select("q", "block"), "seeds"), query_ids, queries, k), "query_id", k, order)
    last = {row["query_id"]: row["score"] for row in first.filter(F.col("rnk") == k).select("query_id", "score").collect()}  # a row a question
    cutoff = np.array([last.get(i, -2.0) for i in query_ids.tolist()])
    found = materialize(_score(index, query_ids, queries, far, free, cutoff, k), "pivot-found")  # written: the plan keeps no block of questions
    hits = top_k(found.filter("scored is null"), "query_id", k, order).select("query_id", "rnk", index.key, "score")
    scored = found.filter("scored is not null").groupBy("q", "query_id").agg(F.sum("scored").alias("scored"))
    work = scored.crossJoin(F.broadcast(summary.agg(F.sum("n").alias("vectors")))).select("query_id", "vectors", "scored")  # the total is one row
    return Search(hits, work)


def search(queries: DataFrame, index: PivotIndex, k: int) -> Search:
    """The ``k`` best vectors by cosine of every row of ``queries(query_id, embedding)``, equal to a scan of all vectors.

    Questions go to the tasks in blocks of bounded size. A question of zeros is compared with everything, and so are zero vectors.
    """
    size = measured_bytes(queries)
    n_blocks = max(1, -(-size // QUERY_BYTES))
    dealt = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for block in range(n_blocks):
        table = dealt.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).toArrow()
        if table.num_rows:
            part = _search_block(index, table, k)
            found = part if found is None else Search(found.hits.unionByName(part.hits), found.work.unionByName(part.work))
    if found is None:
        spark = queries.sparkSession
        return Search(spark.createDataFrame([], f"query_id long, rnk int, {index.key} long, score double"), spark.createDataFrame([], "query_id long, vectors long, scored long"))
    return found
