"""Exact top-k by inner product with the three-phase uniform threshold over blocks of dimensions.

A vector's score is the sum of its partial scores over ``lists`` blocks of dimensions; each block is one scored list per query.
The lists are taken in the order of the queries' norms in them, since the first ones then say most of a score.

1. Every task gathers, for each query, the highest entries of the first list and adds up those vectors' whole scores; the k
   best of them over all tasks give a cutoff that no answer lies below.
2. The cutoff is sent to the tasks. They compute list after list, and stop as soon as few pairs of query and vector are left:
   a pair is dropped if its sum so far and the norms of what is missing stay below the cutoff, or if no entry reaches
   the ``lists``-th part of it, as a sum that reaches the cutoff has to have one.
3. The missing terms are computed for the pairs left only, and the k best whole scores of each task meet in one ranking.

Queries are taken in blocks of bounded size; each block passes over all vectors. Integer arithmetic is exact: beyond 2**50
all terms are computed as Python's integers, and nothing is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import pieces, spread
from quirefold.session import materialize

LISTS = 4
SCALE = 256
BLOCK_BYTES = 8 << 20
MATRIX = 1 << 22
NO_CUT = -(1 << 100)
#: Entries of the first list that a task resolves for the cutoff, times k.
GATHERED = 8
#: Missing terms are computed pair by pair when at most one pair in so many is left.
FEW = 24
#: Norms are rounded; bounds made of them are raised by this part and by one.
SLACK = 1 + 1e-9


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: components as floor(scale * x). Vectors that are null, or hold nulls or values that are not finite, and rows without an id are left out.

    An empty vector scores 0 with every other. Further columns are not read, whatever their names.
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda y: y.isNull() | F.isnan(y) | (F.abs(y.cast("double")) == float("inf")))
    return vectors.filter(x.isNotNull() & F.col(id_col).isNotNull()).filter(~bad).select(
        F.col(id_col).alias("vec_id"), F.transform(x, lambda y: F.floor(y.cast("double") * scale).cast("double")).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors padded or cut to ``width`` (as zeros count for nothing in a product) as rows."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width), sizes
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out, sizes


def _split(width: int, lists: int) -> list[slice]:
    edges = np.linspace(0, width, min(lists, max(1, width)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _by_norm(queries: np.ndarray, lists: int) -> list[slice]:
    """The lists, that with the largest norms of the queries first."""
    return sorted(_split(queries.shape[1], lists), key=lambda b: -float(np.square(queries[:, b]).sum()))


def _fits(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether all scores and their parts are exact as doubles."""
    return np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * queries.shape[1] < 1 << 50


def _whole(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All scores as Python's integers."""
    as_int = lambda m: np.array([[int(x) for x in r] for r in m], object).reshape(m.shape)
    return as_int(queries) @ as_int(vectors).T


def _pairs(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Products of the named pairs of rows, in steps of bounded size."""
    out = np.empty(len(q))
    step = max(1, MATRIX // max(1, queries.shape[1]))
    for at in range(0, len(q), step):
        out[at:at + step] = np.einsum("ij,ij->i", queries[q[at:at + step]], vectors[column[at:at + step]])
    return out


def _tails(rows: np.ndarray, blocks: list[slice]) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the rows in each list, and in each list and all that follow it."""
    squares = np.stack([np.square(rows[:, b]).sum(axis=1) for b in blocks])
    return np.sqrt(squares), np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])


def resolve(queries: np.ndarray, vectors: np.ndarray, blocks: list[slice], cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3 on a slice: rows, columns and scores of all pairs that reach their query's cutoff, and the multiplications done."""
    m, least = len(blocks), cut[:, None]
    own, tail = _tails(queries, blocks)
    other, rest = _tails(vectors, blocks)
    terms, done = [], 0
    total = np.zeros((len(queries), len(vectors)))
    for j, b in enumerate(blocks):
        terms.append(queries[:, b] @ vectors[:, b].T)
        total += terms[-1]
        done += total.size * (b.stop - b.start)
        if j + 1 == m:
            live = total >= least
        elif np.median(cut - tail[j + 1] * np.median(rest[j + 1])) <= 0:  # hardly a pair would be dropped
            continue
        else:
            live = np.outer(tail[j + 1] * SLACK, rest[j + 1])
            live += total
            live = live + 1 >= least
        if j + 1 == m or np.count_nonzero(live) * FEW <= live.size:
            break
    q, column = np.nonzero(live)
    seen = np.zeros(len(q), bool)
    for j in range(m):
        entry = terms[j][q, column] if j < len(terms) else own[j][q] * other[j][column] * SLACK + 1
        seen |= entry * m >= cut[q]  # the uniform threshold
    q, column = q[seen], column[seen]
    score = total[q, column]
    for b in blocks[len(terms):]:
        score += _pairs(queries[:, b], vectors[:, b], q, column)
        done += len(q) * (b.stop - b.start)
    good = score >= cut[q]
    return q[good], column[good], score[good], done


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, in no order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    if scores.dtype == object:
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]


def _slices(batches: Iterator[pa.RecordBatch], width: int, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in pieces(batches):
        matrix, _ = _matrix(batch.column(1), width)
        ids = batch.column(0).to_numpy()
        step = max(64, MATRIX // max(1, queries))
        for at in range(0, len(ids), step):
            yield ids[at:at + step], matrix[at:at + step]


def _as_long(scores: np.ndarray) -> pa.Array:
    return pa.array([int(min(max(x, -(1 << 63)), (1 << 63) - 1)) for x in scores.tolist()], pa.int64())


def _gather(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, lists: int) -> DataFrame:
    """Phase 1: ``(q, vec_id, score)``, the k best whole scores of each slice among the tops of its first list."""
    width, blocks = queries.shape[1], _by_norm(queries, lists)

    def run(batches):
        for own, matrix in _slices(batches, width, len(ids)):
            fits = _fits(queries, matrix)
            part = queries[:, blocks[0]] @ matrix[:, blocks[0]].T if fits else _whole(queries, matrix)
            low = -np.inf if fits else -(1 << 200)
            for at in np.flatnonzero(np.isin(own, ids)):
                part[ids == own[at], at] = low
            top = _best(part, k * GATHERED if fits else k)
            q, column = np.repeat(np.arange(len(ids)), top.shape[1]), top.ravel()
            held = part[q, column] > low
            q, column = q[held], column[held]
            score = _pairs(queries, matrix, q, column) if fits else part[q, column]
            yield _first(ids, own, q, column, score, k)

    return vectors.mapInArrow(run, "q int, vec_id long, score long")


def _first(ids: np.ndarray, own: np.ndarray, q: np.ndarray, column: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best pairs of each query, ties to the smaller id, without those of a query with its own id."""
    apart = ids[q] != own[column]
    q, column, score = q[apart], column[apart], score[apart]
    order = np.lexsort((own[column], -score, q)) if score.dtype != object else np.array(
        sorted(range(len(q)), key=lambda x: (q[x], -score[x], own[column[x]])), np.int64)
    q, column, score = q[order], column[order], score[order]
    held = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return pa.RecordBatch.from_arrays([pa.array(q[held], pa.int32()), pa.array(own[column[held]], pa.int64()), _as_long(score[held])], names=["q", "vec_id", "score"])


def _collect(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, cutoff, k: int, lists: int) -> DataFrame:
    """Phases 2 and 3: ``(q, vec_id, score)`` of every vector that reaches its query's cutoff, k of a slice at most."""
    width, blocks = queries.shape[1], _by_norm(queries, lists)

    def run(batches):
        whole = np.array(cutoff.value, object)
        rounded = np.nextafter(whole.astype(np.float64), -np.inf)  # never above the cutoff
        for own, matrix in _slices(batches, width, len(ids)):
            if _fits(queries, matrix):
                q, column, score, _ = resolve(queries, matrix, blocks, rounded)
            else:
                total = _whole(queries, matrix)
                q, column = np.nonzero(total >= whole[:, None])
                score = total[q, column]
            yield _first(ids, own, q, column, score, k)

    return vectors.mapInArrow(run, "q int, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, lists: int = LISTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products of each row of ``queries(vec_id, v)`` with the rows of ``vectors(vec_id, v)``.

    Ties go to the smaller id. Rows with the query's own id are not its candidates; repeated query rows count once, repeated
    vectors as often as they occur. Vectors of other lengths are as if filled up with zeros; a query block holds at least one query,
    however long it is, and vectors pass in slices of bounded size. Scores beyond a long are cut to its bounds. Fewer candidates than k are all returned, no queries or candidates give no rows.
    """
    spark = vectors.sparkSession
    vectors = spread(vectors)
    found = None
    queries = materialize(queries.dropDuplicates(["vec_id", "v"]), "queries")
    shape = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    per_block = max(1, block_bytes // (8 * max(1, shape["w"] or 1)))
    n_blocks = -(-int(shape["n"]) // per_block)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_blocks))))
    for number in range(n_blocks):
        rows = dealt.filter(F.col("block") == number).orderBy("vec_id").select("vec_id", "v").toArrow()  # a block of bounded size
        if not rows.num_rows:
            continue
        ids = rows.column("vec_id").to_numpy()
        sent, _ = _matrix(rows.column("v").combine_chunks(), shape["w"])
        by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        tops = _gather(vectors, ids, sent, k, lists).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        cuts = tops.groupBy("q").agg(F.min("score").alias("cut"), F.count("*").alias("n")).filter(F.col("n") == k).collect()  # a row a query
        least = [NO_CUT] * len(ids)
        for row in cuts:
            least[row["q"]] = row["cut"] if row["cut"] > -(1 << 63) else NO_CUT
        best = _collect(vectors, ids, sent, spark.sparkContext.broadcast(least), k, lists)
        ranked = best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids)), pa.int32()), "query_id": pa.array(ids)}))
        part = ranked.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score")  # as many names as the block has queries
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
