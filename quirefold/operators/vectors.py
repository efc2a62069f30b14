"""Embeddings and exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quirefold.functions import fixed_values as fv
from quirefold.operators.ranking import SCORE_DIGITS, stable, top_k
from quirefold.session import measured_bytes

QUERY_BLOCK_BYTES = 64 << 20
VECTOR_BLOCK_BYTES = 64 << 20
#: Up to this size queries travel with the tasks; beyond it, it is the smallest block of queries, as the vectors are sent once per block.
GRID_BYTES = 8 << 20
#: Queries and vectors that are multiplied at once, scores computed again at once, and candidates held before they are ranked.
_TILE = 1 << 9
_VECTORS = 1 << 11
_EXACT = 1 << 15
_HELD = 1 << 20
_TIE = 4 * 10.0 ** -SCORE_DIGITS


def hash_vector(text: Column, dim: int = 8) -> Column:
    """Deterministic unit vector from the SHA-256 bytes of the text, repeated up to ``dim``."""
    from quirefold.functions.text import let

    def bytes_of(digest: Column) -> Column:
        cell = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), cell)

    def unit(raw: Column) -> Column:
        length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return let(F.when(length == 0, 1.0).otherwise(length), lambda n: F.transform(raw, lambda x: x / n))

    return let(F.sha2(text, 256), lambda h: let(bytes_of(h), unit))


def query_vector(q: Column, dim: int = 8) -> Column:
    """Queries carry the instruction prefix; passages do not."""
    return hash_vector(F.concat(F.lit(fv.QUERY_INSTRUCTION), q), dim)


def embed_passages(chunks: DataFrame, dim: int = 8) -> DataFrame:
    return chunks.select("chunk_id", hash_vector(F.col("embed_text"), dim).alias("embedding"))


def embed_with(make_model, text: Column) -> Column:
    """Model seam: ``make_model()`` runs once per Python worker and returns texts -> vectors."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for batch in texts:
            yield pd.Series([list(map(float, v)) for v in model(batch.tolist())])

    return F.pandas_udf(batches, "array<float>")(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in the JVM; a zero vector counts as length one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = lambda x: F.sqrt(dot(x, x))
    safe = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (safe(length(a)) * safe(length(b)))


def knn_one(vectors: DataFrame, query: list[float], k: int, key: str = "chunk_id") -> DataFrame:
    """Best ``k`` vectors for one query vector, as an ordered top-k without a shuffle of the table."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col("embedding"), q).alias("score")).orderBy(stable(F.col("score")).desc(), F.asc(key)).limit(k)


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), -1)
    length = np.linalg.norm(m, axis=1)
    length[length == 0] = 1.0
    return m / length[:, None]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of (rounded score descending, id ascending); ties at the edge stay in view."""
    rounded = np.round(scores, SCORE_DIGITS)
    if len(scores) > k:
        keep = rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]
        scores, rounded, ids = scores[keep], rounded[keep], ids[keep]
    order = np.lexsort((ids, -rounded))[:k]
    return scores[order], ids[order]


def _cut(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first k of every row in the order of ``_best``, sorted by row, and the rank (from 0) of each."""
    place = (rows << 32) - np.rint(scores * 10.0 ** SCORE_DIGITS).astype(np.int64)  # scores are cosines: one number orders rows and rounded scores
    order = np.argsort(place)
    place = place[order]
    same = place[1:] == place[:-1]
    if same.any():
        tied = np.append(same, False) | np.insert(same, 0, False)
        order[tied] = order[tied][np.lexsort((ids[order[tied]], place[tied]))]
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    keep = rank < k
    order = order[keep]
    return rows[keep], scores[order], ids[order], rank[keep]


class _TopK:
    """Running best k per query over blocks of vectors.

    Scores are first computed in single precision, whose error has a bound for unit vectors; those that can reach a query's floor are
    computed again in double precision, and only these are ranked, for a tile of queries at a time.
    """

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        """``least``: scores that each query's last place is known to have or to exceed."""
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.single = queries.astype(np.float32)
        self.error = 1.1 * 2.0 ** -24 * (queries.shape[1] + 8) if queries.ndim == 2 else 0.0
        self.floor = np.full(len(query_ids), -np.inf) if least is None else least - _TIE  # what a score has to reach; the rounded ties of the last place do
        none = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.kept = {at: none for at in range(0, len(query_ids), _TILE)}  # by tile: rows, scores and ids, sorted by row and rank
        self.waits = 0 if least is None else 8 * k * _TILE  # a good floor needs no ranking after every block
        self.found: dict[int, list] = {at: [] for at in self.kept}
        self.held = dict.fromkeys(self.kept, 0)

    @property
    def best(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        self._settle()
        for at, (rows, scores, ids) in self.kept.items():
            ends = np.searchsorted(rows, np.arange(at, min(at + _TILE, len(self.query_ids)) + 1))
            out += [(scores[a:b], ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        return out

    def _settle(self) -> None:
        for at in self.kept:
            self._merge(at)

    def _merge(self, at: int) -> None:
        if not self.found[at]:
            return
        parts = [self.kept[at], *self.found[at]]
        rows, scores, ids, rank = _cut(*[np.concatenate([p[i] for p in parts]) for i in range(3)], self.k)
        self.kept[at] = rows, scores, ids
        last = rank == self.k - 1
        self.floor[rows[last]] = np.maximum(self.floor[rows[last]], scores[last] - _TIE)
        self.found[at], self.held[at] = [], 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray | None = None) -> None:
        """Score vectors for all queries or those numbered ``own``."""
        single, own = vectors.astype(np.float32), None if own is None else np.sort(own)
        for at in self.kept if own is None else (np.unique(own // _TILE) * _TILE).tolist():
            mine = np.arange(at, min(at + _TILE, len(self.query_ids))) if own is None else own[slice(*np.searchsorted(own, (at, at + _TILE)))]
            if len(mine):
                self._add(at, mine, ids, vectors, single)

    def _add(self, at: int, mine: np.ndarray, ids: np.ndarray, vectors: np.ndarray, single: np.ndarray) -> None:
        asked = self.single[mine]
        for lo in range(0, len(ids), _VECTORS):
            scores = asked @ single[lo : lo + _VECTORS].T
            width = scores.shape[1]
            reach = scores >= (self.floor[mine] - self.error)[:, None]
            if width > self.k and np.count_nonzero(reach) > 4 * self.k * len(mine):
                full = np.flatnonzero(np.count_nonzero(reach, axis=1) > 2 * self.k)
                part = scores[full]
                last = np.partition(part, width - self.k, axis=1)[:, width - self.k].astype(np.float64) - self.error - _TIE
                self.floor[mine[full]] = np.fmax(self.floor[mine[full]], last)
                reach[full] = part >= (self.floor[mine[full]] - self.error)[:, None]
            row, column = np.divmod(np.flatnonzero(reach), width)
            if len(row):
                column += lo
                exact = np.concatenate([
                    np.einsum("ij,ij->i", self.queries[mine[row[a : a + _EXACT]]], vectors[column[a : a + _EXACT]]) for a in range(0, len(row), _EXACT)])
                row = mine[row]
                keep = exact >= self.floor[row]
                self.found[at].append((row[keep], exact[keep], ids[column[keep]]))
                self.held[at] += np.count_nonzero(keep)
                if self.held[at] > _HELD:
                    self._merge(at)
        if self.held[at] > self.waits:
            self._merge(at)

    def rows(self) -> np.ndarray:
        """The number of the query of every row of ``batch``."""
        self._settle()
        return np.concatenate([part[0] for part in self.kept.values()] or [np.empty(0, np.int64)])

    def batch(self, key: str) -> pa.RecordBatch:
        self._settle()
        rows, scores, ids = (np.concatenate([part[i] for part in self.kept.values()] or [np.empty(0, np.int64)]) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.query_ids[rows], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", key, "score"])

    def ranked(self, key: str) -> Iterator[pa.RecordBatch]:
        """The k best of every query id with their rank, if no other task has an id; rows of one id count as one query."""
        self._settle()
        names, group = np.unique(self.query_ids, return_inverse=True)
        repeated = len(names) < len(self.query_ids)
        for rows, scores, ids in [tuple(np.concatenate(x) for x in zip(*self.kept.values()))] if repeated else self.kept.values():
            rows, scores, ids, rank = _cut(group[rows], scores, ids, self.k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[rows], pa.int64()), pa.array(rank + 1, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "rnk", key, "score"])


class _Gathered:
    """Batches of vectors gathered to blocks that grow with what was seen, up to ``most`` rows, so that few blocks are ranked."""

    def __init__(self, most: int, add):
        self.most, self.add, self.seen, self.held, self.rows = max(1, most), add, 0, [], 0

    def put(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.held.append((ids, vectors))
        self.rows += len(ids)
        if self.rows >= min(self.most, max(self.seen, _VECTORS)):
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.add(np.concatenate([i for i, _ in self.held]), np.concatenate([v for _, v in self.held]))
        self.seen, self.held, self.rows = self.seen + self.rows, [], 0


def _knn_resident(queries: DataFrame, vectors: DataFrame, k: int, key: str, block_bytes: int) -> DataFrame:
    """Queries of bounded size travel with the task; the vectors are scanned in place."""
    table = queries.select("query_id", F.col("embedding").cast("array<double>")).toArrow()
    if table.num_rows == 0:
        return vectors.sparkSession.createDataFrame([], f"query_id long, {key} long, score double")
    query_ids, matrix = np.asarray(table["query_id"]), _matrix(table["embedding"])
    block_rows = block_bytes // (8 * max(1, matrix.shape[1]))

    def scan(batches):
        top = _TopK(query_ids, matrix, k)
        blocks = _Gathered(block_rows, top.add)
        for b in batches:
            if b.num_rows:
                blocks.put(np.asarray(b.column(0)), _matrix(b.column(1)))
        blocks.flush()
        yield top.batch(key)

    return vectors.select(F.col(key).cast("long"), "embedding").mapInArrow(scan, f"query_id long, {key} long, score double")


def _knn_grid(queries: DataFrame, vectors: DataFrame, k: int, key: str, query_blocks: int, block_bytes: int) -> DataFrame:
    """(query_id, rnk, key, score) for many queries: a task holds one bounded block of queries and all vectors stream past it.

    All rows of a query id lie in one block, so its ranks are final where they are made and no candidates are shuffled.
    """
    kind = "array<float>" if queries.schema["embedding"].dataType == vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    unit = F.col("embedding").cast(kind).alias("v")
    block = F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")
    asked = queries.select(block.alias("block"), F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("id"), unit)
    held = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col(key).cast("long").alias("id"), unit)
    rows = asked.unionByName(held).repartitionById(query_blocks, F.col("block")).sortWithinPartitions("block", "kind")

    def cell(batches):
        own, top, blocks = [], None, None
        for b in batches:
            n = int(np.count_nonzero(np.asarray(b.column(1)) == 0))
            if n:
                own.append((np.asarray(b.column(2).slice(0, n)), _matrix(b.column(3).slice(0, n))))
            if n < b.num_rows and own:
                if top is None:
                    top = _TopK(np.concatenate([i for i, _ in own]), np.concatenate([m for _, m in own]), k)
                    blocks = _Gathered(block_bytes // (8 * max(1, top.queries.shape[1])), top.add)
                blocks.put(np.asarray(b.column(2).slice(n)), _matrix(b.column(3).slice(n)))
        if top is not None:
            blocks.flush()
            yield from top.ranked(key)

    return rows.mapInArrow(cell, f"query_id long, rnk int, {key} long, score double")


def knn_batch(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id",
              resident_bytes: int = QUERY_BLOCK_BYTES, block_bytes: int = VECTOR_BLOCK_BYTES) -> DataFrame:
    """(query_id, rnk, key, score): exact best ``k`` vectors of every query (query_id, embedding).

    No path forms all pairs. The size of the query side is measured: within the bound it goes to every task, which keeps k
    candidates per query; beyond it a task holds one bounded block of queries and ranks all vectors for it, in blocks of ``block_bytes``.
    The vectors are then sent once per block of queries: as many blocks as keep the cores busy, and no more than the bounds need.
    """
    size = measured_bytes(queries)
    if size > min(resident_bytes, GRID_BYTES):
        cores, most = queries.sparkSession.sparkContext.defaultParallelism, min(resident_bytes, QUERY_BLOCK_BYTES)
        blocks = min(-(-size // min(resident_bytes, GRID_BYTES)), cores * -(-size // (cores * most)))
        return _knn_grid(queries, vectors, k, key, blocks, block_bytes)
    best = top_k(_knn_resident(queries, vectors, k, key, block_bytes), "query_id", k, [stable(F.col("score")).desc(), F.asc(key)])
    return best.select("query_id", "rnk", key, "score")


def upsert(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace by chunk id; among changes to one id the highest ``version`` wins."""
    last = changes.groupBy("chunk_id").agg(F.max_by("embedding", "version").alias("embedding"))
    return vectors.join(last.select("chunk_id"), "chunk_id", "left_anti").unionByName(last)


def dimension_report(vectors: DataFrame, expected: int) -> DataFrame:
    """One row: smallest and largest stored dimension, and whether all equal ``expected``."""
    return vectors.agg(F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim")).withColumn(
        "matches", F.coalesce((F.col("min_dim") == expected) & (F.col("max_dim") == expected), F.lit(True)))


def assert_dimension(vectors: DataFrame, expected: int) -> None:
    row = dimension_report(vectors, expected).first()
    if not row["matches"]:
        raise ValueError(
            f"vectors of {row['min_dim']} to {row['max_dim']} components are stored, not {expected}: "
            "build all vectors with one model")
