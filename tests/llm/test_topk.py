import math
import random

import numpy as np
import pytest

from quirefold.llm import topk

SCHEMA = "vec_id long, embedding array<double>, extra string, score string, rank string, q string"


def rows_of(n, width, seed=3):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) for _ in range(width)]) for k in range(n)]
    rows += [(n, rows[0][1]), (n + 1, [0.0] * width), (n + 2, [1e-9] * width), (n + 3, None), (n + 4, [None] * width), (n + 5, [math.nan] * width)]
    rows += [(n + 6, [math.inf] + [0.0] * (width - 1)), (50, rows[7][1]), rows[8], (0, rows[0][1]), (None, rows[1][1])]
    return [(*r, "e", "s", "r", "q") for r in rows]


def brute(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,width,lists,block_bytes", [(300, 16, 4, 1 << 20), (120, 5, 3, 200), (4, 8, 4, 1 << 20), (60, 3, 8, 1 << 20)])
def test_against_brute_force(spark, n, width, lists, block_bytes):
    rows = rows_of(n, width)
    vectors = topk.whole_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5))
    if n > 50:  # one id with two vectors asks twice; each answer is checked by itself
        rows = [r for r in rows if not (r[0] == 50 and r[1] != rows[50][1])]
        vectors = topk.whole_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5))
    found = topk.top_k(vectors, vectors.filter("vec_id % 25 = 0"), 5, lists, block_bytes)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, 5, 25)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(k, [float(rng.randrange(-(1 << 40), 1 << 40)) for _ in range(4)], "", "", "", "") for k in range(30)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, SCHEMA), scale=1)
    found = topk.top_k(vectors, vectors.filter("vec_id = 3"), 30)
    want = sorted(((-sum(int(a) * int(b) for a, b in zip(rows[3][1], r[1])), r[0]) for r in rows if r[0] != 3))
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    assert sorted(r["score"] for r in found.collect()) == sorted(clip(-s) for s, _ in want)


def test_empty(spark):
    none = topk.whole_vectors(spark.createDataFrame([], SCHEMA))
    assert topk.top_k(none, none, 5).count() == 0
    assert topk.top_k(none, none, 5).columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("cut", [-1e30, 0.0, 30000.0, 60000.0])
def test_pairs_below_the_cutoff_are_dropped_early(cut):
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda m: np.floor(256 * m / np.linalg.norm(m, axis=1)[:, None]))(rng.normal(size=(n, 64)))
    queries, vectors = unit(40), unit(3000)
    vectors[:40] = queries
    blocks = topk._by_norm(queries, 4)
    q, column, score, done = topk.resolve(queries, vectors, blocks, np.full(40, cut))
    total = queries @ vectors.T
    want = {(a, b, total[a, b]) for a, b in zip(*np.nonzero(total >= cut))}
    assert set(zip(q.tolist(), column.tolist(), score.tolist())) == want and len(q) == len(want)
    share = done / (total.size * 64)
    assert share <= 1 and (cut < 30000 or share < 0.8) and (cut < 60000 or share < 0.55)
