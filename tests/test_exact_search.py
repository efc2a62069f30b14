"""Substring search by runs of letters and nearest vectors by pivots, against scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.operators import pivots, substring, vectors

LETTERS = "abcABC éß漢1 "


def places(spark, n=400, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 12))) for _ in range(n // 2)]
    texts += ["Hot Text"] * (n // 3) + [None, "", "ab", "%_%", "a'b\"c\\d"]
    return texts, spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")


@pytest.mark.parametrize("block", [500, 2])
def test_substrings_equal_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "FOLDERS", 3)
    monkeypatch.setattr(substring, "SHORT_BLOCK", block)
    texts, rows = places(spark)
    rng = random.Random(2)
    asked = ["hot", "T TE", "x", "", "ab", "é", "漢1", "not there", "%_%", "'b\"", None, "\\d", "  ", "text"]
    asked += ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 5))) for _ in range(25)] + ["hot"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    found = substring.search(queries, substring.build(rows))
    assert sorted(found.columns) == ["id", "query_id", "text"]
    want = [(k, i) for k, q in enumerate(asked) if q is not None for i, t in enumerate(texts) if t is not None and q.lower() in t.lower()]
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == sorted(want)


def test_lookups_read_folders_and_row_groups_of_the_run(spark):
    _, rows = places(spark, 60)
    index = substring.build(rows)
    one = spark.createDataFrame([("hot t",)], "needle string")
    plan = substring._pruned(index.grams, one.select(F.substring("needle", 1, 3).alias("gram")), "gram")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "folder#" in plan and "EqualTo(gram,hot)" in plan
    plan = substring.search(spark.createDataFrame([(1, "hot t")], "query_id long, q string"), index)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(low,hot text)" in plan


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(1, "abc"), (2, "a")], "query_id long, q string")
    assert substring.search(asked, substring.build(none)).count() == 0
    assert substring.search(asked.limit(0), substring.build(places(spark, 30)[1])).count() == 0


def frame(spark, matrix):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(matrix)], "chunk_id long, embedding array<float>")


def same(spark, matrix, asked, k, **options):
    held = frame(spark, matrix)
    queries = frame(spark, asked).withColumnRenamed("chunk_id", "query_id")
    found = pivots.search(queries, pivots.build(held, **options), k)
    want = vectors.knn_batch(queries, held, k)
    listed = lambda df: sorted((r["query_id"], r["rnk"], r["chunk_id"], round(r["score"], 7)) for r in df.collect())
    assert listed(found.hits) == listed(want)
    work = found.work.agg(F.sum("vectors").alias("v"), F.sum("scored").alias("s")).first()
    return 1 - work["s"] / work["v"]


def test_pivots_equal_a_scan(spark):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((300, 6))
    matrix[50:150] = matrix[7]  # a third of the vectors are copies: ties at every rank
    matrix[20] = matrix[21] = 0
    asked = np.concatenate([matrix[:12], rng.standard_normal((4, 6)), np.zeros((1, 6)), -matrix[7:8], matrix[30:31] * 40])
    for k, options in ((1, {}), (5, {"pivots": 3, "block_rows": 7}), (120, {"pivots": 1, "block_rows": 11}), (1000, {"block_rows": 50})):
        same(spark, matrix, asked, k, **options)


def test_pivots_skip_most_blocks_of_grouped_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivots, "QUERY_BYTES", 4000)  # several blocks of questions
    rng = np.random.default_rng(4)
    matrix = np.repeat(rng.standard_normal((40, 16)), 50, axis=0) + 0.05 * rng.standard_normal((2000, 16))
    assert same(spark, matrix, matrix[::40], 10, block_rows=32) > 0.5


def test_pivots_without_vectors_or_questions(spark):
    none = np.zeros((0, 3))
    assert pivots.search(frame(spark, np.eye(3)).withColumnRenamed("chunk_id", "query_id"), pivots.build(frame(spark, none)), 2).hits.count() == 0
    assert pivots.search(frame(spark, none).withColumnRenamed("chunk_id", "query_id"), pivots.build(frame(spark, np.eye(3))), 2).hits.count() == 0
    assert same(spark, np.zeros((5, 3)), np.eye(3), 2) == 0


def test_many_queries_in_few_cells(spark):
    """Only scores that reach a query's floor are looked at one by one, in blocks of queries and of vectors; ties go by id."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 8))
    base[100:130] = base[99]
    units = base / np.linalg.norm(base, axis=1)[:, None]
    top = vectors._TopK(np.arange(700), units, 5)
    calls, plain = 0, vectors._best
    def counted(*a):
        nonlocal calls
        calls += 1
        return plain(*a)
    vectors._best = counted
    try:
        for lo in range(0, 700, 10):
            top.add(np.arange(lo, lo + 10), units[lo : lo + 10])
    finally:
        vectors._best = plain
    scores = np.round(units @ units.T, 9)
    assert [d.tolist() for _, d in top.best] == [np.lexsort((np.arange(700), -row))[:5].tolist() for row in scores]
    assert calls < 700 * 70 / 2


def test_many_queries_of_the_same_table(spark):
    """Vectors that are their own queries, beyond the bound: each block of queries meets all vectors; repeated ids and ties as in one block."""
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((400, 6))
    matrix[50:120] = matrix[7]
    matrix[20] = 0
    held = frame(spark, matrix).unionByName(frame(spark, matrix[:30]))
    asked = held.select(F.col("chunk_id").alias("query_id"), "embedding")
    for k in (3, 90):
        got = [sorted((r["query_id"], r["rnk"], r["chunk_id"], round(r["score"], 7)) for r in vectors.knn_batch(asked, held, k, **options).collect())
               for options in ({}, {"resident_bytes": 6000, "block_bytes": 3000})]
        assert got[0] == got[1] and len(got[0]) == 400 * k


def test_single_precision_leaves_no_neighbour_out(spark):
    """Scores that differ by less than single precision can tell are ranked by their exact values."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal(32)
    matrix = base + 1e-5 * rng.standard_normal((3000, 32))
    units = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    top = vectors._TopK(np.arange(40), units[:40], 7)
    for lo in range(0, 3000, 500):
        top.add(np.arange(lo, lo + 500), units[lo : lo + 500])
    scores = np.round(np.einsum("ik,jk->ij", units[:40], units), 9)
    assert [d.tolist() for _, d in top.best] == [np.lexsort((np.arange(3000), -row))[:7].tolist() for row in scores]


def test_totals_of_substrings_meet_a_place_once_per_needle(spark):
    """Totals equal those of the listed places; questions that ask the same text do not multiply the places that are joined."""
    texts, rows = places(spark)
    rows = rows.withColumn("kind", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    asked = [(k, q) for k, q in enumerate(["hot", "HOT", "t te", "ab", "", None, "nowhere", "hot"])] + [(0, "hot"), (0, "ab")]
    queries = spark.createDataFrame(asked, "query_id long, q string")
    index = substring.build(rows.unionByName(rows.limit(40)))
    totals = {"n": ("count", F.lit(1)), "low_id": ("min", F.col("id")), "high_id": ("max", F.col("id")), "total": ("sum", F.col("id"))}
    found = substring.search(queries, index, ["kind"], totals)
    want = substring.search(queries, index).groupBy("query_id", "kind").agg(
        F.count("*").alias("n"), F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.sum("id").alias("total"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, map(tuple, want.select(found.columns).collect()))) and found.count() > 10
    many = spark.range(500).select("id", F.lit("hot").alias("q")).withColumnRenamed("id", "query_id")
    assert "Scan parquet" in (plan := substring.search(many, index, [], totals)._jdf.queryExecution().executedPlan().toString()) and "low#" not in plan
    alike = substring.build(spark.range(600).select(F.format_string("pay invoice %d now", "id").alias("text")))
    assert alike.grams.count() < 600 * 16 / 3


def test_pivots_for_many_tiles_of_questions(spark, monkeypatch):
    """Questions in several tiles and groups of blocks; bounds in single precision hold for every vector of a block, with the slack that is added."""
    monkeypatch.setattr(pivots, "GROUP", 3)
    monkeypatch.setattr(pivots, "SEED_ROWS", 500)
    rng = np.random.default_rng(7)
    matrix = np.repeat(rng.standard_normal((13, 12)), 90, axis=0) + 0.3 * rng.standard_normal((1170, 12))
    matrix[40:70], matrix[600] = matrix[39], 0
    assert same(spark, matrix, matrix, 6, block_rows=16) > 0.1
    index = pivots.build(frame(spark, matrix), block_rows=16)
    units = matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)[:, None]
    batch = index.blocks.toArrow().combine_chunks().to_batches()[0]
    far = pivots._distances(units, index.pivots).astype(np.float32)
    bounds = pivots._Bounds(batch, far, ~units.any(axis=1))
    for at in range(0, len(units), pivots.TILE):
        bound = bounds.of(at) + pivots.SLACK + pivots.SINGLE
        for b, ids in enumerate(batch.column("ids").to_pylist()):
            assert (bound[:, b] >= (units[at : at + pivots.TILE] @ units[ids].T).max(axis=1)).all()
