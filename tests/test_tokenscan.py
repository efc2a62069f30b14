import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.operators import keyword, tokenscan

WORDS = ["alpha", "beta", "gamma", "delta", "state", "of", "art", "x1", "zeta"]


def corpus(spark, copies=False):
    rng = random.Random(7)
    rows = [(i, i // 2, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))) for i in range(120)]
    rows += [(200, 100, None), (201, 100, ""), (202, 101, "state of the art state of the art state")]
    return spark.createDataFrame(rows + (rows[:9] if copies else []), "chunk_id long, document_id long, text string")


QUERIES = [(1, "alpha beta beta"), (2, "state-of-the-art gamma"), (3, "zeta NOT alpha OR x1 AND delta"), (4, '"of art" NOT "alpha beta"'), (5, "nowhere"), (6, "art-of-state x1-x1 delta")]


@pytest.mark.parametrize("copies, columns", [(False, []), (True, ["file_type", "doc_id"])])
def test_one_pass_equals_lookups(spark, monkeypatch, copies, columns):
    """The pass over token lists and the lookups in the postings give the same rows, in blocks of queries too."""
    index = keyword.build_index(corpus(spark, copies), stem=False)
    queries = spark.createDataFrame(QUERIES, "query_id long, q string")
    if copies:
        queries = queries.filter("query_id in (1, 3, 5)")  # phrases under one id twice have no defined count
    docs = spark.createDataFrame([(d, ["a", "b"][d % 2]) for d in range(60)], "document_id long, file_type string")
    if columns:
        queries = queries.withColumn("file_type", F.when(F.col("query_id") % 2 == 0, "a")).withColumn("doc_id", F.when(F.col("query_id") == 3, 4).otherwise(0).cast("long"))
    got = {}
    for few, block in ((1000, 256), (0, 256), (0, 2)):
        monkeypatch.setattr(keyword, "FEW_PHRASES", few)
        monkeypatch.setattr(keyword, "SCAN_QUERIES", block)
        rows = keyword.bm25_search(queries, index, docs, 7)
        got[few, block] = sorted((r["query_id"], r["rnk"], r["chunk_id"], r["document_id"], round(r["score"], 8)) for r in rows.collect())
    assert got[1000, 256] == got[0, 256] == got[0, 2] and got[0, 2]


def test_boolean_and_phrases_in_one_pass(spark, monkeypatch):
    index = keyword.build_index(corpus(spark), stem=False)
    asked = spark.createDataFrame(
        [(1, ["alpha"], ["beta", "state-of"], ["zeta"]), (2, [], ["x1", "art"], []), (3, [], [], ["alpha"]), (4, ["state-of-the-art"], [], []), (5, ["nowhere"], ["alpha"], [])],
        "query_id long, all_of array<string>, any_of array<string>, none_of array<string>")
    phrases = spark.createDataFrame([(" ".join(p), p) for p in (["alpha", "beta"], ["state", "of", "the", "art"], ["art", "art"], ["x1", "nowhere"])], "phrase string, tokens array<string>")
    got = []
    for few in (1000, 0):
        monkeypatch.setattr(keyword, "FEW_PHRASES", few)
        got.append((sorted(map(tuple, keyword.boolean_match(asked, index).collect())), sorted(map(tuple, keyword.phrase_matches(phrases, index).collect()))))
    assert got[0] == got[1] and all(got[0])


def test_many_phrases_write_no_postings(spark, monkeypatch):
    """A search of many phrases neither writes postings nor forms a row per posting."""
    monkeypatch.setattr(keyword, "FEW_PHRASES", 0)
    index = keyword.build_index(corpus(spark), stem=False)
    found = keyword.bm25_search(spark.createDataFrame(QUERIES[:1], "query_id long, q string"), index, limit=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert callable(index.stored) and "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1
    assert index.postings.agg(F.sum("tf")).first()[0] == index.n_tokens


def test_overlapping_phrases():
    import pyarrow as pa

    counter = tokenscan.PhraseCounter([["a", "a"], ["a", "a", "b"], ["b"]])
    rows, phrases, times = counter.counts(pa.array([["a", "a", "a", "b"], None, [], ["b", "a"], ["a", "c", "a"]]))
    assert list(zip(rows.tolist(), phrases.tolist(), times.tolist())) == [(0, 0, 2), (0, 1, 1), (0, 2, 1), (3, 2, 1)]


def test_ranking_of_many_phrases_holds_only_the_cells_that_are_asked_for(spark, monkeypatch):
    """Queries by the block and all at once give the same rows; of the phrases' weights only those of the queries that ask are held, and no postings are written."""
    monkeypatch.setattr(keyword, "FEW_PHRASES", 0)
    queries = spark.createDataFrame(QUERIES + [(7, "alpha alpha state-of"), (8, '"art of" OR zeta')], "query_id long, q string")
    got = []
    for block, cells in ((2048, 1 << 21), (2, 50)):
        monkeypatch.setattr(keyword, "RANK_QUERIES", block)
        monkeypatch.setattr(tokenscan, "CELLS", cells)
        index = keyword.build_index(corpus(spark), stem=False)
        found = keyword.bm25_search(queries, index, limit=9).collect()
        assert callable(index.stored)
        got.append(sorted((r["query_id"], r["rnk"], r["chunk_id"], round(r["score"], 8)) for r in found))
    assert got[0] == got[1] and {q for q, *_ in got[0]} >= {1, 2, 3, 6, 7}
    weights = tokenscan.Weights([1, 0, 1], [2, 0, 0], [5.0, 2.0, 3.0], 3, 4)
    scores = weights.scores(np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([1.0, 0.5, 2.0]), 2)
    assert len(weights.value) == 3 and scores.tolist() == [[3.5, 6.0], [0.0, 0.0], [2.5, 10.0], [0.0, 0.0]]
