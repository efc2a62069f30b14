"""Segments of the keyword index, block-max search and NEAR."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import blockmax, keyword, segments

VOCABULARY = [f"w{k}" for k in range(60)] + ["rare", "scarce", "alpha", "beta"]


@pytest.fixture(autouse=True)
def few_folders(monkeypatch):
    monkeypatch.setattr(keyword, "FOLDERS", 3)


def chunk_rows(spark, ids, seed=0, seqs=2):
    rows = []
    for k in ids:
        rng = random.Random(1000 * seed + k)
        for seq in range(seqs):
            words = [VOCABULARY[min(len(VOCABULARY) - 1, int(rng.expovariate(0.07)))] for _ in range(rng.randrange(3, 25))]
            rows.append(((k << 20) + seq, k, seq, " ".join(words)))
    return spark.createDataFrame(rows, "chunk_id long, document_id long, seq int, text string")


def questions(spark, n=12, seed=5):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(1, 6)))) for k in range(n)]
    return spark.createDataFrame(rows + [(90, "w1 AND w2"), (91, '"w1 w0"'), (92, "w0-w1 w3"), (93, "nothing"), (94, "...")], "query_id long, q string")


def listed(hits):
    return sorted((r["query_id"], r["rnk"], r["chunk_id"], round(r["score"], 6)) for r in hits.collect())


def same_as_rebuilt(spark, index, chunks):
    found, fresh = segments.searchable(index), keyword.build_index(chunks, index.stemmed)
    assert (found.n_chunks, found.n_tokens) == (fresh.n_chunks, fresh.n_tokens)
    assert sorted(map(tuple, found.terms.collect())) == sorted(map(tuple, fresh.terms.collect()))
    asked = questions(spark)
    assert listed(keyword.bm25_search(asked, found, limit=10)) == listed(keyword.bm25_search(asked, fresh, limit=10))


def test_append_delete_merge_equal_a_rebuilt_index(spark):
    index = segments.create(chunk_rows(spark, range(40)), False, 2)
    live = chunk_rows(spark, range(40))
    held = index
    for start in (40, 60, 64, 68):
        new = chunk_rows(spark, range(start, start + 4))
        index, live = segments.append(index, new), live.union(new)
    doomed = spark.createDataFrame([(k,) for k in (3, 41, 62, 500)], "document_id long")
    index, live = segments.delete(index, doomed), live.join(doomed, "document_id", "left_anti")
    same_as_rebuilt(spark, index, live)
    assert segments.delete(index, doomed).segments == index.segments  # gone already
    before = len(index.segments)
    merged = segments.merge(index)
    assert len(merged.segments) < before and sum(s.live for s in merged.segments) == live.count()
    same_as_rebuilt(spark, merged, live)
    again = chunk_rows(spark, [3, 41], seed=9)  # ids come back with other texts: tombstones hit the old segment only
    same_as_rebuilt(spark, segments.append(merged, again), live.unionByName(again))
    same_as_rebuilt(spark, held, chunk_rows(spark, range(40)))  # a held index keeps its state
    index.close()


def test_odd_steps(spark):
    none = chunk_rows(spark, [])
    index = segments.append(segments.create(none, False, 2), none)
    assert index.segments == [] and segments.merge(index).segments == []
    with pytest.raises(ValueError, match="no chunk"):
        segments.searchable(index)
    index = segments.append(index, chunk_rows(spark, [1, 2]))
    everything = spark.createDataFrame([(1,), (2,)], "document_id long")
    emptied = segments.merge(segments.delete(index, everything))
    assert emptied.segments == [] and segments.delete(emptied, everything).segments == []
    same_as_rebuilt(spark, segments.append(emptied, chunk_rows(spark, [2])), chunk_rows(spark, [2]))


def test_merges_are_by_size(spark):
    sized = lambda *sizes: [segments.Segment(k, n, n) for k, n in enumerate(sizes)]
    due = segments._due(sized(1000, 10, 11, 12, 900, 13, 2), 4, 0.5)
    assert [s.n_chunks for s in due] == [10, 11, 12, 13]
    assert segments._due(sized(1000, 10, 11, 2), 4, 0.5) == []
    assert segments._due([segments.Segment(0, 10, 50, 6, 30), segments.Segment(1, 10, 50, 5, 25)], 4, 0.5)[0].number == 0


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_searches_shuffle_no_matches(spark, monkeypatch, bound):
    """Neither over several segments nor with tombstones, sent or (beyond the bound) met in their buckets."""
    index = segments.create(chunk_rows(spark, range(30)), False, 4)
    index = segments.append(index, chunk_rows(spark, range(30, 50)))
    index = segments.delete(index, spark.createDataFrame([(3,), (31,)], "document_id long"))
    monkeypatch.setattr(segments, "broadcast_if_small", lambda df, _=0: F.broadcast(df) if bound else df.hint("merge"))
    found = segments.searchable(index)
    phrases = keyword.phrases_of(keyword.query_terms(questions(spark).filter("query_id < 90")), False)
    plan = keyword.phrase_hits(phrases, found)._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "Exchange hashpartitioning" not in plan
    assert ("BroadcastHashJoin [chunk_id" in plan) == bool(bound) and ("SortMergeJoin [chunk_id" in plan) != bool(bound)


# --- block-max ------------------------------------------------------------------------------------

@pytest.mark.parametrize("documents, parts", [(1, 1), (4, 8)])
def test_block_max_equals_full_scoring(spark, documents, parts):
    chunks = chunk_rows(spark, range(150), seqs=3).unionByName(chunk_rows(spark, range(200, 210), seed=0, seqs=3))
    copies = chunk_rows(spark, range(5), seqs=3).withColumn("document_id", F.col("document_id") + 300).withColumn("chunk_id", F.col("chunk_id") + (300 << 20))
    index = keyword.build_index(chunks.unionByName(copies), stem=False)  # copies tie with their originals
    blocks = blockmax.build(index, documents, parts)
    for limit in (3, 2000):
        found = blockmax.search(questions(spark), blocks, limit)
        assert listed(found.hits) == listed(keyword.bm25_search(questions(spark), index, limit=limit))
        assert all(0 < r["scored"] <= r["postings"] for r in found.work.collect())


def test_block_max_skips_most_postings_of_the_passages(spark):
    from quirefold.plans import corpora
    from quirefold.plans.search_queries import doc_chunks

    sf = "/root/testdata/sf0.01"
    asked = corpora.passages(spark, sf)
    index = keyword.build_index(doc_chunks(spark, sf), stem=False)
    found = blockmax.search(asked, blockmax.build(index), 10)
    work = found.work.agg(F.sum("postings").alias("postings"), F.sum("scored").alias("scored")).first()
    assert work["scored"] < 0.5 * work["postings"]
    assert listed(found.hits) == listed(keyword.bm25_search(asked, index, limit=10))


def test_many_wanted_blocks_move_no_posting(spark, monkeypatch):
    """Beyond the bound of a broadcast the questions of a block go to its bucket; the index's own postings are not written a second time."""
    index = keyword.build_index(chunk_rows(spark, range(150), seqs=3), stem=False)
    want = listed(keyword.bm25_search(questions(spark), index, limit=20))
    index = keyword.build_index(chunk_rows(spark, range(150), seqs=3), stem=False)
    monkeypatch.setattr(blockmax, "BROADCAST_BYTES", 0)
    blocks = blockmax.build(index, 2, 2)
    assert callable(index.stored)
    terms = spark.createDataFrame([(1, "w1", 1, 0.5), (2, "w1", 2, 0.5), (2, "w3", 1, 0.7)], "query_id long, term string, times long, idf double")
    wanted = blocks.postings.filter("block % 3 > 0").select("block").distinct().crossJoin(spark.range(1, 3).withColumnRenamed("id", "query_id"))
    found = blockmax._scored(blocks, terms, wanted.filter("query_id = 1 or block % 2 = 0"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    left = plan[: plan.index("block_postings")]
    assert "ShuffledHashJoin" in plan and "Exchange" not in left
    assert {(r["query_id"], blocks.postings.filter(F.col("chunk_id") == r["chunk_id"]).first()["block"] % 2) for r in found.limit(12).collect()} <= {(1, 0), (1, 1), (2, 0)}
    assert listed(blockmax.search(questions(spark), blocks, 20).hits) == want


def test_long_documents_are_many_blocks(spark):
    rows = spark.range(100_000).select(blockmax.block_of(F.col("id")).alias("b")).groupBy("b").count()
    assert rows.agg(F.max("count")).first()[0] == blockmax.CHUNKS_PER_PART


# --- NEAR ------------------------------------------------------------------------------------------

def brute_near(texts, terms, distance):
    out = []
    for k, text in texts:
        words = text.split()
        places = [[p for p, w in enumerate(words) if w == t] for t in dict.fromkeys(terms)]
        if not places or not all(places):
            continue
        spans = [max(c) - min(c) for c in itertools.product(*places)]
        if min(spans) - 1 <= distance:
            out.append((k, min(spans)))
    return out


def test_near_against_all_combinations(spark):
    chunks = chunk_rows(spark, range(60), seqs=1)
    texts = [(r["chunk_id"], r["text"]) for r in chunks.collect()]
    groups = [(1, ["w0", "w1"], 0), (2, ["w0", "w1", "w2"], 4), (3, ["w3"], 0), (4, ["w1", "w1", "w4"], 30), (5, [], 5), (6, ["w0", "missing"], 50), (7, ["w2-w5"], 3)]
    found = keyword.near_matches(spark.createDataFrame(groups, "query_id long, terms array<string>, distance int"), keyword.build_index(chunks, stem=False))
    want = [(q, k, span) for q, terms, d in groups for k, span in brute_near(texts, [w for t in terms for w in t.split("-")], d)]
    assert sorted((r["query_id"], r["chunk_id"], r["span"]) for r in found.collect()) == sorted(want) and len(want) > 20


def test_tables_leave_the_catalogue(spark):
    from quirefold import session

    session.release_tables(spark)
    index = keyword.build_index(chunk_rows(spark, range(3)), stem=False)
    parts = segments.create(chunk_rows(spark, range(3)), False, 2)
    names = {t.name for t in spark.catalog.listTables() if t.name.startswith("quirefold_")}
    assert {t for t in names if t.startswith(("quirefold_tokens", "quirefold_postings"))} and index.n_chunks == 6
    parts.close()
    assert session.release_tables(spark) >= 3 and session.release_tables(spark) == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quirefold_") and t.name in names]
