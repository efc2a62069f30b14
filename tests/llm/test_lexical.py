import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quirefold.llm import lexical
from tests.llm.helpers import SCHEMA, WORDS, clashing, frame, odd_documents, prose

TERM = re.compile("[^\x00-/:-@[-`{-\x7f]+")


def term_list(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(rows, items, k):
    """Every question against every document, by the formula."""
    docs = [(r[0], Counter(ts), len(ts)) for r in rows if (ts := term_list(r[1]))]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, counts, _ in docs for t in counts)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for doc_id, counts, n in docs:
            m = 75 + (25 * n * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t in term_list(text) if counts[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(str(item), rank, str(x[3]), -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out)


def got(found):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in found.collect())


def questions(seed=2):
    rng = random.Random(seed)
    made = [(k, " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "7"]) for _ in range(rng.randrange(1, 12)))) for k in range(12)]
    return made + [(20, None), (21, ""), (22, " .,;"), (23, "ümläut É 漢字"), (24, "alpha ALPHA Alpha"), (25, "unknownword"), (None, "beta"), (3, "gamma"), made[0]]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_odd_documents_against_brute_force(spark, k):
    rows, items = odd_documents(), questions()
    found = lexical.search(clashing(frame(spark, rows)), frame(spark, items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as doc_id"), k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(rows, items, k)


def test_many_batches_and_blocks_of_questions(spark, monkeypatch):
    """Bars carried from batch to batch, ties at the k-th place, and questions dealt into many small blocks."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 40)
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(WORDS[:9]) for _ in range(rng.randrange(1, 9))), "en", "a", 0) for k in range(400)]
    rng.shuffle(rows)
    items = [(k, " ".join(rng.choice(WORDS[:10]) for _ in range(rng.randrange(1, 7)))) for k in range(15)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = lexical.search(frame(spark, rows).coalesce(2), frame(spark, items, "item_id long, text string"), 5, block_bytes=300)
        assert got(found) == brute(rows, items, 5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "alpha beta"), ("a", "alpha beta"), (None, "alpha beta"), ("c", "other")], "name string, body string")
    asked = spark.createDataFrame([("q", "beta")], "key string, words string")
    found = lexical.search(docs, asked, 2, "name", "body", "key", "words").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in sorted(found, key=lambda r: r["rank"])] == [("q", 1, "a"), ("q", 2, "b")]


def test_accumulators_are_limited_and_nothing_is_lost():
    rng = np.random.default_rng(1)
    docs, v, k = 5000, 40, 10
    likely = 0.9 / (1 + np.arange(v))[::-1] ** 1.1
    counts = (rng.random((docs, v)) < likely) * rng.integers(1, 4, (docs, v))
    doc, code = np.nonzero(counts)
    n = np.maximum(counts.sum(axis=1), 1)
    lists = lexical.Lists(n, np.bincount(doc, minlength=docs), code, counts[doc, code], docs, int(n.sum()), v)
    df = (counts > 0).sum(axis=0)
    weights = np.array([lexical.term_weight(docs, int(x)) for x in df])
    worth = (10**9 * counts) // (1000 * counts + 12 * (75 + 25 * n * docs // n.sum())[:, None])
    limited = 0
    for _ in range(30):
        own, weight = lexical.plan_terms([(int(t), 1) for t in rng.choice(v, 8, replace=False)], df, weights)
        assert (np.diff(df[own]) >= 0).all()
        want = worth[:, own] @ weight
        at, score, made = lists.best(own, weight, k, 0)
        assert (score == want[at]).all()
        assert set(at) >= set(np.flatnonzero(want > np.partition(want, docs - k)[docs - k]))
        assert len(at) >= k and score.min() == np.partition(want, docs - k)[docs - k]
        limited += made < (want > 0).sum() // 2
    assert limited > 20


def test_long_text_and_empty_tables(spark):
    long = prose(random.Random(5), 4000)
    rows = [(1, long, "en", "a", 0), (2, "alpha beta", "en", "a", 0)]
    items = [(1, "alpha beta gamma7"), (2, long[:2000])]
    asked = frame(spark, items, "item_id long, text string")
    assert got(lexical.search(frame(spark, rows), asked)) == brute(rows, items, 20)
    none = spark.createDataFrame([], SCHEMA)
    assert lexical.search(none, asked).count() == 0
    assert lexical.search(frame(spark, rows), asked.limit(0)).count() == 0
    assert lexical.search(frame(spark, [(1, None, "en", "a", 0)]), asked).count() == 0
