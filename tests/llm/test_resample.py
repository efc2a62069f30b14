import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirefold.llm import resample
from tests.llm.helpers import SCHEMA, clashing, frame, odd_documents, prose

WORD = re.compile("[^\x00-/:-`{-\x7f]+")


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[k:k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, percent=10, buckets=10000, longest=1, seed=2024, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    parts = [features(r[1], longest) for r in rows]
    s = Counter(bucket(f) for _, fs in parts for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    out = []
    for r, (n, fs) in zip(rows, parts):
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([r[0], len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    order = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for rank, x in enumerate(order[: len(order) * percent // 100], 1):
        x[4] = rank
    return sorted((str(x[:5]) for x in out))


def got(found):
    return sorted(str([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in found.collect())


@pytest.mark.parametrize("percent, longest, buckets", [(10, 1, 10000), (60, 2, 997), (100, 3, 10000), (0, 1, 50)])
def test_odd_documents_against_brute_force(spark, percent, longest, buckets):
    rows = odd_documents()
    target = [prose(random.Random(9), 30), None, "", "alpha alpha beta"]
    docs = clashing(frame(spark, rows))
    found = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, longest=longest, buckets=buckets, min_words=5)
    assert got(found) == brute(rows, target, percent, buckets, longest, min_words=5)


def test_ties_and_hot_ids(spark):
    """A third of all rows repeat one id and text; exactly the share is drawn and ranks have no gap."""
    rng = random.Random(2)
    same = prose(rng, 4)
    rows = [(7, same, "en", "a", 0)] * 150 + [(100 + k, prose(rng, 3), "en", "a", 0) for k in range(300)]
    target = spark.createDataFrame([(same,)], "text string")
    found = resample.resample(frame(spark, rows).repartition(13), target, 30)
    assert got(found) == brute(rows, [same], 30)
    assert sorted(r["rank"] for r in found.filter("rank is not null").collect()) == list(range(1, 136))


@pytest.mark.parametrize("cuts", [1, 2, 15])
def test_bisection(spark, cuts):
    rng = random.Random(cuts)
    for _ in range(2):
        values = [rng.choice([rng.randrange(-50, 50), rng.randrange(-(10**6), 10**6), 3]) for _ in range(60)]
        rows = spark.createDataFrame([(v,) for v in values], "v long")
        for want in (1, 23):
            assert resample.highest_cut(rows, F.col("v"), want, cuts) == sorted(values, reverse=True)[want - 1]


def test_sample_returns_whole_rows(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, 3), "en", "a", k) for k in range(60)]
    docs = clashing(frame(spark, rows))
    target = spark.createDataFrame([(rows[5][1],)], "text string")
    drawn = resample.sample(docs, target, 20)
    assert drawn.schema == docs.schema
    ids = {r["doc_id"] for r in resample.resample(docs, target, 20).filter("rank is not null").collect()}
    assert {r["doc_id"]: r["text"] for r in drawn.collect()} == {k: rows[k][1] for k in ids} and len(ids) == 12


def test_draw_moves_towards_the_target(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 5) if k % 4 else " ".join(rng.choice(["red", "green", "blue", "ash"]) for _ in range(60)), "en", "a", 0) for k in range(200)]
    target = spark.createDataFrame([("red green blue ash " * 50,)], "text string")
    ids = [r["doc_id"] for r in resample.resample(frame(spark, rows), target, 20).filter("rank is not null").collect()]
    assert sum(k % 4 == 0 for k in ids) >= 36


def test_long_text_and_empty_tables(spark):
    rows = [(1, prose(random.Random(1), 5000), "en", "a", 0), (2, prose(random.Random(2), 3), "en", "a", 0)]
    none, some = spark.createDataFrame([], SCHEMA), frame(spark, rows)
    assert got(resample.resample(some, some, 50)) == brute(rows, [r[1] for r in rows], 50)
    assert got(resample.resample(some, none, 50)) == brute(rows, [], 50)
    assert resample.resample(none, some).count() == resample.sample(none, some).count() == 0
