import zlib

import numpy as np

from quirefold.llm import quality
from tests.llm.helpers import clashing, frame, odd_documents

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.scores(docs.join(labels.select("doc_id"), "doc_id"), labels).join(labels, "doc_id").filter("held_out").collect()
    good = np.array([r["score"] for r in rows if r["quality"] == 1])
    bad = np.array([r["score"] for r in rows if r["quality"] == 0])
    assert len(bad) > 50
    assert (good[:, None] > bad[None, :]).mean() > 0.995
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.98


def test_densities_are_those_of_the_shrunk_covariances():
    rng = np.random.default_rng(0)
    x = [rng.standard_normal((300, 4)) @ rng.standard_normal((4, 4)) + c for c in (0, 2)]
    counts = np.array([300.0, 300.0])
    model = quality.fit(counts, np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x]), 0.2, 0.1)
    everything = np.concatenate(x)
    shift, scale = everything.mean(axis=0), everything.std(axis=0)
    z = [(a - shift) / scale for a in x]
    own = [np.cov(a.T, bias=True) for a in z]
    pooled = (own[0] + own[1]) / 2
    point = (everything[7] - shift) / scale
    logs = []
    for c in (0, 1):
        cov = 0.8 * own[c] + 0.2 * pooled
        cov = 0.9 * cov + 0.1 * (np.diag(np.diag(cov)) + 0.01 * np.eye(4)) + 1e-6 * np.eye(4)
        d = point - z[c].mean(axis=0)
        logs.append(-0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1]))
    assert np.isclose(model.score(everything[7:8])[0], 1 / (1 + np.exp(logs[0] - logs[1])))


def test_odd_documents_and_labels(spark):
    rows = odd_documents()
    labels = [(r[0], k % 2, 0, "x") for k, r in enumerate(rows)] + [(3, None, 0, "x"), (4, 7, 0, "x"), (None, 1, 0, "x"), (3, 1, 1, "x")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string")
    docs = clashing(frame(spark, rows))
    found = quality.scores(docs, table).collect()
    assert sorted((str(r["doc_id"]), r["held_out"]) for r in found) == sorted(
        (str(r[0]), zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    kept = quality.keep_good(docs, table)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in found if r["predicted"])


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = odd_documents()
    assert {r["score"] for r in quality.scores(frame(spark, rows), none).collect()} == {0.5}
    one = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    assert all(r["predicted"] == 1 for r in quality.scores(frame(spark, rows), one).collect())
    assert quality.scores(frame(spark, []), none).count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = [r for r in odd_documents() if r[0] is not None]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    sets = [[(r[0], (r[0] % 2) ^ (flip and held(r[0]))) for r in rows] for flip in (False, True)]
    scores = [
        sorted((r["doc_id"], r["score"]) for r in quality.scores(frame(spark, rows), spark.createDataFrame(s, "doc_id long, quality int")).collect()) for s in sets
    ]
    assert [k for k, _ in scores[0]] == [k for k, _ in scores[1]]
    assert np.allclose([x for _, x in scores[0]], [x for _, x in scores[1]], atol=1e-6)
