"""The pipeline, stage by stage, against plain Python on the smallest tables with odd rows added."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quirefold.llm import quality
from quirefold.session import scratch_path
from tests.llm.helpers import clashing, frame, odd_documents
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_classes, brute_print

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark):
    """A folder with the tables of the smallest scale, and odd documents with ids of their own."""
    folder = scratch_path(spark, "tables")
    odd = [(None if r[0] is None else 10_000 + r[0], *r[1:]) for r in odd_documents() if r[0] != 5]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.select(COLUMNS).union(spark.createDataFrame(odd, docs.select(COLUMNS).schema)).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_stages(spark):
    folder = tables(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows(docs)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mixture_packing"]

    def run(name, docs):
        path = scratch_path(spark, name)
        stages[name](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path)

    docs = run("quality_classifier", docs)
    after = rows(docs)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    known = [r for r in before if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 5]
    x = np.array([quality.statistics(r[1].encode() if r[1] is not None else None) for r in before])
    own = np.array([quality.statistics(r[1].encode()) for r in known])
    y = np.array([labels[r[0]] for r in known])
    model = quality.fit(
        np.array([(y == c).sum() for c in (0, 1)], float), np.array([own[y == c].sum(axis=0) for c in (0, 1)]),
        np.array([own[y == c].T @ own[y == c] for c in (0, 1)]),
    )
    assert after == [r for r, s in zip(before, model.score(x)) if round(float(s), 9) >= 0.3] and len(after) < len(before)

    docs, before = run("line_dedup", docs), after
    after = rows(docs)
    kept = brute_lines(before, 50)
    want = []
    for r in before:
        text, gone, lines = kept[(r[0], r[1])] if r[1] is not None else (None, 0, 0)
        if not gone:
            want.append(r)
        elif gone < lines:
            want.append((r[0], text, r[2], r[3], len(text)))
    assert after == sorted(want, key=str) and after != before

    docs, before = run("simhash_near_dedup", docs), after
    after = rows(docs)
    classes = {}
    for r, c in zip(before, brute_classes([brute_print(r[1]) for r in before])):
        classes.setdefault(c, []).append(r)
    first = [min((r[0] for r in c if r[0] is not None), default=None) for c in classes.values()]
    assert sorted((r[0] for r in after), key=str) == sorted(first, key=str) and set(after) <= set(before) and len(after) < len(before)

    docs, before = run("benchmark_decontamination", docs), after
    after = rows(docs)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = [brute_hits(r[1], items) for r in before]
    assert after == [r for r, (n, hit, _) in zip(before, hits) if not (hit and 20 * len(hit) >= n)] and len(after) < len(before)

    packed = run("mixture_packing", docs).toPandas()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(r[0]), [*plain.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in after)
    got = []
    for doc, part in packed.groupby("doc_id", dropna=False):
        got.append((str(None if doc != doc else int(doc)), np.concatenate([np.frombuffer(b, "<u4") for b in part.sort_values("start").ids]).tolist()))
    assert sorted(got) == want
    size = packed.groupby("sequence_id").length.sum()
    assert (size.iloc[:-1] == 2048).all()


def test_stages_with_clashing_columns_and_without_rows(spark):
    folder = scratch_path(spark, "tables")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = frame(spark, odd_documents())
    for docs in (clashing(rows), clashing(rows).limit(0)):
        count = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(spark, name)
            stage(spark, docs, folder).write.parquet(path)
            found = spark.read.parquet(path)
            if name != "mixture_packing":
                assert found.columns == docs.columns and found.count() <= count
                docs, count = found, found.count()
        assert (found.count() > 0) == (count > 0)


def test_run_is_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries() if k.startswith("op")}


def test_a_named_run_goes_on_behind_its_last_finished_stage(spark, monkeypatch):
    ran = []

    def stage(label, fails=False):
        def step(spark, docs, sf_dir):
            ran.append(label)
            if fails and ran.count(label) == 1:
                raise RuntimeError("driver lost")
            return docs.selectExpr("doc_id + 1 as doc_id")

        return label, step

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b", fails=True), stage("c")])
    folder, name = scratch_path(spark, "tables"), scratch_path(spark, "x").rsplit("-", 1)[1]
    spark.range(3).selectExpr("id as doc_id").write.parquet(f"{folder}/documents.parquet")
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, folder, name)
    for _ in range(2):
        assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder, name).collect()) == [3, 4, 5]
    assert ran == ["a", "b", "b", "c"]
    assert corpus_pipeline.run(spark, folder).count() == 3 and ran[-3:] == ["a", "b", "c"]
