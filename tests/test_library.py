"""Stored library: batches, replay, delete, snapshot, bulk load, streaming ingest."""

import pytest
from pyspark.sql import functions as F

from quirefold.operators import library
from quirefold.session import materialize, scratch_path, scratch_root
from quirefold.sources import files
from quirefold.streaming import ingest as streaming


def rows(spark, *texts, start=1):
    df = spark.createDataFrame([(start + i, f"doc{start + i}", t) for i, t in enumerate(texts)], "document_id long, title string, text string")
    return files.text_rows(df)


def ids(df):
    return sorted(r["document_id"] for r in df.select("document_id").collect())


def test_batches_replay_delete_snapshot(spark):
    lib = library.Library(spark, scratch_path(spark, "lib"), 4)
    assert not lib.exists()
    streaming.ingest_batch(lib, rows(spark, "Vendor: Acme", "same text", "same text", "  "), 0)
    assert ids(lib.read("documents")) == [1, 2, 4]
    status = {r["document_id"]: (r["status"], r["error"]) for r in lib.read("documents").collect()}
    assert status[4] == ("failed", "file is empty") and status[1] == ("ready", None)
    second = rows(spark, "same text", "new text", start=10)
    for _ in range(2):  # a replayed batch changes nothing
        streaming.ingest_batch(lib, second, 1)
        assert ids(lib.read("documents")) == [1, 2, 4, 11] and ids(lib.read("chunks")) == [1, 2, 11]
    assert [r["value"] for r in lib.read("fields").collect()] == ["Acme"]

    # children of a batch whose documents were never written stay invisible
    lib.write_batch(2, {"chunks": lib.read("chunks").withColumn("document_id", F.lit(99).cast("long"))})
    assert ids(lib.read("chunks")) == [1, 2, 11]

    assert lib.delete(spark.createDataFrame([(1,), (11,), (500,)], "document_id long")) == 2
    assert ids(lib.read("documents")) == [2, 4] and ids(lib.read("chunks")) == [2] and lib.read("fields").count() == 0
    assert lib.delete(spark.createDataFrame([(1,)], "document_id long")) == 0

    target = scratch_path(spark, "snap")
    other = library.Library(spark, scratch_path(spark, "copy"), 4)
    assert other.restore(target) is False
    lib.snapshot(target, 1)
    assert other.restore(target) is True and other.restore(target) is False
    assert ids(other.read("documents")) == [2, 4] and ids(other.read("chunks")) == [2]


def test_bulk_load(spark, tmp_path):
    for name, body in {"b.txt": "beta", "a.md": "# H\nalpha", "c.txt": "beta", "z.exe": "x", ".hidden.txt": "no"}.items():
        (tmp_path / name).write_text(body)
    lib = library.Library(spark, scratch_path(spark, "bulk"), 4)
    assert library.bulk_load(lib, str(tmp_path)) == 2
    assert {r["filename"]: r["document_id"] for r in lib.read("documents").collect()} == {"a.md": 1, "b.txt": 2}
    with pytest.raises(ValueError, match="not empty"):
        library.bulk_load(lib, str(tmp_path))


def test_bulk_load_opens_every_file_once(spark, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"f{i}.txt").write_text(f"text {i % 4}")
    opened, scan = spark.sparkContext.accumulator(0), files.admit_folder

    def read(content_hash):
        opened.add(1)
        return content_hash

    def counted(*args):
        admitted, refused = scan(*args)
        return admitted.withColumn("content_hash", F.udf(read, "string")("content_hash")), refused

    monkeypatch.setattr(files, "admit_folder", counted)
    assert library.bulk_load(library.Library(spark, scratch_path(spark, "once"), 4), str(tmp_path)) == 4
    assert opened.value == 5


def test_streaming_across_files(spark):
    source = scratch_path(spark, "source")
    schema = "document_id long, title string, text string"
    for i, texts in enumerate([["one", "two"], ["two", "three"], ["one"]]):
        spark.createDataFrame([(i * 10 + j, "t", t) for j, t in enumerate(texts)], schema).coalesce(1).write.mode("append").parquet(source)
    lib, checkpoint = library.Library(spark, scratch_path(spark, "stream"), 4), scratch_path(spark, "cp")
    for _ in range(2):  # the second run finds nothing new
        streaming.stream_ingest(streaming.file_stream(spark, source, schema), lib, checkpoint, prepare=files.text_rows).awaitTermination()
        assert {r["document_id"] for r in lib.read("documents").collect()} == {0, 1, 11}


def test_scratch_needs_a_shared_folder(spark):
    assert scratch_root(spark) == scratch_root(spark)
    df = materialize(spark.range(3), "x")
    assert df.count() == 3


def test_rank_limit_runs_before_the_shuffle(spark):
    from quirefold.operators.ranking import top_k

    plan = top_k(spark.range(100).withColumn("k", F.col("id") % 3), "k", 5, [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_two_writers_into_one_library(spark):
    """A bulk load, two streams and their replays: no batch overwrites another writer's."""
    lib = library.Library(spark, scratch_path(spark, "writers"), 4)
    schema = "document_id long, title string, text string"
    lib.write_batch(0, {"documents": rows(spark, "bulk one", "bulk two").withColumn("status", F.lit("ready")).drop("content")}, library.new_writer("load"))
    for start in (50, 60):
        source = scratch_path(spark, "source")
        spark.createDataFrame([(start, "t", f"text {start}"), (start + 1, "t", "bulk one"), (start + 2, "t", "text 50")], schema).coalesce(1).write.parquet(source)
        checkpoint = scratch_path(spark, "cp")
        for _ in range(2):
            streaming.stream_ingest(streaming.file_stream(spark, source, schema), lib, checkpoint, prepare=files.text_rows).awaitTermination()
    assert ids(lib.read("documents")) == [1, 2, 50, 60]
    repeats = {(r["document_id"], r["canonical_id"], r["reason"]) for r in lib.read("rejects").collect()}
    assert repeats == {(51, 1, "duplicate"), (52, 50, "duplicate"), (61, 1, "duplicate"), (62, 50, "duplicate")}


def test_deleted_ids_come_back(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / "b.txt").write_text("beta")
    lib = library.Library(spark, scratch_path(spark, "again"), 4)
    assert library.bulk_load(lib, str(tmp_path)) == 2
    assert lib.delete(lib.read("documents").select("document_id")) == 2
    assert library.bulk_load(lib, str(tmp_path)) == 2
    assert ids(lib.read("documents")) == [3, 4] and ids(lib.read("chunks")) == [3, 4]
    streaming.ingest_batch(lib, rows(spark, "gamma", start=1), 0, writer="w")  # an id that was deleted before
    assert ids(lib.read("documents")) == [1, 3, 4]
    assert lib.delete(spark.createDataFrame([(1,)], "document_id long")) == 1
    streaming.ingest_batch(lib, rows(spark, "delta", start=1), 1, writer="w")
    assert ids(lib.read("documents")) == [1, 3, 4] and [r["title"] for r in lib.read("documents").filter("document_id = 1").collect()] == ["doc1"]


def test_snapshots_copy_new_batches_only(spark):
    lib, target = library.Library(spark, scratch_path(spark, "lib"), 2), scratch_path(spark, "snap")
    streaming.ingest_batch(lib, rows(spark, "one", "two"), 0, target, writer="w")
    before = {f for f in spark.read.parquet(f"{target}/documents").inputFiles()}
    streaming.ingest_batch(lib, rows(spark, "three", start=5), 1, target, writer="w")
    after = {f for f in spark.read.parquet(f"{target}/documents").inputFiles()}
    assert before < after
    lib.delete(spark.createDataFrame([(1,), (5,)], "document_id long"))
    assert lib.snapshot(target) == 3
    copy = library.Library(spark, scratch_path(spark, "copy"), 2)
    assert copy.restore(target) and ids(copy.read("documents")) == [2] and copy.next_id() == 6


def test_large_and_foreign_files_are_not_read(spark, tmp_path):
    for name, body in {"a.txt": b"alpha", "big.TXT": b"x" * (2 << 20), "c.exe": b"no", "d.Md": b"# delta\ntext", "same.txt": b"alpha"}.items():
        (tmp_path / name).write_bytes(body)
    admitted, refused = files.admit_folder(spark, str(tmp_path), max_mb=1)
    plan = admitted._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1048576)" in plan
    assert sorted(r["filename"] for r in admitted.collect()) == ["a.txt", "d.Md", "same.txt"]
    assert {(r["filename"], r["reason"]) for r in refused.collect()} == {("big.TXT", "file exceeds 1MB limit"), ("c.exe", "unsupported file type: exe")}
    assert "content" not in refused._jdf.queryExecution().executedPlan().toString()
    lib = library.Library(spark, scratch_path(spark, "bulk"), 4)
    assert library.bulk_load(lib, str(tmp_path)) == 3
    assert {(r["filename"], r["reason"]) for r in lib.read("rejects").collect()} == {("c.exe", "unsupported file type: exe"), ("same.txt", "duplicate")}


def refused(spark, *ids):
    df = rows(spark, *["x"] * len(ids)).withColumn("document_id", F.col("document_id") - 1 + ids[0])
    return df.withColumn("filename", F.concat(F.lit("f"), F.col("document_id").cast("string"), F.lit(".exe")))


@pytest.mark.parametrize("order", [["r", "d", "r"], ["r"]])
def test_batches_of_rejects_only_survive_restore(spark, order):
    lib, target = library.Library(spark, scratch_path(spark, "lib"), 2), scratch_path(spark, "snap")
    for k, kind in enumerate(order):
        batch = refused(spark, 10 * k + 1, 10 * k + 2) if kind == "r" else rows(spark, f"text {k}", "same", start=10 * k + 1)
        for _ in range(1 + (k == 0)):  # a replay changes nothing
            streaming.ingest_batch(lib, batch, k, target, writer="w")
    copy = library.Library(spark, scratch_path(spark, "copy"), 2)
    assert copy.restore(target) and not copy.restore(target)
    for table in ("documents", "rejects", "chunks"):
        assert ids(copy.read(table)) == ids(lib.read(table))
    listed = lambda x: sorted(map(str, x.read("rejects").select("document_id", "filename", "reason", "canonical_id").collect()))
    assert listed(copy) == listed(lib) and len(listed(lib)) >= 2 * order.count("r")
    streaming.ingest_batch(copy, rows(spark, "text 1", "later", start=90), 0, target, writer="x")  # a restored library goes on
    assert 91 in ids(copy.read("documents"))


def test_interrupted_batch_with_rejects_is_copied_again_when_it_completes(spark):
    lib, target = library.Library(spark, scratch_path(spark, "lib"), 2), scratch_path(spark, "snap")
    streaming.ingest_batch(lib, refused(spark, 5), 0, writer="w")
    lib.write_batch(0, {"chunks": spark.createDataFrame([(1 << 20, 1, 0, "orphan", "", "")], "chunk_id long, document_id long, seq int, text string, embed_text string, location string")}, "w")
    lib.snapshot(target)
    early = library.Library(spark, scratch_path(spark, "early"), 2)
    assert early.restore(target) and ids(early.read("rejects")) == [5] and early.read("chunks").count() == 0
    streaming.ingest_batch(lib, rows(spark, "whole").unionByName(refused(spark, 5), allowMissingColumns=True), 0, target, writer="w")
    late = library.Library(spark, scratch_path(spark, "late"), 2)
    assert late.restore(target) and ids(late.read("documents")) == [1] and ids(late.read("chunks")) == [1] and ids(late.read("rejects")) == [5]


def test_nothing_stored(spark):
    lib = library.Library(spark, scratch_path(spark, "lib"), 2)
    assert not lib.exists() and lib.next_id() == 1 and lib.snapshot(scratch_path(spark, "snap")) == 0
    for table, columns in library.schemas.LIBRARY.items():
        assert lib.read(table).count() == 0 and lib.read(table).schema.names == spark.createDataFrame([], columns).schema.names


def test_other_faults_are_not_taken_for_nothing_stored(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.parquet").write_text("no parquet at all")
    with pytest.raises(Exception, match="(?i)parquet"):
        frame = library.stored(spark, str(tmp_path / "a"))
        assert frame is not None
        frame.count()


def test_micro_batches_look_up_their_own_hashes(spark):
    lib = library.Library(spark, scratch_path(spark, "lib"), 2)
    streaming.ingest_batch(lib, rows(spark, *[f"text {k}" for k in range(40)]), 0, writer="w")
    lib.delete(spark.createDataFrame([(3,)], "document_id long"))
    asked = rows(spark, "text 2", "text 7", "new").select("content_hash")  # texts of the documents 3 and 8
    known = lib.known_hashes(asked)
    assert ids(known) == [8]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(content_hash" in plan
    assert ids(lib.known_hashes(asked, ("w", 0))) == [] and ids(lib.known_hashes(rows(spark, *[f"text {k}" for k in range(40)] * 30))) == [k + 1 for k in range(40) if k != 2]
    assert lib.known_hashes(asked.limit(0)).count() == 0
    target = scratch_path(spark, "snap")
    lib.snapshot(target)
    copy = library.Library(spark, scratch_path(spark, "copy"), 2)
    assert copy.restore(target) and ids(copy.known_hashes(asked)) == [8]


def test_frames_of_the_library_queries_are_made_once(spark):
    """Batches, deletes and vectors read stored documents and chunks: none makes the invoices again."""
    from quirefold.plans import source_queries

    frames = source_queries._library_frames(spark, "/root/testdata/sf0.001", F.lit(False))
    for table in ("documents", "chunks", "vectors", "fields"):
        assert "orders.parquet" not in "".join(frames[table].inputFiles()), table
