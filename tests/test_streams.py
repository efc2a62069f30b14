"""The data source of document files, and the status machine over a stream."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quirefold.operators import admission
from quirefold.session import scratch_path
from quirefold.sources import datasource, files
from quirefold.streaming import ingest as streaming
from quirefold.streaming import status

NAMES = ["a.txt", "b.MD", "c.tar.gz", "noext", "d.", "é x.txt", "big.txt"]


def folder_of(spark, names=NAMES):
    rows = [(n, (n * 3).encode() if n != "big.txt" else b"x" * 5000) for n in names]
    path = scratch_path(spark, "files")
    datasource.write_folder(spark.createDataFrame(rows, "filename string, content binary"), path)
    return path, dict(rows)


def test_files_come_back_as_the_file_scan_reads_them(spark):
    path, rows = folder_of(spark)
    found = datasource.read_folder(spark, path)
    assert {r["filename"]: bytes(r["content"]) for r in found.collect()} == rows
    columns = ["filename", "title", "file_type", "size", "content_hash"]
    listed = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    assert listed(found) == listed(files.scan_files(spark, path))
    by_name = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", admission.file_type_of(F.col("n")).alias("t"), admission.title_of(F.col("n")).alias("x"))
    assert {r["n"]: (r["t"], r["x"]) for r in by_name.collect()} == {n: (datasource.Listed(n, 0, 0).file_type, datasource.Listed(n, 0, 0).title) for n in NAMES}


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def test_options_and_filters_reach_the_listing(spark):
    path, rows = folder_of(spark)
    found = datasource.read_folder(spark, path, types="txt, MD", maxBytes=100)
    assert {r["filename"] for r in found.collect()} == {"a.txt", "b.MD", "é x.txt"}
    assert {r["filename"] for r in found.filter("file_type = 'txt'").union(found.filter("file_type = 'md'")).collect()} == {"a.txt", "b.MD", "é x.txt"}
    assert datasource.read_folder(spark, path, types="json").count() == 0
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        found = datasource.read_folder(spark, path, pushdown=True).filter(F.col("file_type").isin("txt", "md") & (F.col("size") <= 100))
        assert {r["filename"] for r in found.collect()} == {"a.txt", "b.MD", "é x.txt"}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "file_type" not in plan.split("Filter")[1].split("\n")[0]  # answered by the reader, not left to Spark
        assert datasource.read_folder(spark, path, pushdown=True).filter("file_type = 'json'").count() == 0
        assert datasource.read_folder(spark, path, pushdown=True).filter("upper(filename) = 'A.TXT'").count() == 1
    finally:
        spark.conf.set(PUSHDOWN, before)
    reader = datasource.PushingReader(path, 1 << 20)
    left = list(reader.pushFilters([datasource.EqualTo(("filename",), "a.txt"), datasource.EqualTo(("content_hash",), "x"), datasource.LessThan(("size",), 9 << 20)]))
    assert [f.attribute for f in left] == [("content_hash",)] and [f.filename for run in reader.partitions() for f in run.files] == ["a.txt"]


def test_files_that_are_left_out_are_not_opened(spark, monkeypatch):
    path, _ = folder_of(spark)
    reader = datasource.FolderReader(path, 1 << 20, datasource.Wanted(("txt",), 100))
    opened = [b.column("filename").to_pylist() for run in reader.partitions() for b in reader.read(run)]
    assert sorted(sum(opened, [])) == ["a.txt", "é x.txt"] and list(reader.read(None)) == []
    assert {f.filename for run in reader.partitions() for f in run.files} == {"a.txt", "é x.txt"}


def test_partitions_are_bounded(spark):
    some = [datasource.Listed(f"f{k}", size, k) for k, size in enumerate([5, 5, 5, 100, 1, 1])]
    assert [[f.size for f in run.files] for run in datasource.runs(some, 10)] == [[5, 5], [5], [100], [1, 1]]
    assert datasource.runs([], 10) == []
    path, _ = folder_of(spark)
    assert datasource.read_folder(spark, path, partitionBytes=20).rdd.getNumPartitions() > 3


@pytest.mark.parametrize("name", ["", "x/y.txt", ".hidden", None])
def test_names_that_are_refused(spark, name):
    with pytest.raises(Exception, match="no name of a visible file"):
        datasource.write_folder(spark.createDataFrame([(name, b"")], "filename string, content binary"), scratch_path(spark, "files"))


def test_stream_takes_every_file_once_across_restarts(spark):
    path, _ = folder_of(spark, ["a.txt", "b.txt", "c.txt"])
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")

    def run():
        stream = datasource.stream_folder(spark, path, filesPerBatch=2).select("filename", "size")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["filename"] for r in spark.read.parquet(out).collect())

    assert run() == ["a.txt", "b.txt", "c.txt"]
    datasource.write_folder(spark.createDataFrame([("d.txt", b"new")], "filename string, content binary"), path)
    assert run() == run() == ["a.txt", "b.txt", "c.txt", "d.txt"]


# --- status --------------------------------------------------------------------------------------

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "document_id long, event string, error string, at timestamp"


def run_machine(spark, batches, timeout_s=600, delay="1 minute"):
    """Changes (document, status, error, minute) over batches of (document, event, minute)."""
    source, out = scratch_path(spark, "events"), scratch_path(spark, "changes")
    for batch in batches:
        rows = [(d, e, f"why {d}" if e == "failed" else None, START + timedelta(minutes=m)) for d, e, m in batch]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    checkpoint = scratch_path(spark, "cp")
    for _ in range(2):  # a restart finds nothing to do
        status.track(streaming.file_stream(spark, source, SCHEMA), out, checkpoint, timeout_s, delay).awaitTermination()
    changes = spark.read.schema(status.CHANGES).parquet(out)
    minute = lambda r: (r["at"].timestamp() - START.timestamp()) / 60
    listed = sorted((r["document_id"], minute(r), r["status"], r["error"]) for r in changes.collect())
    return listed, {r["document_id"]: (r["status"], r["error"]) for r in status.current(changes).collect()}


def test_status_machine(spark):
    before = spark.conf.get(status.STORE)
    changes, now = run_machine(spark, [
        [(1, "received", 0), (1, "started", 1), (2, "received", 0), (2, "started", 1), (3, "started", 0), (4, "received", 0), (5, "received", 0), (5, "started", 0), (6, "received", 0), (6, "failed", 0)],
        [(1, "finished", 5), (2, "finished", 30), (4, "unknown", 5), (4, "finished", 5), (6, "received", 6), (6, "started", 6), (6, "failed", 7)],
        [(9, "received", 60)],
        [(5, "received", 61), (5, "started", 61), (5, "finished", 62), (2, "failed", 62)],
        [(9, "started", 70), (8, "received", 100)],
    ])
    assert now == {
        1: ("ready", None), 2: ("failed", "interrupted"), 4: ("pending", None), 5: ("ready", None), 6: ("failed", "why 6"),
        8: ("pending", None), 9: ("failed", "interrupted"),
    }
    assert [c[1:] for c in changes if c[0] == 5] == [
        (0, "pending", None), (0, "processing", None), (10, "failed", "interrupted"), (61, "pending", None), (61, "processing", None), (62, "ready", None)]
    assert [c[1:3] for c in changes if c[0] == 2] == [(0, "pending"), (1, "processing"), (11, "failed")]
    assert [c[1:3] for c in changes if c[0] == 9] == [(60, "pending"), (70, "processing"), (80, "failed")]
    assert spark.conf.get(status.STORE) == before
