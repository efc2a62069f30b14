"""The stored library: appends, deletes, snapshots and dense document numbers.

Every table lies under ``<root>/<table>/writer=W/batch_id=N/bucket=M``. A writer is one bulk load, one restore or one
streaming checkpoint, so batches of different writers never meet. A batch overwrites its own folder, so writing it twice
changes nothing, and its documents are written last: a batch without documents is one that was interrupted, and
readers do not see it; only its rejects count whether or not a document came with them. A delete names the stored rows
(document, writer, batch), so a later document may use the id again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold import schemas
from quirefold.functions.ids import parent_id
from quirefold.session import broadcast_if_small, materialize

TABLES = ["chunks", "fields", "tables", "table_rows", "vectors", "rejects", "documents"]
#: Ids by content hash, in folders by the hash's first digit and sorted by it: what a micro-batch looks its own hashes up in.
HASHES = "hashes"
FEW_HASHES = 1000
BATCH = ["writer", "batch_id"]
BUCKETS = 64
MAIN = "main"


#: What Spark says of a folder that is not there, and of one without a file: nothing is stored in either.
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows under ``path``, or None where nothing is stored. Any other fault (a denied folder, say) is an error."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as fault:
        if fault.getCondition() in NOTHING_STORED:
            return None
        raise
    return df.withColumn("writer", F.col("writer").cast("string")) if "writer" in df.columns else df


def new_writer(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"


class Library:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _bucket(self, df: DataFrame) -> Column:
        owner = F.col("document_id") if "document_id" in df.columns else parent_id("chunk_id")
        return F.pmod(F.xxhash64(owner), F.lit(self.buckets)).cast("int")

    def write_batch(self, batch_id: int, frames: dict[str, DataFrame], writer: str = MAIN) -> None:
        """Write one batch of one writer; documents come last and make it visible."""
        documents = frames.get("documents")
        if documents is not None and "content_hash" in documents.columns:
            rows = documents.select("document_id", "content_hash").withColumn("bucket", self._digit()).hint("rebalance", "bucket")
            rows.sortWithinPartitions("bucket", "content_hash").write.mode("overwrite").partitionBy("bucket").parquet(
                f"{self._path(HASHES)}/writer={writer}/batch_id={batch_id}")
        for table in TABLES:
            if table in frames:
                df = frames[table]
                if "document_id" not in df.columns:  # every stored row carries the id of its document
                    df = df.withColumn("document_id", parent_id("chunk_id"))
                # rebalance gathers small buckets and splits a bucket that one hot document fills
                out = df.withColumn("bucket", self._bucket(df)).hint("rebalance", "bucket")
                out.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path(table)}/writer={writer}/batch_id={batch_id}")

    @staticmethod
    def _digit() -> Column:
        return F.coalesce(F.conv(F.substring("content_hash", 1, 1), 16, 10).cast("int"), F.lit(0))

    def known_hashes(self, asked: DataFrame, replay: tuple[str, int] | None = None) -> DataFrame:
        """(document_id, content_hash) of live documents that may have one of the hashes ``asked(content_hash)``.

        Of few hashes only their folders are read, and in these only the row groups that can hold them.
        """
        few = [r[0] for r in asked.select("content_hash").distinct().limit(FEW_HASHES + 1).collect()]
        rows = self._live(HASHES, replay)
        if len(few) <= FEW_HASHES:  # more hashes than that are in every folder
            rows = rows.filter(F.col("bucket").isin(sorted({int(h[0], 16) for h in few})) & F.col("content_hash").isin(few))
        return rows.select("document_id", "content_hash")

    def exists(self) -> bool:
        """Whether anything was ever stored, be it rejects only."""
        return any(stored(self.spark, self._path(table)) is not None for table in ("documents", "rejects"))

    def deleted(self) -> DataFrame | None:
        """(document_id, writer, batch_id) of deleted documents."""
        df = stored(self.spark, self._path("deleted"))
        return None if df is None else df.select("document_id", *BATCH).distinct()

    def _live(self, table: str, replay: tuple[str, int] | None = None) -> DataFrame:
        df, documents = stored(self.spark, self._path(table)), stored(self.spark, self._path("documents"))
        if df is None or (documents is None and table != "rejects"):
            return self.spark.createDataFrame([], f"{schemas.LIBRARY[table]}, writer string, batch_id int, bucket int")
        if table not in ("documents", "rejects"):
            df = df.join(broadcast_if_small(documents.select(*BATCH).distinct()), BATCH, "left_semi")
        if replay is not None:
            df = df.filter((F.col("writer") != replay[0]) | (F.col("batch_id") < replay[1]))
        gone = self.deleted()
        if gone is not None:
            df = df.join(broadcast_if_small(gone), ["document_id", *BATCH], "left_anti")
        return df

    def read(self, table: str, replay: tuple[str, int] | None = None) -> DataFrame:
        """Live rows of a table: complete batches, without deleted documents.

        ``replay`` names the batch that is being written: what it or later ones of its writer may
        have stored in an interrupted attempt is left out.
        """
        return self._live(table, replay).drop(*BATCH, "bucket")

    def next_id(self) -> int:
        """One more than the highest document id ever used, deleted ones included."""
        highest = [0]
        for table in ("documents", "floor"):
            df = stored(self.spark, self._path(table))
            if df is not None:
                highest.append(df.agg(F.max("document_id")).first()[0] or 0)
        return max(highest) + 1

    def delete(self, doomed: DataFrame) -> int:
        """Delete documents with all they own; returns how many existed.

        Only ids are written. Reads leave their rows out, and a restore of a snapshot does not bring them back.
        """
        present = materialize(
            self._live("documents").join(broadcast_if_small(doomed.select("document_id").distinct()), "document_id", "left_semi").select("document_id", *BATCH), "doomed"
        )
        n = present.select("document_id").distinct().count()
        if n:
            present.write.mode("append").parquet(self._path("deleted"))
        return n

    # --- snapshots ---------------------------------------------------------------------------

    def _batches(self) -> DataFrame:
        """(writer, batch_id, complete): batches with rejects, documents or both; without documents only the rejects count."""
        found = None
        for table in ("documents", "rejects"):
            df = stored(self.spark, self._path(table))
            if df is not None:
                rows = df.select("writer", F.col("batch_id").cast("long").alias("batch_id"), F.lit(table == "documents").alias("complete")).distinct()
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            found = self.spark.createDataFrame([], "writer string, batch_id long, complete boolean")
        return found.groupBy(*BATCH).agg(F.max("complete").alias("complete"))

    @staticmethod
    def _of_batches(rows: DataFrame, table: str, batches: DataFrame) -> DataFrame:
        """The rows of a table that belong to ``batches(writer, batch_id, complete)``."""
        batches = batches if table == "rejects" else batches.filter("complete")
        return rows.join(broadcast_if_small(batches.select(*BATCH).distinct()), BATCH, "left_semi")

    def snapshot(self, target: str, version: int | None = None) -> int:
        """Bring ``target`` up to date: only batches that no earlier snapshot holds are copied.

        Stored batches never change, so a version is a list of batches, the deletes at that time and the highest
        id; its manifest rows come last and complete it. A batch that had only rejects is copied again if documents came later.
        Returns the version, by default one more than the newest; a library without any batch has version 0 and no manifest.
        """
        manifest = stored(self.spark, f"{target}/manifest")
        if version is None:
            version = 1 if manifest is None else manifest.agg(F.max("version")).first()[0] + 1
        batches = materialize(self._batches(), "batches")
        if batches.isEmpty():
            return 0
        fresh = batches if manifest is None else batches.join(manifest.select(*BATCH, "complete"), [*BATCH, "complete"], "left_anti")
        if not fresh.isEmpty():
            for table in TABLES:
                rows = stored(self.spark, self._path(table))
                if rows is not None:
                    self._of_batches(rows, table, fresh).write.mode("overwrite").option(
                        "partitionOverwriteMode", "dynamic").partitionBy(*BATCH, "bucket").parquet(f"{target}/{table}")
        gone = self.deleted()
        if gone is not None:
            gone.write.mode("overwrite").parquet(f"{target}/deleted/version={version}")
        batches.select(
            F.lit(version).cast("long").alias("version"), *BATCH, "complete", F.lit(self.next_id() - 1).cast("long").alias("highest")
        ).coalesce(1).write.mode("append").parquet(f"{target}/manifest")
        return version

    def restore(self, source: str) -> bool:
        """Install the newest complete snapshot, rejects included, only where no library exists yet."""
        manifest = stored(self.spark, f"{source}/manifest")
        if manifest is None or self.exists():
            return False
        newest = manifest.agg(F.max("version")).first()[0]
        batches = manifest.filter(F.col("version") == newest)
        gone = stored(self.spark, f"{source}/deleted/version={newest}")
        frames = {}
        for table in TABLES:
            rows = stored(self.spark, f"{source}/{table}")
            if rows is not None:
                rows = self._of_batches(rows, table, batches)
                if gone is not None:
                    rows = rows.join(broadcast_if_small(gone), ["document_id", *BATCH], "left_anti")
                frames[table] = rows.drop(*BATCH, "bucket")
        batches.agg(F.max("highest").alias("document_id")).write.mode("overwrite").parquet(self._path("floor"))
        self.write_batch(0, frames, new_writer("restore"))
        return True


def dense_ids(df: DataFrame, key: str, start: int = 1) -> DataFrame:
    """Add ``document_id``: start, start+1, … in the order of the unique ``key``.

    The keys alone are range-partitioned and numbered inside their partition, and the
    partition sizes (one row per partition) give each partition its first number.
    """
    ranged = df.select(key).repartitionByRange(key).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ids")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    numbered = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(key))).join(F.broadcast(offsets), "part")
    numbered = numbered.select(key, (F.col("before") + F.col("at") + (start - 1)).cast("long").alias("document_id"))
    return df.join(broadcast_if_small(numbered), key)  # the rows may carry file contents: they stay where they are if the ids are few


def bulk_load(library: Library, directory: str) -> int:
    """Load every visible file of a folder into an empty library, in name order; returns the number added.

    Refused files and repeated contents are kept in ``rejects`` with their reason.
    """
    from quirefold.operators import admission, ingest
    from quirefold.sources import files
    from quirefold.streaming.ingest import settle

    if library.exists() and library.read("documents").limit(1).count():
        raise ValueError("library is not empty")
    admitted, refused = files.admit_folder(library.spark, directory)
    admitted = materialize(admitted, "scanned")  # every file is opened once; numbers, hashes and contents then come from these rows
    light = materialize(dense_ids(admitted.select("filename", "title", "file_type", "size", "content_hash"), "filename", library.next_id()), "admitted")
    keep, rejects = settle(light, refused, None)
    fresh = materialize(admitted.join(broadcast_if_small(keep.join(light.select("document_id", "filename"), "document_id")), "filename"), "fresh")
    library.write_batch(0, {**ingest.ingest(fresh), "rejects": rejects}, new_writer("load"))
    return fresh.count()
