"""Continuous ingest: files or text rows arrive, every new document is processed once."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.operators import admission, ingest
from quirefold.operators.library import MAIN, Library
from quirefold.session import broadcast_if_small, materialize, spread


def settle(light: DataFrame, refused: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What is new in a batch, and what is not taken in, with the reason.

    ``light`` holds the admitted rows without content. Returns the ids to keep and the rows of ``rejects``: refused files,
    and duplicates with the id of the document that already has their content.
    """
    judged = materialize(admission.canonical_ids(light, known), "judged")
    doomed = judged.filter("status = 'duplicate'").select("document_id", "canonical_id")
    repeats = light.join(broadcast_if_small(doomed), "document_id").withColumn("reason", F.lit(fv.DUPLICATE))
    rejects = refused
    for column, kind in (("document_id", "long"), ("content_hash", "string"), ("canonical_id", "long")):
        if column not in rejects.columns:
            rejects = rejects.withColumn(column, F.lit(None).cast(kind))
    columns = ["document_id", "filename", "title", "file_type", "size", "content_hash", "canonical_id", "reason"]
    return judged.filter("status = 'pending'").select("document_id"), rejects.select(columns).union(repeats.select(columns))


def ingest_batch(
    library: Library, batch: DataFrame, batch_id: int, snapshot_to: str | None = None, max_mb: int | None = None, writer: str = MAIN,
) -> None:
    """One micro-batch: admit, de-duplicate, parse, extract, chunk, write, snapshot.

    Duplicates are looked up among the stored hashes, so the job keeps no growing state; a replayed batch leaves its own
    earlier attempt out, finds the same documents new and overwrites itself. Refused rows and duplicates are stored in ``rejects``.
    """
    admitted, refused = admission.admit(batch) if max_mb is None else admission.admit(batch, max_mb)
    light = materialize(admitted.select("document_id", "filename", "title", "file_type", "size", "content_hash"), "admitted")
    known = library.known_hashes(light, (writer, batch_id)) if library.exists() else None
    keep, rejects = settle(light, refused, known)
    fresh = materialize(admitted.join(broadcast_if_small(keep), "document_id", "left_semi"), "fresh")
    library.write_batch(batch_id, {**ingest.ingest(spread(fresh)), "rejects": rejects}, writer)
    if snapshot_to:
        library.snapshot(snapshot_to)


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Stream of parquet files under ``path`` in arrival order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_ingest(stream: DataFrame, library: Library, checkpoint: str, snapshot_to: str | None = None, prepare=None):
    """Start the ingest query over ``stream``; ``prepare`` turns its rows into scanned documents.

    The writer of its batches is named by the query's id, which Spark keeps in the checkpoint: a restart goes on with the
    same batches, and a new checkpoint never touches those of another.
    """
    started, writer = threading.Event(), []

    def run(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        ingest_batch(library, batch if prepare is None else prepare(batch), batch_id, snapshot_to, writer=writer[0])

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    writer.append(f"stream-{query.id}")
    started.set()
    return query


def first_seen(stream: DataFrame, hash_column: str = "content_hash"):
    """The stream without repeated content, by keyed state; for bounded streams of hashes.

    Long-running ingest uses the catalogue lookup of ``ingest_batch`` instead, which needs no
    state that grows with the stream.
    """
    return stream.dropDuplicates([hash_column])
