"""Admission, content identity, de-duplication, deletion and recovery of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions.ids import parent_id
from quirefold.session import broadcast_if_small, materialize


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_type_of(filename: Column) -> Column:
    """Lower-case extension, or "unknown" when there is none."""
    ext = F.lower(F.element_at(F.split(filename, r"\."), -1))
    return F.when(filename.contains(".") & (ext != ""), ext).otherwise("unknown")


def title_of(filename: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(filename, r"(?s)\.[^.]*\z", "")


def admission_reason(size: Column, file_type: Column, max_mb: int = fv.MAX_UPLOAD_MB, supported=None) -> Column:
    """Why a file is refused, or null when it is admitted; size is checked first."""
    supported = fv.SUPPORTED_TYPES if supported is None else supported
    return F.when(size > max_mb * 1024 * 1024, F.lit(fv.TOO_LARGE.format(max_mb))).when(
        ~file_type.isin(*supported), F.concat(F.lit(fv.UNSUPPORTED), file_type)
    )


def admit(files: DataFrame, max_mb: int = fv.MAX_UPLOAD_MB, supported=None) -> tuple[DataFrame, DataFrame]:
    """Split files (filename, size, …) into admitted rows and rejects with their reason."""
    judged = files.withColumn("file_type", file_type_of(F.col("filename"))).withColumn(
        "reason", admission_reason(F.col("size"), F.col("file_type"), max_mb, supported)
    )
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def canonical_ids(incoming: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """(document_id, canonical_id, status) for a batch (document_id, content_hash).

    The lowest id of a hash is its document; an id already in the catalogue wins. The
    minimum is combined before the shuffle, so a hash shared by a third of the batch sends
    one row per task. The join back carries ids and hashes only, and adaptive execution
    splits a partition that a hot hash makes too large.
    """
    first = incoming.groupBy("content_hash").agg(F.min("document_id").alias("first_id"))
    if catalogue is not None:
        asked = broadcast_if_small(first.select("content_hash"))  # the catalogue is filtered where it lies, not shuffled
        known = catalogue.join(asked, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("document_id").alias("known_id"))
        first = first.join(known, "content_hash", "left").withColumn("first_id", F.coalesce("known_id", "first_id")).withColumn("known", F.col("known_id").isNotNull()).drop("known_id")
    else:
        first = first.withColumn("known", F.lit(False))
    judged = incoming.select("document_id", "content_hash").join(first, "content_hash")
    duplicate = F.col("known") | (F.col("document_id") != F.col("first_id"))
    return judged.select(
        "document_id", F.col("first_id").alias("canonical_id"), F.when(duplicate, "duplicate").otherwise("pending").alias("status")
    )


def new_documents(incoming: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Rows of a batch that are not duplicates of each other or of the catalogue.

    Decided on ids and hashes alone; the rows, which may carry file contents, then lose the duplicates by a
    join that does not move them as long as the duplicates' ids are measured small.
    """
    light = materialize(incoming.select("document_id", "content_hash"), "hashes")
    repeats = materialize(canonical_ids(light, catalogue).filter("status = 'duplicate'").select("document_id"), "repeats")
    return incoming.join(broadcast_if_small(repeats), "document_id", "left_anti")


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Every library table without the rows of the doomed documents.

    ``table_rows`` hangs on tables and ``vectors``/``postings`` hang on chunks, whose ids
    carry the document id, so each table needs one anti join and none is read twice.
    """
    ids = doomed.select("document_id").distinct()
    out = {}
    for name, df in tables.items():
        if "document_id" in df.columns:
            out[name] = df.join(ids, "document_id", "left_anti")
        elif "chunk_id" in df.columns:
            owner = parent_id("chunk_id")
            out[name] = df.withColumn("_owner", owner).join(ids, F.col("_owner") == F.col("document_id"), "left_anti").drop("_owner")
        elif "table_id" in df.columns:
            gone = tables["tables"].join(ids, "document_id", "left_semi").select("table_id")
            out[name] = df.join(gone, "table_id", "left_anti")
        else:
            out[name] = df
    return out


def removed_count(documents: DataFrame, doomed: DataFrame) -> DataFrame:
    """How many of the requested documents existed."""
    return documents.join(doomed.select("document_id").distinct(), "document_id", "left_semi").agg(F.count("*").alias("deleted"))


def recover_interrupted(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Purge what interrupted documents left behind and mark them failed; pending ones stay."""
    stuck = tables["documents"].filter(F.col("status") == "processing").select("document_id")
    cleaned = cascade_delete({n: d for n, d in tables.items() if n != "documents"}, stuck)
    was_stuck = F.col("status") == "processing"
    cleaned["documents"] = (
        tables["documents"]
        .withColumn("error", F.when(was_stuck, "interrupted").otherwise(F.col("error")))
        .withColumn("status", F.when(was_stuck, "failed").otherwise(F.col("status")))
    )
    return cleaned
