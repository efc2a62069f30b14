"""Corpus pipeline: from raw documents to packed training sequences.

Each stage works on all rows that the one before left, is written as Parquet and read again, so a lost executor costs a
re-read and no stage holds the lineage of another. Stages but the last return the columns of ``documents``. A run that
has a name keeps its stages in folders of that name, so that it goes on after its last finished stage if its driver is lost.

Null and empty texts, repeated rows and null ids are rows like any other: the classifier scores them (null as empty), line
dedup leaves texts without lines as they are, near dedup takes them as one class of fingerprint zero, decontamination
finds no words in them, and packing gives those that are left one piece with the end id. Empty tables pass through as empty.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quirefold.llm import decontaminate, linededup, packing, quality, queries, simhash  # noqa: E402
from quirefold.operators.library import stored  # noqa: E402
from quirefold.session import scratch_path, scratch_root  # noqa: E402


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on the labels outside its held-out fold, rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts; a document of which nothing is left goes. ``n_chars`` follows the text."""
    found = linededup.dedup_lines(docs).filter("__deleted = 0 or __deleted < __lines")
    kept = F.when(F.col("__deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: that of the smallest id."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in passages of the benchmark go; the others stay as they are."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences in the corpus's mixture of sources."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixture_packing", sequences),
]

#: The classifier, the hashes of the fingerprints and the tokenizer have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages over ``documents``; the last one's rows.

    With ``name``, stages that an earlier run of this name over the same tables has finished are not run again. A stage counts as
    finished when the row that is written behind it is there; what an interrupted one left is overwritten.
    """
    folder = scratch_path(spark, "pipeline") if name is None else os.path.join(scratch_root(spark), f"pipeline-{name}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (stage_name, stage) in enumerate(STAGES, 1):
        path = os.path.join(folder, f"{number}-{stage_name}")
        done = stored(spark, f"{path}-finished") if name is not None else None
        if done is None or done.isEmpty():
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            if name is not None:
                spark.range(1, numPartitions=1).write.mode("overwrite").parquet(f"{path}-finished")
        docs = spark.read.parquet(path)
    return docs
