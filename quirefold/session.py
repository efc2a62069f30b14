"""Session-level helpers: shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a machine-local
    path would be invisible to other executors, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="quirefold-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where a result feeds several branches: the branches then read Parquet with pruning
    instead of recomputing the lineage, and a lost executor costs one read, not a re-run.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def foldered(df: DataFrame, label: str, folders: str, sort: str) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders of ``folders`` and sorted by ``sort``, so that filters on them skip files."""
    path = scratch_path(df.sparkSession, label)
    df.hint("rebalance", folders).sortWithinPartitions(folders, sort).write.partitionBy(folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_TABLES: list[str] = []


def table_name(label: str) -> str:
    """A new name in the catalogue, to be dropped by ``release_tables``."""
    _TABLES.append(f"quirefold_{label}_{uuid.uuid4().hex}")
    return _TABLES[-1]


def release_tables(spark: SparkSession) -> int:
    """Take the bucketed tables that this process made out of the catalogue, when the indexes that read them are no longer used.

    Their files stay until the scratch folder expires. Returns how many there were.
    """
    n, made = len(_TABLES), tuple(_TABLES)
    _TABLES.clear()
    for table in spark.catalog.listTables():
        if table.name.startswith(made):  # an index of segments has several tables under its name
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    return n


def bucketed(df: DataFrame, label: str, buckets: int, by: str, folders: str | None, sort: str, name: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder as a table bucketed by ``by``, in folders of ``folders`` if any, sorted by ``sort``.

    Groups that hold ``by`` are aggregated where the buckets lie, and filters on the folders and the sort column skip files
    and row groups.
    """
    spark = df.sparkSession
    name = table_name(label) if name is None else name
    writer = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(sort)
    writer = writer if folders is None else writer.partitionBy(folders)
    writer.option("path", scratch_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size of ``df`` from its actual rows."""
    row = df.agg(
        F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 64).alias("b")
    ).first()
    return int(row["b"] or 0)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when its measured size is within ``max_bytes``.

    Beyond the bound the frame is returned unhinted and the join becomes a shuffle join,
    which adaptive execution splits on skewed keys.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan of fewer files than cores before CPU-heavy row work.

    On a large table the scan has far more splits than this and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
