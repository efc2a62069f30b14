"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold import session

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def crc32_of_id(id_col: str):
    """CRC-32 of the id written in decimal digits; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def share(spark: SparkSession, value: object) -> Broadcast:
    """Sends an object of this package to the tasks, its class included: executors need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(sent: Broadcast) -> object:
    return pickle.loads(sent.value)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs that run inside send texts to Python in batches of at most ``rows``; the session's setting is as before afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Hands freed memory back to the system: workers live on between tasks, and their peaks should not add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that none holds many more than ``max_bytes``, whatever the texts' lengths are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * max_bytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def text_key(text_col: str):
    """128 bits that stand for a text in joins; a null text has the key of no other text."""
    text = F.col(text_col)
    return F.when(text.isNull(), F.lit("null")).otherwise(
        F.concat(F.hex(F.xxhash64(text)), F.lit("-"), F.hex(F.xxhash64(text, F.lit(1))))
    )


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


spread = session.spread
