"""Status of documents as a keyed state machine over a stream of events.

A document is pending when it was received, processing when work on it began, and ready or failed in the end. A timer runs for
each document in processing: if neither end has come when the watermark passes it, the document has failed, interrupted.
Every change of status is one row, so the newest row of a document is its status.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

TIMEOUT_S = 3600
DELAY = "30 minutes"
INTERRUPTED = "interrupted"
#: What an event makes of a status; other events change nothing.
MOVES = {
    ("", "received"): "pending", ("failed", "received"): "pending", ("ready", "received"): "pending",
    ("pending", "started"): "processing", ("processing", "finished"): "ready", ("processing", "failed"): "failed", ("pending", "failed"): "failed",
}
ORDER = {"received": 0, "started": 1, "failed": 2, "finished": 3}
CHANGES = StructType([
    StructField("document_id", LongType()), StructField("status", StringType()), StructField("error", StringType()), StructField("at", TimestampType())])
STATE = StructType([StructField("status", StringType()), StructField("at_ms", LongType()), StructField("timer_ms", LongType())])
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at: datetime) -> int:
    return round(at.timestamp() * 1000)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


class StatusMachine(StatefulProcessor):
    """Events of one document in order of their time; one that is older than the status is late and changes nothing."""

    def __init__(self, timeout_s: int = TIMEOUT_S):
        self.timeout_ms = timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", STATE)

    def _held(self) -> tuple[str, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("", -1, -1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, at, timer = self._held()
        for row in sorted(rows, key=lambda r: (r["at"], ORDER.get(r["event"], 9))):
            now = _ms(row["at"])
            if status == "processing" and now > timer:  # the end came after the time was up
                status, at = "failed", timer
                yield Row(document_id=key[0], status=status, error=INTERRUPTED, at=_time(at))
            new = MOVES.get((status, row["event"]))
            if new is None or now < at:
                continue
            status, at = new, now
            yield Row(document_id=key[0], status=status, error=row["error"] if status == "failed" else None, at=_time(at))
            if status == "processing":
                timer = at + self.timeout_ms
        held = self._held()[2]
        timer = timer if status == "processing" else -1
        if timer != held:
            if held >= 0:
                self.handle.deleteTimer(held)
            if timer >= 0:
                self.handle.registerTimer(timer)
        if status:
            self.state.update((status, at, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, _, timer = self._held()
        if status == "processing" and timer <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(("failed", timer, -1))
            yield Row(document_id=key[0], status="failed", error=INTERRUPTED, at=_time(timer))

    def close(self) -> None:
        pass


def status_changes(events: DataFrame, timeout_s: int = TIMEOUT_S, delay: str = DELAY) -> DataFrame:
    """(document_id, status, error, at) of every change, for a stream ``events(document_id, event, error, at)``.

    Needs the session's RocksDB state store (see ``state_store``). Events that are later than ``delay`` behind the newest are dropped.
    """
    rows = events.select(F.col("document_id").cast("long").alias("document_id"), "event", "error", "at").withWatermark("at", delay)
    return rows.groupBy("document_id").transformWithState(
        statefulProcessor=StatusMachine(timeout_s), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's setting is as before afterwards."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def track(events: DataFrame, path: str, checkpoint: str, timeout_s: int = TIMEOUT_S, delay: str = DELAY):
    """Start a query that appends every change of status to Parquet under ``path``."""
    with state_store(events.sparkSession):
        return status_changes(events, timeout_s, delay).writeStream.format("parquet").outputMode("append").option(
            "path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(changes: DataFrame) -> DataFrame:
    """(document_id, status, error, at): the newest change of each document."""
    rank = {"pending": 0, "processing": 1, "ready": 2, "failed": 3}
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    newest = changes.groupBy("document_id").agg(F.max(F.struct("at", order[F.col("status")].alias("n"), "status", "error")).alias("x"))
    return newest.select("document_id", "x.status", "x.error", "x.at")
