"""A keyword index that is kept in step with uploads and deletes by segments.

Token lists, postings and tombstones are one table each, all bucketed by chunk into the same number of buckets, with a folder
per segment. An upload writes one further segment, a delete writes tombstones and negative document frequencies, and a
merge writes the live rows of several segments as a new one. Whatever its segment, everything of a chunk lies in its bucket, so a search
over any number of segments shuffles no matches. An index value lists the segments it reads: one that is held keeps its
state while others go on, and a write that failed is in no list.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import keyword
from quirefold.session import broadcast_if_small, materialize, scratch_path, table_name

#: Segments of one size class that are merged into one; a class holds sizes up to this many times its smallest.
FACTOR = 4
#: A segment of which more than this share of the chunks is deleted is written anew by itself.
DEAD_SHARE = 0.5


@dataclass(frozen=True)
class Segment:
    number: int
    n_chunks: int
    n_tokens: int
    n_dead: int = 0
    dead_tokens: int = 0

    @property
    def live(self) -> int:
        return self.n_chunks - self.n_dead


@dataclass
class SegmentedIndex:
    """``segments`` are the ones that are read; ``counts`` are files of (segment, term, df), to be added up."""

    spark: SparkSession
    name: str
    root: str
    buckets: int
    stemmed: bool
    segments: list[Segment] = field(default_factory=list)
    counts: list[str] = field(default_factory=list)
    next_number: int = 0
    _terms: DataFrame | None = None

    def table(self, kind: str) -> str:
        return f"{self.name}_{kind}"

    def close(self) -> None:
        """Take the tables out of the catalogue; index values of this index can not be read afterwards."""
        for kind in ("tokens", "postings", "dead"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table(kind)}")


def _append(index: SegmentedIndex, kind: str, rows: DataFrame, folders: list[str], sort: str) -> None:
    rows.repartition(index.buckets, "chunk_id").write.mode("append").bucketBy(index.buckets, "chunk_id").sortBy(sort).partitionBy(*folders).option(
        "path", f"{index.root}/{kind}").saveAsTable(index.table(kind))


def _store_counts(index: SegmentedIndex, counts: DataFrame, label: str) -> str:
    path = f"{index.root}/terms/{label}-{uuid.uuid4().hex}"
    counts.select("segment", "term", F.col("df").cast("long").alias("df")).write.parquet(path)
    return path


def create(chunks: DataFrame, stem: bool = True, buckets: int | None = None) -> SegmentedIndex:
    """An index whose first segment is ``chunks``. The number of buckets stays for life: name one for the size that is expected."""
    spark = chunks.sparkSession
    if buckets is None:
        n = chunks.count()
        buckets = max(min(spark.sparkContext.defaultParallelism, 1 + n // 100), n // keyword.CHUNKS_PER_BUCKET)
    index = SegmentedIndex(spark, table_name("segments"), scratch_path(spark, "segments"), buckets, stem)
    return append(index, chunks)


def append(index: SegmentedIndex, chunks: DataFrame) -> SegmentedIndex:
    """The index with one further segment; only the new chunks are analyzed. No chunks leave it as it is."""
    number = index.next_number
    lists = keyword.token_lists(chunks, index.stemmed).withColumn("segment", F.lit(number))
    _append(index, "tokens", lists, ["segment"], "chunk_id")
    own = index.spark.table(index.table("tokens")).filter(F.col("segment") == number)
    n, t = keyword.corpus_totals(own)
    if not n:
        return replace(index, next_number=number + 1)
    _append(index, "postings", keyword.postings_of(own).withColumn("segment", F.lit(number)), ["segment", "folder"], "term")
    new = keyword.term_frequencies(index.spark.table(index.table("postings")).filter(F.col("segment") == number))
    path = _store_counts(index, new.withColumn("segment", F.lit(number)), "added")
    return replace(
        index, segments=[*index.segments, Segment(number, n, t)], counts=[*index.counts, path], next_number=number + 1, _terms=None)


def _rows(index: SegmentedIndex, kind: str, segments: list[Segment]) -> DataFrame:
    """Rows of the segments without those of deleted chunks. Tombstones meet their rows in the bucket, or are sent if measured small."""
    rows = index.spark.table(index.table(kind)).filter(F.col("segment").isin([s.number for s in segments]))
    holed = [s.number for s in segments if s.n_dead]
    if not holed:
        return rows
    dead = index.spark.table(index.table("dead")).filter(F.col("segment").isin(holed)).select(
        F.col("chunk_id").alias("dead_chunk"), F.col("segment").alias("dead_segment"))
    # the segment is no join key, so that buckets by chunk alone are enough
    same = (F.col("chunk_id") == F.col("dead_chunk")) & (F.col("segment") - F.col("dead_segment") == 0)
    return rows.join(broadcast_if_small(dead), same, "left_anti")


def delete(index: SegmentedIndex, doomed: DataFrame) -> SegmentedIndex:
    """The index without the chunks of the doomed documents: tombstones and negative counts are written, nothing else.

    Token lists are sorted by chunk, whose id begins with the document's, so few ids are looked up by row groups.
    """
    ids = materialize(doomed.select("document_id").distinct(), "doomed")
    few = [r[0] for r in ids.limit(keyword.IN_TERMS + 1).collect()]
    if not index.segments or not few:
        return index
    rows = _rows(index, "tokens", index.segments)
    rows = rows.filter(F.col("document_id").isin(few)) if len(few) <= keyword.IN_TERMS else rows.join(broadcast_if_small(ids), "document_id", "left_semi")
    gone = materialize(rows, "gone")
    sums = {r["segment"]: r for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("t")).collect()}
    if not sums:
        return index
    _append(index, "dead", gone.select("chunk_id", "segment"), ["segment"], "chunk_id")
    less = gone.select("segment", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("segment", "term").agg((-F.count("*")).alias("df"))
    path = _store_counts(index, less, "deleted")
    segments = [
        replace(s, n_dead=s.n_dead + sums[s.number]["n"], dead_tokens=s.dead_tokens + sums[s.number]["t"]) if s.number in sums else s
        for s in index.segments
    ]
    return replace(index, segments=segments, counts=[*index.counts, path], _terms=None)


def _due(segments: list[Segment], factor: int, dead_share: float) -> list[Segment]:
    """The segments to merge next: a size class that is full, or one segment with too many deleted chunks."""
    classes: dict[int, list[Segment]] = {}
    for s in segments:
        classes.setdefault(int(math.log(max(s.live, 1), factor) + 1e-9), []).append(s)
    for size in sorted(classes):
        if len(classes[size]) >= factor:
            return classes[size]
    return next(([s] for s in segments if s.n_dead > dead_share * s.n_chunks), [])


def merge(index: SegmentedIndex, factor: int = FACTOR, dead_share: float = DEAD_SHARE) -> SegmentedIndex:
    """Merge segments by size until no class is full: each chunk is rewritten once per class, so about log(chunks) times in all.

    A merge reads and writes only its own segments and leaves their deleted chunks out; counts are added up, not counted again.
    """
    while due := _due(index.segments, factor, dead_share):
        number, numbers = index.next_number, {s.number for s in due}
        kept = [s for s in index.segments if s.number not in numbers]
        n, t = sum(s.live for s in due), sum(s.n_tokens - s.dead_tokens for s in due)
        if not n:
            index = replace(index, segments=kept, _terms=None)
            continue
        _append(index, "tokens", _rows(index, "tokens", due).withColumn("segment", F.lit(number)), ["segment"], "chunk_id")
        _append(index, "postings", _rows(index, "postings", due).withColumn("segment", F.lit(number)), ["segment", "folder"], "term")
        path = _store_counts(index, _summed(index, due).withColumn("segment", F.lit(number)), "merged")
        index = replace(index, segments=[*kept, Segment(number, n, t)], counts=[*index.counts, path], next_number=number + 1, _terms=None)
    return index


def _summed(index: SegmentedIndex, segments: list[Segment]) -> DataFrame:
    """(term, df) over the segments, from their stored counts."""
    rows = index.spark.read.schema("segment int, term string, df long").parquet(*index.counts)
    return rows.filter(F.col("segment").isin([s.number for s in segments])).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def searchable(index: SegmentedIndex) -> keyword.KeywordIndex:
    """The live rows as an index for every search of ``keyword``; statistics are those of an index built from the live chunks."""
    if not index.segments:
        raise ValueError("the index holds no chunk")
    if index._terms is None:
        index._terms = materialize(_summed(index, index.segments), "terms")
    return keyword.KeywordIndex(
        _rows(index, "tokens", index.segments).drop("segment"), _rows(index, "postings", index.segments).drop("segment"), index._terms,
        sum(s.live for s in index.segments), sum(s.n_tokens - s.dead_tokens for s in index.segments), index.stemmed)
