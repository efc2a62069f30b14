"""Target-distribution importance resampling: documents drawn by how much their features look like those of a target corpus.

1. Features (runs of words) of both corpora are hashed into buckets and counted; every task adds up its own counts, so the driver
   gets one number per bucket. A bucket's gain is its log ratio of shares in the target and in the documents.
2. A second pass over the texts adds up each document's gains from the array of gains (its weight); with Gumbel noise from a
   hash of its id this is its score. The scores are persisted in the shared folder.
3. The cutoff of the draw is found by bisection: exact counting jobs over the persisted scores, each of which tests ``CUTS`` values
   at once, then the same over the ids of the rows that tie at the cutoff.
4. Only the drawn rows are sorted, by range; a rank is the number of rows in the ranges before and the place in its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import LOWER, pieces, spread, utf8
from quirefold.session import broadcast_if_small, materialize

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
CUTS = 15

#: Bytes of words after lower-casing; every other byte becomes a blank.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)


def batch_features(texts: list[bytes | None], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the text and bucket of every feature of the batch."""
    words = b" \0 ".join([*((t or b"").translate(WORD_BYTES) for t in texts), b""]).split()
    ends = np.flatnonzero(np.fromiter(map(b"\0".__eq__, words), bool, len(words)))
    n = np.diff(ends, prepend=-1) - 1
    text = np.repeat(np.arange(len(n)), n + 1)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    owners, found = [], []
    for size in range(1, longest + 1):
        runs = words if size == 1 else list(map(b" ".join, zip(*(words[k:] for k in range(size)))))
        last = np.arange(size - 1, len(words))
        whole = inside[last] & (text[: len(last)] == text[last])
        codes = np.fromiter(map(crc32, runs), np.int64, len(runs)) % buckets
        owners.append(text[: len(last)][whole])
        found.append(codes[whole])
    return n, np.concatenate(owners), np.concatenate(found)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features per bucket over all texts: tasks count, the driver gets at most ``buckets`` sums."""
    rows = spread(texts.select(F.col(f"`{text_col}`").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in pieces(batches):
            counts += np.bincount(batch_features(utf8(batch.column(0)), buckets, longest)[2], minlength=buckets)
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for row in rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[row["bucket"]] = row["n"]
    return sums


def bucket_gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of every bucket."""
    buckets = float(len(source))
    t_all, s_all = float(target.sum()) + buckets, float(source.sum()) + buckets
    return np.array([
        math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for t, s in zip(target.tolist(), source.tolist())
    ], np.int64)


def noise(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of seed and id; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_key, n_words, n_features, weight, score)`` of every row, persisted."""
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text")))
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, owner, bucket = batch_features(utf8(batch.column(2)), buckets, longest)
            order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
            sums = np.concatenate(([0], np.cumsum(gains[bucket[order]])))
            ends = np.cumsum(np.bincount(owner, minlength=batch.num_rows))
            starts = np.concatenate(([0], ends[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x.astype(np.int64)) for x in (n, ends - starts, sums[ends] - sums[starts]))],
                names=["doc_id", "text_key", "n_words", "n_features", "weight"],
            )

    schema = rows.select("doc_id", "text_key").schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    return materialize(rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")


def highest_cut(rows: DataFrame, value: Column, want: int, cuts: int = CUTS) -> int:
    """The highest number that at least ``want`` of the rows' whole-numbered values reach, by counting jobs. ``want`` is from 1 to the number of rows."""
    edge = rows.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    low, high = edge["low"], edge["high"]
    while low < high:
        step = max(1, -(-(high - low) // (cuts + 1)))
        tests = list(range(low + step, high + 1, step))
        counts = rows.agg(*[F.count_if(value >= F.lit(c).cast("long")).alias(f"c{k}") for k, c in enumerate(tests)]).first()
        passed = sum(counts[f"c{k}"] >= want for k in range(len(tests)))
        high = tests[passed] - 1 if passed < len(tests) else high
        low = tests[passed - 1] if passed else low
    return low


def _ranked(drawn: DataFrame, take: int) -> DataFrame:
    """``drawn`` with ``rank`` by score, then id; ranks beyond ``take`` are null. The third key splits runs of equal rows."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("text_key"), F.asc("salt")]
    placed = materialize(drawn.withColumn("salt", F.rand(0)).orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "drawn")
    part = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row per range
    before, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((row["part"], before))
        before += row["n"]
    starts = drawn.sparkSession.createDataFrame(offsets, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("part", part).join(broadcast_if_small(starts), "part").withColumn("rank", F.when(rank <= take, rank))


def _drawn(
    docs: DataFrame, target: DataFrame, percent: int, id_col: str, text_col: str, target_text_col: str, buckets: int, longest: int,
    seed: int, min_words: int,
) -> DataFrame:
    gains = bucket_gains(bucket_counts(target, target_text_col, buckets, longest), bucket_counts(docs, text_col, buckets, longest))
    scored = weighted(docs, gains, id_col, text_col, longest, seed)
    eligible = scored.filter(F.col("n_words") >= min_words)
    take = percent * eligible.count() // 100
    columns = ["doc_id", "text_key", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not take:
        return scored.select(*columns, none)
    cut = highest_cut(eligible, F.col("score"), take)
    tied = eligible.filter(F.col("score") == cut)
    more = take - eligible.filter(F.col("score") > cut).count()
    turned = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))  # smaller ids are higher, null ids lowest
    last = highest_cut(tied, turned, more)
    chosen = (F.col("n_words") >= min_words) & ((F.col("score") > cut) | ((F.col("score") == cut) & (turned >= F.lit(last).cast("long"))))
    ranked = _ranked(scored.filter(chosen).select(*columns), take)
    return scored.filter(~chosen).select(*columns, none).union(ranked.select(*columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, min_words: int = MIN_WORDS,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row; ranks 1, 2, 3, ... for the drawn ones, null for the others.

    Drawn are ``percent`` of 100 of the documents with at least ``min_words`` words (rounded down), those of the highest scores, ties by
    smaller id, which has to be a whole number. Null and empty texts have no features and weight 0. Rows that repeat an id tie;
    as many of them are drawn as there is room for, those with fewer features first. Null ids count as the empty id and come
    last in ties. Very long texts are counted as a whole; an empty target leaves the documents' own shares; an empty table
    gives no rows; further columns are not read, whatever their names.
    """
    found = _drawn(docs, target, percent, id_col, text_col, target_text_col, buckets, longest, seed, min_words)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def sample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, min_words: int = MIN_WORDS,
) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they are. Rows of one id and text are drawn together if one of them is."""
    found = _drawn(docs, target, percent, id_col, text_col, target_text_col, buckets, longest, seed, min_words)
    keys = found.filter("rank is not null").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__key"))
    return docs.join(broadcast_if_small(keys), same, "left_semi")
