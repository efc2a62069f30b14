"""Benchmark decontamination: an FM-index per shard of the training texts, searched backward for the benchmark's windows.

A shard is one bounded Arrow batch of a partition. Its index holds the words that the benchmark knows; any other word is a
separator, and runs shorter than the shortest window are left out, since no window can occur there. Occurrences are
located through sampled suffix positions and merged into removal spans. The texts are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import LOWER, pieces, share, shared, small_batches, spans_of, spread, text_key, utf8
from quirefold.llm.fmindex import FMIndex
from quirefold.session import broadcast_if_small, materialize

WINDOW = 13
SHARE = 20
#: Size of a block of the benchmark: bytes of its texts and ``WINDOW_BYTES`` for each word, since a window begins at nearly every word.
BLOCK_BYTES = 64 << 20
WINDOW_BYTES = 128
#: Longer items are cut into pieces that overlap by a window less one word.
PIECE_WORDS = 1 << 14
SHARD_BYTES = 8 << 20
#: Words are runs of digits, lower-case letters and all bytes from 0x80.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)
JVM_WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
WORD_PATTERN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
RESULT = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


@dataclass
class Phrases:
    """The benchmark's distinct windows as word numbers, and the items that hold each: those of window k lie from ``first[k]`` to ``first[k + 1]``."""

    words: dict[bytes, int]
    table: np.ndarray
    lengths: np.ndarray
    names: list[str]
    first: np.ndarray
    holders: np.ndarray

    def items(self, k: int) -> list[str]:
        return [self.names[i] for i in self.holders[self.first[k]:self.first[k + 1]].tolist()]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


def phrases_of(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    numbers: dict[bytes, int] = {}
    names: dict[str | None, int] = {}
    tables, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
    for item, text in rows:
        found = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text.encode() if text else None)]
        if not found:
            continue
        codes = np.array(found + [0] * (window - len(found)), np.int32)
        tables.append(np.lib.stride_tricks.sliding_window_view(codes, window))
        owners.append(np.full(len(tables[-1]), names.setdefault(item, len(names)), np.int64))
    every, owner = np.concatenate(tables), np.concatenate(owners)
    if not len(every):
        return Phrases(numbers, every.astype(np.int64), owner, [], np.zeros(1, np.int64), owner)
    rows_as_one = np.ascontiguousarray(every).view(np.dtype((np.void, every.dtype.itemsize * window))).ravel()
    _, at, which = np.unique(rows_as_one, return_index=True, return_inverse=True)
    table = every[at].astype(np.int64)
    pairs = np.unique(which.ravel() * len(names) + owner)
    window_of, holders = pairs // len(names), pairs % len(names)
    named = holders != names.get(None, -1)  # items without an id count as hits but have no name
    window_of, holders = window_of[named], holders[named]
    first = np.searchsorted(window_of, np.arange(len(table) + 1))
    return Phrases(numbers, table, (table > 0).sum(axis=1), ["" if n is None else n for n in names], first, holders)


def scan(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its words, the merged spans of words inside an occurrence, the items with an occurring window."""
    get = phrases.words.get
    coded, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = words_of(text)
        counts[k] = len(found)
        coded.append(np.fromiter([get(w, 0) for w in found], np.int32, len(found)))
        coded.append(np.zeros(1, np.int32))
    out = [(int(n), [], []) for n in counts]
    if not len(phrases.table) or not counts.any():
        return out
    symbols = np.concatenate(coded)
    del coded
    bounds = np.concatenate(([0], np.cumsum(counts + 1)))
    starts, ends = spans_of(symbols > 0)
    long = ends - starts >= phrases.lengths.min()
    keep = np.zeros(len(symbols) + 1, np.int8)
    keep[starts[long]] += 1
    keep[ends[long] + 1] -= 1  # with the separator behind the run
    place = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
    if not len(place):
        return out
    index = FMIndex(symbols[place], len(phrases.words) + 1)
    low, high = index.search(phrases.table, phrases.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    if not len(which):
        return out
    rows = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    at = place[index.locate(rows)]
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    for a, b in zip(*spans_of(np.cumsum(cover[:-1]) > 0)):
        doc = int(np.searchsorted(bounds, a, "right")) - 1
        out[doc][1].append((int(a - bounds[doc]), int(b - bounds[doc])))
    doc = np.searchsorted(bounds, at, "right") - 1
    for key in np.unique(doc * len(phrases.table) + which).tolist():
        out[key // len(phrases.table)][2].extend(phrases.items(key % len(phrases.table)))
    return [(n, spans, sorted(set(items))) for n, spans, items in out]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark in blocks whose size is measured and bounded before one is collected and sent to the tasks.

    Repeated rows count once and long items are cut, so no row is large, unless a single word is. Rows are dealt to many small
    buckets, and buckets that fit together by their measured sizes make a block.
    """
    words = F.regexp_extract_all("text", F.lit(JVM_WORDS), 0)
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropDuplicates()
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE_WORDS))
    cut = (
        rows.filter("text is not null").select("item", words.alias("words")).filter("size(words) > 0")
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at") + 1, PIECE_WORDS + window - 1).alias("words"))
        .select("item", F.array_join("words", " ").alias("text"), (F.size("words") * WINDOW_BYTES).alias("size"))
        .withColumn("size", F.col("size") + F.octet_length("text"))
    )
    total = int(cut.agg(F.sum("size").alias("b")).first()["b"] or 0)
    if total <= block_bytes:
        yield phrases_of([(r["item"], r["text"]) for r in cut.collect()], window)
        return
    buckets = F.pmod(F.xxhash64("item", "text"), F.lit(8 * -(-total // block_bytes)))
    dealt = materialize(cut.withColumn("bucket", buckets), "benchmark")
    sizes = dealt.groupBy("bucket").agg(F.sum("size").alias("b")).orderBy("bucket").collect()  # eight rows a block
    groups, room = [], 0
    for bucket, size in sizes:
        if not groups or size > room:
            groups.append([])
            room = block_bytes
        groups[-1].append(bucket)
        room -= size
    for group in groups:
        yield phrases_of([(r["item"], r["text"]) for r in dealt.filter(F.col("bucket").isin(group)).collect()], window)


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(doc_id, text_key, n_words, spans, items)``, one row per row of ``docs``; spans are word ranges, sorted and apart.

    Null and empty texts have no words. An item without words matches nothing; items without an id count as hits but are not
    listed. A benchmark beyond ``block_bytes`` is searched for block by block and the blocks' spans are merged; repeated rows of
    the benchmark count once, and an item of any length is cut into pieces that hold all its windows.
    """
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = rows.select("doc_id", text_key("text").alias("text_key"), "text")
    parts = []
    for phrases in _blocks(benchmark, item_col, item_text_col, window, block_bytes):
        parts.append(_scanned(rows, share(docs.sparkSession, phrases)))
    return parts[0] if len(parts) == 1 else _merged(parts)


def _scanned(rows: DataFrame, phrases) -> DataFrame:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared(phrases)
        for batch in pieces(batches, SHARD_BYTES):
            found = scan(utf8(batch.column("text")), known)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], span),
                pa.array([i for _, _, i in found], pa.list_(pa.string())),
            ], names=["doc_id", "text_key", "n_words", "spans", "items"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key string, {RESULT}")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Spans and items of several benchmark blocks, joined per document; the few spans are grouped, not the texts."""
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    hits = materialize(hits, "hits")
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))), F.expr("cast(array() as array<struct<start:int,end:int>>)"),
        lambda acc, x: F.when(
            F.try_element_at(acc, F.lit(-1))["end"] >= x["start"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"),
            ))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return hits.groupBy("doc_id", "text_key", "n_words").agg(
        merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count("*") / len(parts)).cast("int").alias("rows"),
    ).select("doc_id", "text_key", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "rows")).alias("row")).drop("row")


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def contaminated(share: int = SHARE):
    """At least one word in ``share`` lies inside an occurrence."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode()
    places = [m.span() for m in WORD_PATTERN.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return (b"".join(out) + raw[at:]).decode()


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    action: str = "drop", share: int = SHARE, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without contaminated documents (``drop``) or without their spans (``cut``); other documents stay untouched.

    What happens to a document depends on its text alone, so decisions are found per distinct text and joined by its key
    (broadcast only if measured small). Columns stay as they are, whatever their names; null and empty texts stay, repeated
    rows share their fate, an empty benchmark leaves everything.
    """
    found = scan_documents(docs, benchmark, text_col, text_col, item_col, item_text_col, window, block_bytes)
    with small_batches(docs.sparkSession):
        bad = materialize(
            found.filter(contaminated(share)).select(F.col("text_key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__key"]),
            "contaminated",
        )
    if action == "drop":
        return docs.join(broadcast_if_small(bad.select("__key")), F.col("__key") == text_key(text_col), "left_anti")
    cut = F.udf(lambda text, spans: cut_spans(text, [tuple(x) for x in spans]), "string")
    joined = docs.join(broadcast_if_small(bad), F.col("__key") == text_key(text_col), "left")
    text = F.when(F.col("__key").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.coalesce("__spans", F.array())))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
