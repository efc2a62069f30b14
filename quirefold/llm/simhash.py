"""SimHash fingerprints and their classes, by a tiled exact comparison.

Distinct fingerprints are dealt into tiles by their number of set bits. Two fingerprints within ``radius`` bits differ by at
most ``radius`` in that number, so only tiles whose numbers lie that close are compared, each pair of tiles in one
task: an exclusive-or and a bit count per pair, in numpy, after the same bound on the four 16-bit words has skipped most
cells of the tiles. A pair of tiles returns a forest of its links, never all of them, and the forests are joined by
``components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import LOWER, pieces, small_batches, spread, text_key, utf8
from quirefold.llm.components import components
from quirefold.session import broadcast_if_small, materialize

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 1 << 17
LEAST_TILES = 8
MATRIX = 1 << 21


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """A bit is set if more than half of the shingles' hashes set it. No words: 0; fewer than ``words``: one shingle."""
    if not text:
        return 0
    found = text.translate(LOWER).split()
    if not found:
        return 0
    whole = b" ".join(found)
    n = max(1, len(found) - words + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(whole, seed)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    stops = ends[words - 1:].tolist()
    for at in range(0, n, 1 << 14):
        part = [digest(whole[a:b], seed) for a, b in zip(starts[at:at + (1 << 14)], stops[at:at + (1 << 14)])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)`` of every row, ``fp`` as a signed long. Null, empty and blank texts have fingerprint 0."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select(
        "doc_id", text_key("text").alias("text_key"), "text"
    )
    schema = rows.select("doc_id", "text_key").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t) for t in utf8(batch.column(2))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, schema)


def _cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values ordered by the bit counts of their 16-bit words; the cells' counts and bounds."""
    words = np.bitwise_count(np.ascontiguousarray(values).view(np.uint16).reshape(-1, 4)).astype(np.int64)
    key = words @ np.array([4913, 289, 17, 1])
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    return order, words[order][first].astype(np.int8), np.append(first, len(values))


def _flat(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and roots of a forest that joins all values of the tiles within ``radius`` bits.

    ``right`` is None for a tile against itself. The forest has fewer rows than the tiles have values.
    """
    nodes = left if right is None else np.concatenate((left, right))
    parent = np.arange(len(nodes))
    order_l, counts_l, bounds_l = _cells(left)
    order_r, counts_r, bounds_r = (order_l, counts_l, bounds_l) if right is None else _cells(right)
    sorted_l, sorted_r = left[order_l], (left if right is None else right)[order_r]
    shift = 0 if right is None else len(left)

    def join(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal parent
        while len(u):
            ru, rv = parent[u], parent[v]
            apart = ru != rv
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            if not len(u):
                return
            high, low = np.maximum(ru, rv), np.minimum(ru, rv)
            _, once = np.unique(high, return_index=True)
            parent[high[once]] = low[once]
            parent = _flat(parent)

    for cell in range(len(counts_l)):
        begin = cell if right is None else 0
        near = begin + np.flatnonzero(np.abs(counts_r[begin:] - counts_l[cell]).sum(axis=1, dtype=np.int64) <= radius)
        if not len(near):
            continue
        sizes = bounds_r[near + 1] - bounds_r[near]
        steps = np.ones(int(sizes.sum()), np.int64)
        steps[0] = bounds_r[near[0]]
        steps[np.cumsum(sizes)[:-1]] = bounds_r[near[1:]] - bounds_r[near[:-1] + 1] + 1
        index = np.cumsum(steps)
        values = sorted_r[index]
        a, b = bounds_l[cell], bounds_l[cell + 1]
        wide = min(len(values), MATRIX)
        tall = max(1, MATRIX // wide)
        for x in range(a, b, tall):
            rows = sorted_l[x:min(b, x + tall), None]
            for y in range(0, len(values), wide):
                i, j = np.nonzero(np.bitwise_count(rows ^ values[None, y:y + wide]) <= radius)
                if len(i):
                    join(order_l[x + i], shift + order_r[index[y + j]])
    member = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[member], nodes[parent[member]]


def tile_plan(counts: dict[int, int], radius: int, tile_rows: int, least_tiles: int) -> dict[str, list[int]]:
    """For each number of set bits 0..64: first tile, tiles it is dealt over, first and last tile it has to meet.

    Numbers with few fingerprints share a tile; one with many is split evenly, so no tile is hot.
    """
    total = max(1, sum(counts.values()))
    size = max(1, min(tile_rows, -(-total // least_tiles)))
    groups: list[list[int]] = []
    filled = 0
    for bits in range(65):
        n = counts.get(bits, 0)
        if not groups or filled + n > size:
            groups.append([])
            filled = 0
        groups[-1].append(bits)
        filled += n
    base, split, at, spans = [0] * 65, [1] * 65, 0, []
    for group in groups:
        tiles = max(1, -(-sum(counts.get(b, 0) for b in group) // size)) if len(group) == 1 else 1
        for bits in group:
            base[bits], split[bits] = at, tiles
        spans.append((group[0], group[-1], at, at + tiles - 1))
        at += tiles
    first, last = [0] * 65, [0] * 65
    for lo, hi, _, _ in spans:
        met = [s for s in spans if s[0] - hi <= radius and lo - s[1] <= radius]
        for bits in range(lo, hi + 1):
            first[bits], last[bits] = met[0][2], met[-1][3]
    return {"base": base, "split": split, "first": first, "last": last}


def links(classes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, least_tiles: int = LEAST_TILES) -> DataFrame:
    """Edges ``(u, v)`` that connect all distinct fingerprints ``classes(fp)`` within ``radius`` bits."""
    bits = F.bit_count("fp")
    counts = {r["b"]: r["n"] for r in classes.groupBy(bits.alias("b")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    plan = {k: F.array(*map(F.lit, v)) for k, v in tile_plan(counts, radius, tile_rows, least_tiles).items()}
    at = {k: F.get(v, F.col("bits")) for k, v in plan.items()}
    tiles = classes.select("fp", bits.alias("bits")).select(
        "fp", (at["base"] + F.pmod(F.xxhash64("fp"), at["split"].cast("long")).cast("int")).alias("tile"),
        at["first"].alias("first"), at["last"].alias("last"),
    )
    met = tiles.select("fp", "tile", F.explode(F.sequence("first", "last")).alias("other"))
    pairs = met.select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "fp")

    def run(key, group):
        a, b = (k.as_py() for k in key)
        fp = group.column("fp").to_numpy().view(np.uint64)
        tile = group.column("tile").to_numpy()
        member, root = forest(fp[tile == a], None if a == b else fp[tile == b], radius)
        return pa.table({"u": member.view(np.int64), "v": root.view(np.int64)})

    return pairs.groupBy("a", "b").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)``: one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits, null only if every id of
    the class is null. Repeated rows are repeated in the result; an empty table gives an empty one. Null and empty texts have
    fingerprint zero and are linked like any other; very long texts count with all their shingles; further columns are not read.
    """
    with small_batches(docs.sparkSession):
        prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(links(classes, radius)).select(F.col("node").alias("fp"), "root")
    rooted = materialize(classes.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    linked = rooted.join(
        rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root"
    ).select("fp", "component_id")
    return prints.join(linked, "fp").select("doc_id", "text_key", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each class left: that of the smallest id (null ids last), then text key.

    Null, empty and blank texts form one class; of repeated rows one stays; an empty table stays empty. Columns stay as
    they are, whatever their names.
    """
    found = materialize(
        near_duplicates(docs, id_col, text_col, radius).groupBy("doc_id", "text_key", "fp", "component_id")
        .agg(F.count("*").alias("n")), "near-duplicates",
    )
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("text_key"))
    class_of = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    first = found.groupBy(class_of.alias("class")).agg(F.min(order).alias("keep"))
    marks = materialize(
        found.withColumn("class", class_of).join(first, "class").withColumn(
            "later", ~(F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.text_key") == F.col("text_key")))
        ).filter("later or n > 1")
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("later").alias("__later")), "later-copies",
    )
    marked = docs.withColumn("__key2", text_key(text_col)).join(
        broadcast_if_small(marks), F.col("__id").eqNullSafe(F.col(id_col)) & (F.col("__key") == F.col("__key2")), "left"
    )
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.filter("__later is null").select(*columns)
    if marks.filter("not __later").isEmpty():
        return kept
    return kept.union(marked.filter("not __later").dropDuplicates([id_col, "__key2"]).select(*columns))
