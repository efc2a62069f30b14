"""Substring search by runs of three letters, confirmed exactly.

Distinct lower-case texts are stored once, in blocks of neighbours; a table says which runs of three letters a block has, in folders by run
and sorted by it. A question looks up its rarest run only, and the texts of the blocks found are compared with it in full. Places (keys,
values, cells) lie in folders by their text, so the ones of a text that was found are read there. Questions of fewer than three letters
read all distinct texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.operators.keyword import IN_TERMS
from quirefold.session import broadcast_if_small, foldered, materialize

GRAM = 3
FOLDERS = 32
#: Questions without a run of three letters are compared with every distinct text, so many at a time.
SHORT_BLOCK = 500
#: Texts of a block, as a power of two. Neighbours in the order of texts share most of their runs, so a block has far fewer rows than its texts had.
BLOCK_BITS = 8
#: Totals that ``search`` adds up, and what adds up their parts.
PARTS = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass
class SubstringIndex:
    """``places(…, low, folder)``, ``texts(block, low)``, ``grams(gram, folder, block)`` and ``counts(gram, n)``, the number of blocks."""

    places: DataFrame
    texts: DataFrame
    grams: DataFrame
    counts: DataFrame


def _folder(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def grams_of(low: Column) -> Column:
    """The distinct runs of three letters; a shorter text has none."""
    cut = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substr(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def build(places: DataFrame, text: str = "text") -> SubstringIndex:
    """An index over the column ``text`` of ``places``, which keeps its other columns. Null texts are in no answer."""
    low = places.filter(F.col(text).isNotNull()).withColumn("low", F.lower(F.col(text)))
    stored = foldered(low.withColumn("folder", _folder(F.col("low"))), "places", "folder", "low")
    in_order = stored.select("low").distinct().sortWithinPartitions("low")
    texts = materialize(in_order.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "texts")
    rows = texts.select("block", F.explode(grams_of(F.col("low"))).alias("gram")).distinct().withColumn("folder", _folder(F.col("gram")))
    grams = foldered(rows, "grams", "folder", "gram")
    return SubstringIndex(stored, texts, grams, materialize(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts"))


def _pruned(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows in the folders of the wanted keys, and of few keys only their row groups."""
    folders = [r[0] for r in keys.select(_folder(F.col(key))).distinct().collect()]
    few = [r[0] for r in keys.select(key).distinct().limit(IN_TERMS + 1).collect()]
    rows = rows.filter(F.col("folder").isin(folders))
    return rows.filter(F.col(key).isin(few)) if len(few) <= IN_TERMS else rows


def _long(needles: DataFrame, index: SubstringIndex) -> DataFrame:
    """(needle, low) of needles that have a run: of the blocks of the rarest one, if every run is known, the texts that hold the needle."""
    runs = needles.select("needle", grams_of(F.col("needle")).alias("g")).select("needle", F.size("g").alias("n_runs"), F.explode("g").alias("gram"))
    known = index.counts.join(broadcast_if_small(runs), "gram").groupBy("needle", "n_runs").agg(
        F.count("*").alias("found"), F.min(F.struct("n", "gram")).alias("rarest"))
    anchors = materialize(known.filter("found = n_runs").select("needle", F.col("rarest.gram").alias("gram")), "anchors")
    candidates = _pruned(index.grams, anchors, "gram").join(broadcast_if_small(anchors), "gram").select("needle", "block")
    met = index.texts.join(broadcast_if_small(materialize(candidates, "candidates")), "block")
    return met.filter(F.col("low").contains(F.col("needle"))).select("needle", "low")


def _short(needles: DataFrame, index: SubstringIndex) -> DataFrame | None:
    """The same for needles without a run, by blocks that read every distinct text."""
    n_blocks = -(-needles.count() // SHORT_BLOCK)
    found = None
    for block in range(n_blocks):
        own = [r[0] for r in needles.filter(F.pmod(F.xxhash64("needle"), F.lit(n_blocks)) == block).collect()]
        if own:
            held = F.filter(F.array(*map(F.lit, own)), lambda x: F.col("low").contains(x))
            rows = index.texts.select(F.explode(held).alias("needle"), "low")
            found = rows if found is None else found.unionByName(rows)
    return found


def matching_texts(needles: DataFrame, index: SubstringIndex) -> DataFrame:
    """(needle, low): distinct texts that hold each lower-case needle."""
    needles = materialize(needles.select("needle").distinct(), "needles")
    found = _long(needles.filter(F.length("needle") >= GRAM), index)
    short = _short(needles.filter(F.length("needle") < GRAM), index)
    return found if short is None else found.unionByName(short)


def search(queries: DataFrame, index: SubstringIndex, by: list[str] | None = None, totals: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``query_id`` and the columns of the places whose text holds ``q`` of ``queries(query_id, q)``, without regard to case.

    An empty ``q`` is held by every text, a null one by none. A place is found once for each question that it answers.
    With ``totals`` (name: one of ``PARTS`` and a column of the places) the places are not listed but added up, by question and the
    columns ``by``: first per distinct needle, so places are met once for all questions that ask the same.
    """
    asked = materialize(queries.filter("q is not null").select("query_id", F.lower("q").alias("needle")), "asked")
    found = materialize(matching_texts(asked, index), "matching-texts")
    places = _pruned(index.places, found.select("low"), "low").drop("folder")
    if totals is None:
        answers = found.join(broadcast_if_small(asked), "needle").select("query_id", "low")
        return places.join(broadcast_if_small(answers), "low").drop("low")
    by = by or []
    added = [getattr(F, kind)(column).alias(name) for name, (kind, column) in totals.items()]
    merged = [PARTS[kind](F.col(name)).alias(name) for name, (kind, _) in totals.items()]
    sums = places.join(broadcast_if_small(found), "low").groupBy("needle", *by).agg(*added)
    return broadcast_if_small(materialize(sums, "needle-totals")).join(asked, "needle").groupBy("query_id", *by).agg(*merged)
