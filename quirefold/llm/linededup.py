"""Line dedup: a suffix array over line ids by distributed prefix doubling, in DataFrame operations only.

A line of a document is deleted if it lies in a run of consecutive lines, together of at least ``min_words`` words, that
occurs earlier in the corpus (smaller document id, null ids last, then text hash, then line number). Blank lines do not count and stay.
Only runs of whole, equal lines are repeats. Where a later occurrence overlaps the earliest one in the same document, only the
lines behind the earliest go, so that a run is never deleted for being a copy of itself.

1. Lines get 128-bit ids; only ids that occur twice can be part of a repeated run, and only gapless stretches of such
   lines with enough words are kept.
2. Ranks of the runs of 1, 2, 4, ... lines: the pairs (rank of a run, rank of the run that follows it) are sorted by
   range, and their place in that order is the rank of the doubled run. Runs that occur once drop out in each round.
3. A repeated run of enough words is the union of its shortest sub-runs of enough words: the shortest from each of its
   lines on, and the shortest up to its last line. For each of these, of m lines, the positions with the same two overlapping ranks of the largest power of
   two within m are a longest-common-prefix interval of depth m. All but the earliest position of an interval are
   later copies. Such sub-runs have at most ``min_words`` lines, so the doubling ends after log2(min_words) rounds,
   however long the repeats are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import broadcast_if_small, materialize

MIN_WORDS = 50
BLANKS = " \t\r\x0b\f"
DOC = ["doc_id", "k1"]


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, k1, idx, ln, id1, id2, w)`` of every line that is not blank; ``k1`` tells texts under one id apart."""
    numbered = F.transform(
        line_array(F.col(text_col)), lambda line, at: F.struct(at.alias("ln"), F.btrim(line, F.lit(BLANKS)).alias("line"))
    )
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("k1"),
        F.posexplode(F.filter(numbered, lambda x: F.length(x["line"]) > 0)).alias("idx", "at"),
    ).select(
        *DOC, "idx", F.col("at.ln").alias("ln"), F.xxhash64("at.line").alias("id1"), F.xxhash64("at.line", F.lit(1)).alias("id2"),
        F.size(F.split("at.line", r"\s+")).alias("w"),
    )


def _ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct keys with a rank in their order: sorted by range, numbered by place. Written once, so that ranks stay."""
    return materialize(keys.orderBy(*cols).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _same_doc(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.k1") == F.col(f"{right}.k1"))


def _candidates(lines: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, k1, idx, m)``: shortest runs of enough words, forward from and backward to each line, without gaps."""
    by_line = Window.partitionBy(*DOC).orderBy("idx")
    placed = lines.withColumn("n", F.row_number().over(by_line)).withColumn("after", F.sum("w").over(by_line)).withColumn(
        "before", F.col("after") - F.col("w")
    )
    ahead = Window.partitionBy(*DOC).orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*DOC).orderBy("after").rangeBetween(-(min_words - 1), 0)
    found = placed.withColumn("to", F.max(F.struct("n", "idx", "after")).over(ahead)).withColumn(
        "from", F.min(F.struct("n", "idx", "before")).over(back)
    )
    forward = found.filter(
        (F.col("to.after") - F.col("before") >= min_words) & (F.col("to.idx") - F.col("idx") == F.col("to.n") - F.col("n"))
    ).select(*DOC, "idx", (F.col("to.idx") - F.col("idx") + 1).alias("m"))
    backward = found.filter(
        (F.col("after") - F.col("from.before") >= min_words) & (F.col("idx") - F.col("from.idx") == F.col("n") - F.col("from.n"))
    ).select(*DOC, F.col("from.idx").alias("idx"), (F.col("idx") - F.col("from.idx") + 1).alias("m"))
    return forward.union(backward).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, k1, lines)``: sorted numbers of the lines to delete, for the documents that have any.

    Rows that share an id and a text count as one document. Null and empty texts have no lines.
    """
    lines = materialize(line_table(docs, id_col, text_col), "lines")
    shared = _ranked(lines.groupBy("id1", "id2").agg(F.count("*").alias("n")).filter("n > 1").select("id1", "id2"), "id1", "id2")
    alive = materialize(
        lines.join(shared, ["id1", "id2"]).select(*DOC, "idx", "ln", "w", "rank").dropDuplicates([*DOC, "idx"]), "alive"
    )
    runs = materialize(_candidates(alive, min_words), "runs")
    longest = runs.agg(F.max("m").alias("m")).first()["m"] or 0
    inside = runs.select(*DOC, F.explode(F.sequence(F.col("idx"), F.col("idx") + F.col("m") - 1)).alias("idx")).distinct()
    state = materialize(
        alive.alias("a").join(inside.alias("b"), _same_doc("a", "b") & (F.col("a.idx") == F.col("b.idx")), "left_semi"), "suffixes"
    )
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "idx")
    later, h = [], 1
    while h <= longest:
        # intervals of depth m, h <= m < 2h, by the ranks of their first and last h lines
        keyed = materialize(
            runs.filter((F.col("m") >= h) & (F.col("m") < 2 * h)).alias("r")
            .join(state.select(*DOC, "idx", "rank").alias("a"), _same_doc("r", "a") & (F.col("r.idx") == F.col("a.idx")))
            .join(state.select(*DOC, "idx", "rank").alias("b"), _same_doc("r", "b") & (F.col("r.idx") + F.col("m") - h == F.col("b.idx")))
            .select("r.doc_id", "r.k1", "r.idx", "m", F.col("a.rank").alias("r1"), F.col("b.rank").alias("r2")),
            "keyed",
        )
        first = materialize(
            keyed.groupBy("m", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "intervals"
        )
        kept_to = F.col("first.idx") + F.col("m")  # what a copy shares with the occurrence that stays is no part of it
        own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.k1") == F.col("k1")) & (F.col("idx") < kept_to)
        begin = F.when(own, kept_to).otherwise(F.col("idx"))
        later.append(materialize(
            keyed.join(first, ["m", "r1", "r2"]).filter(place != F.col("first")).select(*DOC, begin.alias("idx"), (F.col("idx") + F.col("m") - 1).alias("end")), "copies"
        ))
        if 2 * h <= longest:
            next_rank = F.max("rank").over(Window.partitionBy(*DOC).orderBy("idx").rangeBetween(h, h))
            pairs = state.withColumn("r2", next_rank).filter("r2 is not null").withColumnRenamed("rank", "r1")
            doubled = _ranked(pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2"), "r1", "r2")
            state = materialize(pairs.join(doubled, ["r1", "r2"]).select(*DOC, "idx", "rank"), "suffixes")
        h *= 2
    if not later:
        return lines.limit(0).groupBy(*DOC).agg(F.sort_array(F.collect_set("ln")).alias("lines"))
    copies = reduce(DataFrame.union, later).filter(F.col("idx") <= F.col("end")).select(*DOC, F.explode(F.sequence("idx", "end")).alias("idx"))
    numbers = alive.select(*DOC, "idx", "ln").alias("a").join(
        copies.distinct().alias("b"), _same_doc("a", "b") & (F.col("a.idx") == F.col("b.idx")), "left_semi"
    )
    return numbers.groupBy(*DOC).agg(F.sort_array(F.collect_set("ln")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from the texts and the columns ``__lines`` (all lines that are
    not blank) and ``__deleted`` added. Null texts stay null, all rows stay, other columns stay as they are.

    Deletions are joined by document (broadcast only if measured small), so the texts are not shuffled for a few of them.
    """
    gone = materialize(repeated_lines(docs, id_col, text_col, min_words), "deletions").select(
        F.col("doc_id").alias("__id"), F.col("k1").alias("__k1"), F.col("lines").alias("__gone")
    )
    text = F.col(f"`{text_col}`")
    joined = docs.withColumn("__k", F.xxhash64(text)).join(
        broadcast_if_small(gone), F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__k1")), "left"
    )
    left = F.array_join(F.filter(line_array(text), lambda line, at: ~F.array_contains("__gone", at)), "\n")
    kept = F.when(F.col("__gone").isNull(), text).otherwise(left)
    full = F.size(F.filter(line_array(F.coalesce(text, F.lit(""))), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        full.cast("long").alias("__lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__deleted"),
    )
