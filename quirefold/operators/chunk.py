"""Chunking: prose windows, table-row packing and numbering, one document row at a time.

All blocks of a document travel in one row, so a chunk's number is its position in the
flattened array of pieces: the whole step is a projection without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.functions import text as tx
from quirefold.functions.ids import child_id


@dataclass(frozen=True)
class TokenRate:
    """Token estimate ``words * num // den + add``; the default is 1.6 per word plus one."""

    num: int = 8
    den: int = 5
    add: int = 1

    def estimate(self, n_words: Column) -> Column:
        return F.floor(n_words * self.num / self.den).cast("int") + self.add

    def most_words(self, budget: Column) -> Column:
        return F.floor(((budget - self.add + 1) * self.den - 1) / self.num).cast("int")


DEFAULT_RATE = TokenRate()


def context_header(title: Column, heading: Column) -> Column:
    """"[title — heading]" or "[title]", with a line end; goes in front of the embedded text only."""
    named = heading.isNotNull() & (heading != "")
    return F.concat(F.lit("["), title, F.when(named, F.concat(F.lit(" — "), heading)).otherwise(""), F.lit("]\n"))


def prose_window(header: Column, rate: TokenRate = DEFAULT_RATE, max_tokens: int = fv.MAX_TOKENS) -> Column:
    """Most words whose token estimate still fits beside the header; at least one."""
    return F.greatest(rate.most_words(F.lit(max_tokens) - rate.estimate(tx.word_count(header))), F.lit(1))


def prose_pieces(words: Column, window: Column, overlap: int = fv.OVERLAP_WORDS) -> Column:
    """Overlapping word windows; the last one ends with the text."""

    def cut(s: Column) -> Column:
        w, size = s["w"], s["n"]
        step = F.greatest(size - overlap, F.lit(1))
        last = F.greatest(F.ceil((F.size(w) - size) / step).cast("int"), F.lit(0))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
        )

    return tx.let(F.struct(words.alias("w"), window.alias("n")), cut)


RUNS = "array<struct<start:int,n:int>>"


def row_runs(counts: Column, head: Column, rate: TokenRate, max_tokens: int) -> Column:
    """Runs of table rows (1-based line number and length) whose words, with those of the head, fit the budget; at least one row each.

    One pass over the rows' word counts that keeps where the run began and what it holds. A run is added to the result when it
    ends, so beside the pass the work is the square of the number of runs, which the cap on uploads bounds.
    """
    no_runs = F.array().cast(RUNS)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), head.alias("used"), no_runs.alias("runs"))
    run = lambda s: F.array(F.struct((s["start"] + 2).alias("start"), (s["i"] - s["start"]).alias("n")))

    def step(state: Column, n: Column) -> Column:
        full = (state["i"] > state["start"]) & (rate.estimate(state["used"] + n) > max_tokens)
        return F.struct(
            (state["i"] + 1).alias("i"), F.when(full, state["i"]).otherwise(state["start"]).alias("start"),
            (F.when(full, head).otherwise(state["used"]) + n).alias("used"), F.when(full, F.concat(state["runs"], run(state))).otherwise(state["runs"]).alias("runs"))

    return F.aggregate(counts, start, step, lambda s: F.when(s["i"] > s["start"], F.concat(s["runs"], run(s))).otherwise(s["runs"]))


def chunk_prose(docs: DataFrame, heading: Column | None = None, rate: TokenRate = DEFAULT_RATE,
                overlap: int = fv.OVERLAP_WORDS, max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """Chunks of documents that are one prose block each (document_id, title, text)."""
    header = context_header(F.col("title"), F.lit(None).cast("string") if heading is None else heading)
    staged = docs.select("document_id", header.alias("_h"), tx.words(F.col("text")).alias("_w"))
    pieces = prose_pieces(F.col("_w"), prose_window(F.col("_h"), rate, max_tokens), overlap)
    return _finish(tx.numbered(staged, ["document_id", F.lit(None).cast("string").alias("location"), "_h"], pieces, "seq", "text"))


def _piece(block: Column, text: Column) -> Column:
    return F.struct(block["h"].alias("h"), block["location"].alias("location"), text.alias("text"))


def _estimated(staged: DataFrame, rate: TokenRate, overlap: int, max_tokens: int) -> tuple[DataFrame, Column]:
    """The pieces of each block by estimated sizes."""
    body = lambda b: F.slice(b["lines"], F.lit(2), F.greatest(F.size(b["lines"]) - 1, F.lit(0)))
    head = lambda b: tx.word_count(F.concat(b["h"], F.coalesce(F.get(b["lines"], F.lit(0)), F.lit(""))))
    sized = F.transform("_b", lambda b: tx.let(head(b), lambda h: row_runs(F.transform(body(b), tx.word_count), h, rate, max_tokens)))
    staged = staged.withColumn("_runs", sized)
    table_pieces = lambda b, runs: F.transform(
        runs, lambda r: F.concat(F.get(b["lines"], F.lit(0)), F.lit("\n"), F.array_join(F.slice(b["lines"], r["start"], r["n"]), "\n"))
    )
    return staged, F.zip_with("_b", "_runs", lambda b, runs: F.transform(
        F.when(b["is_table"], table_pieces(b, runs)).otherwise(prose_pieces(b["words"], prose_window(b["h"], rate, max_tokens), overlap)),
        lambda t: _piece(b, t)))


def chunk_documents(parsed: DataFrame, rate: TokenRate = DEFAULT_RATE, overlap: int = fv.OVERLAP_WORDS,
                    max_tokens: int = fv.MAX_TOKENS, count=None) -> DataFrame:
    """Chunks of parsed documents (document_id, title, blocks), numbered across their blocks.

    ``blocks`` is the ordered array of (text, kind, location, heading). Sizes are estimated from word counts, or
    counted by ``count``, a tokenizer's function of a text.
    """
    is_table = lambda b: b["kind"] == "table"
    empty = F.array().cast("array<string>")
    staged = parsed.select("document_id", "title", "blocks").withColumn(
        "_b",
        F.transform("blocks", lambda b: F.struct(
            context_header(F.col("title"), b["heading"]).alias("h"),
            b["location"].alias("location"),
            is_table(b).alias("is_table"),
            F.when(is_table(b), empty).otherwise(tx.words(b["text"])).alias("words"),
            F.when(is_table(b), tx.text_lines(b["text"])).otherwise(empty).alias("lines"),
        )),
    )
    if count is None:
        staged, cut = _estimated(staged, rate, overlap, max_tokens)
    else:
        whole = F.transform("blocks", lambda b: b["text"])
        split = F.transform("_b", lambda b: F.when(b["is_table"], b["lines"]))
        staged = staged.withColumn("_pieces", counted_pieces(count, max_tokens, overlap)(F.transform("_b", lambda b: b["h"]), whole, split))
        cut = F.zip_with("_b", "_pieces", lambda b, ts: F.transform(ts, lambda t: _piece(b, t)))
    pieces = F.flatten(cut)
    exploded = tx.numbered(staged, ["document_id"], pieces, "seq", "p")
    return _finish(exploded.select("document_id", "seq", F.col("p.location").alias("location"), F.col("p.h").alias("_h"), F.col("p.text").alias("text")))


def _finish(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        child_id(F.col("document_id"), F.col("seq")).alias("chunk_id"),
        "document_id", "seq", "text", F.concat("_h", "text").alias("embed_text"), "location",
    )


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that produced no chunk, with the reason they fail."""
    return docs.join(chunks.filter(F.col("seq") == 0), "document_id", "left_anti").select(
        "document_id", F.lit("failed").alias("status"), F.lit(fv.NO_TEXT).alias("error")
    )


def furthest(fits, at: int, end: int, guess: int) -> int:
    """The highest place from ``at`` + 1 to ``end`` up to which a piece ``fits``, at least ``at`` + 1, tried first at ``guess`` more.

    Steps away from the guess double until they straddle the answer and are then bisected, so a good guess takes two tries.
    """
    low, step = at + 1, 1  # has to do, whether or not it fits
    place = max(low, min(end, at + guess))
    if place == low or fits(place):
        low = place
        while low < end:
            high = min(end, low + step)
            if not fits(high):
                break
            low, step = high, 2 * step
        else:
            return low
    else:
        high = place
        while high - step > low:
            if fits(high - step):
                low = high - step
                break
            high, step = high - step, 2 * step
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def counted_prose(words: list[str], budget: int, overlap: int, count) -> list[str]:
    """Overlapping windows of words whose count is within the budget."""
    found, at, length = [], 0, 64
    while at < len(words):
        end = furthest(lambda e: count(" ".join(words[at:e])) <= budget, at, len(words), length)
        found.append(" ".join(words[at:end]))
        if end == len(words):
            break
        length = end - at
        at = max(end - overlap, at + 1)
    return found


def counted_rows(lines: list[str], header: str, max_tokens: int, count) -> list[str]:
    """Runs of rows under the first one whose count, header included, fits."""
    found, at, length = [], 1, 16
    while at < len(lines):
        end = furthest(lambda e: count(header + "\n".join([lines[0], *lines[at:e]])) <= max_tokens, at, len(lines), length)
        found.append("\n".join([lines[0], *lines[at:end]]))
        at, length = end, end - at
    return found


def counted_pieces(count, max_tokens: int = fv.MAX_TOKENS, overlap: int = fv.OVERLAP_WORDS):
    """UDF for a real tokenizer: the pieces of every block of a document under ``count``, any growing counter of a text.

    Prose is cut into word windows whose count fits beside the header, rows are grouped under the first one. Each end is looked
    for from the length of the piece before, so a text is counted a few times over, whatever its length.
    """

    def of_block(header: str, text: str, lines) -> list[str]:
        return counted_prose(text.split(), max_tokens - count(header), overlap, count) if lines is None else counted_rows(list(lines), header, max_tokens, count)

    @F.pandas_udf("array<array<string>>")
    def pieces(headers: pd.Series, texts: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([[of_block(h, t, ls) for h, t, ls in zip(hs, ts, lss)] for hs, ts, lss in zip(headers, texts, lines)])

    return pieces
