"""Retrieval quality: recall@k and mean reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import materialize

#: Passages go to the tasks in blocks of at most about so many bytes; a passage is found by its first letters and then compared in full.
PASSAGE_BLOCK_BYTES = 4 << 20
PASSAGE_HEAD = 32


def _holders(passages: dict[str, list[int]]):
    """A task's (query_id, document_id): one automaton over the heads of a block of passages, and every text runs through it once."""
    heads: dict[str, list[str]] = {}
    for passage in passages:
        heads.setdefault(passage[:PASSAGE_HEAD], []).append(passage)
    in_all = heads.pop("", [])  # the empty passage stands in every text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for head, whole in heads.items():
            automaton.add_word(head, (len(head), whole))
        automaton.make_automaton()
        for batch in batches:
            queries, rows = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                found = set(in_all)
                for end, (length, whole) in automaton.iter(text) if heads else ():
                    found.update(p for p in whole if text.startswith(p, end + 1 - length))
                for passage in found:
                    queries += passages[passage]
                    rows += [row] * len(passages[passage])
            yield pa.RecordBatch.from_arrays(
                [pa.array(queries, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64()))], names=["query_id", "document_id"])

    return run


def holders(documents: DataFrame, passages: DataFrame, block_bytes: int = PASSAGE_BLOCK_BYTES) -> DataFrame:
    """(query_id, document_id) of the documents (document_id, text) that hold a passage (query_id, q) letter by letter.

    The work is the documents' letters once per block of passages, however many words they share; nothing is shuffled.
    """
    asked = materialize(passages.select("query_id", "q"), "passages")
    size = asked.agg(F.sum(F.octet_length("q") + 8).alias("b")).first()["b"] or 0
    n_blocks, out = -(-int(size) // block_bytes), None
    for block in range(n_blocks):
        known: dict[str, list[int]] = {}
        for r in asked.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block).collect():
            known.setdefault(r["q"], []).append(r["query_id"])
        if known:
            part = documents.select(F.col("document_id").cast("long"), "text").mapInArrow(_holders(known), "query_id long, document_id long")
            out = part if out is None else out.unionByName(part)
    return documents.sparkSession.createDataFrame([], "query_id long, document_id long") if out is None else out


def relevant_hits(runs: DataFrame, judgements: DataFrame) -> DataFrame:
    """Hits (…, query_id, rnk, document_id) whose document is judged relevant for the query."""
    return runs.join(judgements.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_semi")


def recall_at_k(queries: DataFrame, runs: DataFrame, judgements: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall): share of the relevant documents among the first k hits; 0 without any."""
    relevant = judgements.groupBy("query_id").agg(F.count_distinct("document_id").alias("relevant"))
    found = relevant_hits(runs.filter(F.col("rnk") <= k), judgements).groupBy("query_id").agg(F.count_distinct("document_id").alias("found"))
    out = queries.select("query_id").join(relevant, "query_id", "left").join(found, "query_id", "left")
    return out.select("query_id", F.when(F.coalesce("relevant", F.lit(0)) == 0, 0.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("relevant")).alias("recall"))


def reciprocal_rank(queries: DataFrame, runs: DataFrame, judgements: DataFrame) -> DataFrame:
    """(query_id, rr): 1 / rank of the first relevant hit, counting every hit; 0 without one."""
    first = relevant_hits(runs, judgements).groupBy("query_id").agg(F.min("rnk").alias("first"))
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def by_mode(queries: DataFrame, runs: dict[str, DataFrame], judgements: DataFrame, k: int = 10) -> DataFrame:
    """(mode, recall, mrr): means over the query set."""
    out = None
    for mode, run in runs.items():
        scored = recall_at_k(queries, run, judgements, k).join(reciprocal_rank(queries, run, judgements), "query_id")
        row = scored.agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr")).select(F.lit(mode).alias("mode"), "recall", "mrr")
        out = row if out is None else out.unionByName(row)
    return out
