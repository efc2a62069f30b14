"""Mixture-controlled packing of tokenised documents into sequences of at most ``size`` tokens.

Each source is a queue of documents. Deficit round-robin serves the queues in turns of ``grain`` tokens: a queue's k-th turn
is due at the virtual time (k + 1/2) * grain / weight, when its deficit (what its share of the tokens dealt so far
comes to, less what it was served) has reached half a turn. Windows are cut from the turns in that order, so every
window holds the target proportions up to a turn, and what a window could not give a queue is carried to the next, across
partitions too: the place of a turn in the order of all turns is a function of its number alone, so a task that holds some
documents and knows their places in the queues places their tokens without any state from other tasks. Tokens are never
shuffled, and only the very last window of the corpus is not full.

Sources beyond the queues of the schedule share one, whose turns are dealt to them by a schedule of the same kind, in as many
levels as they need. A queue that runs dry leaves its share to the others. Without weights the shares are those of the corpus, and all
queues last to the end.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import pieces, share, shared, small_batches, spread
from quirefold.session import broadcast_if_small, materialize

SIZE = 2048
END_ID = 1
GRAIN = 128
QUEUES = 256
STEP = 1 << 15
NO_SOURCE = "\0"
#: From about this length on the rank encoder, which is quadratic in a word, is the slower one.
LONG_WORD = re.compile(r"\S{5000}")
#: The splitting pattern of byte-level BPE vocabularies of this family; fixed values.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What else a file of this family may say of its model; any other value changes the ids.
PLAIN_MODEL = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes without one of their own take the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    table.update({chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))})
    return table


@dataclass
class Vocabulary:
    """A ``tokenizers`` file and its highest id; with ``ranks`` if it is a byte-level BPE file whose ids are the order of its merges."""

    text: str
    special: list[str]
    highest: int
    ranks: dict[bytes, int] | None


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The ids of a file's tokens by their bytes if its parts are all of the kind that ranks alone describe, else None.

    That is: byte-level BPE without a normaliser, split by ``SPLIT``, where each token of several bytes is made by one merge and the
    ids of the tokens made rise from merge to merge. Added tokens are not among them.
    """
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or any(model.get(name) for name in PLAIN_MODEL) or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return None
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space", True) or not split.get("use_regex", True):
        return None
    if (spec.get("post_processor") or {"type": "ByteLevel"})["type"] not in ("ByteLevel", "TemplateProcessing"):  # these add special tokens only
        return None
    table, added = _byte_of(), {t["content"] for t in spec.get("added_tokens") or []}
    vocab = {token: k for token, k in model["vocab"].items() if token not in added}
    if not table.keys() <= vocab.keys() or not set().union(*vocab) <= table.keys():
        return None
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in made or any(x >= y for x, y in zip(made, made[1:])) or len(made) + len(table) != len(vocab):
        return None
    if made and made[0] <= max(vocab[c] for c in table):
        return None
    return {bytes(table[c] for c in token): k for token, k in vocab.items()}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Reads the file; ranks are kept if its parts allow."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    added = spec.get("added_tokens") or []
    vocab = spec["model"].get("vocab")
    highest = max([*(t["id"] for t in added), *(vocab.values() if isinstance(vocab, dict) else range(len(vocab or [])))], default=0)
    return Vocabulary(text, [t["content"] for t in added], highest, _ranks(spec))


def encoder(known: Vocabulary) -> Callable[[list[str]], list[np.ndarray]]:
    """Token ids of texts by the ``tokenizers`` file, special tokens not added.

    With ranks, texts go to the faster rank encoder, which is the same function; texts with special tokens' strings
    or with very long words go to the ``tokenizers`` library itself, which is loaded when the first one comes.
    """
    library = []

    def slow(texts: list[str]) -> list[np.ndarray]:
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_str(known.text))
        return [np.array(e.ids, np.uint32) for e in library[0].encode_batch(texts, add_special_tokens=False)]

    if known.ranks is None:
        return slow
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=known.ranks, special_tokens={})
    odd = re.compile("|".join([*map(re.escape, known.special), LONG_WORD.pattern]))
    return lambda texts: [slow([t])[0] if odd.search(t) else np.array(fast.encode_ordinary(t), np.uint32) for t in texts]


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", end_id: int | None = END_ID) -> DataFrame:
    """``(doc_id, source, part, before, n, ids)``: the ids, and the tokens of the same source before them in the partition.

    Ids are little-endian unsigned numbers, of 16 bits if the vocabulary and the end id allow, else of 32.
    """
    rows = spread(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )).select("doc_id", "source", F.spark_partition_id().alias("part"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = vocabulary(path)
    sent = share(docs.sparkSession, known)  # of the size of the vocabulary
    width = "<u2" if max(known.highest, end_id or 0) < 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(shared(sent))
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        had: dict[str, int] = {}
        for batch in pieces(batches):
            before, counts, blobs = [], [], []
            for source, ids in zip(batch.column(1).to_pylist(), encode(batch.column(3).to_pylist())):
                ids = np.concatenate((ids, tail)).astype(width)
                before.append(had.get(source, 0))
                had[source] = before[-1] + len(ids)
                counts.append(len(ids))
                blobs.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "source", "part", "before", "n", "ids"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, source string, part int, before long, n long, ids binary")


class Schedule:
    """The order of the queues' turns. ``totals`` (tokens) and ``weights`` are by queue."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, grain: int = GRAIN):
        self.totals, self.weights, self.grain = totals.astype(np.int64), weights.astype(np.float64), grain

    def due(self, queue: np.ndarray | int, turn: np.ndarray) -> np.ndarray:
        return (2 * turn + 1) * self.grain / (2 * self.weights[queue])

    def place(self, queue: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """How many tokens come before each turn: those of the turns that are due earlier, or at the same time in a queue of a lower number."""
        time = self.due(queue, turn)
        if len(turn) < len(self.weights):  # few turns of many queues: all queues at once
            step = max(1, (1 << 20) // len(self.weights))
            return np.concatenate([self._place(queue[k:k + step, None], turn[k:k + step, None], time[k:k + step, None]) for k in range(0, len(turn), step)])
        before = np.zeros(len(turn), np.int64)
        for other in range(len(self.weights)):
            n = np.maximum(np.floor(time * self.weights[other] / self.grain + 0.5), 0).astype(np.int64)
            first = queue > other  # a turn of this queue that is due at the same time comes first
            while True:  # the estimate may be off by one where floats round
                late = self.due(other, n - 1)
                back = (n > 0) & ((late > time) | (late == time) & ~first)
                soon = self.due(other, n)
                on = ~back & ((soon < time) | (soon == time) & first)
                if not (back.any() or on.any()):
                    break
                n += on.astype(np.int64) - back
            n = np.where(queue == other, turn, n)
            before += np.minimum(n * self.grain, self.totals[other])
        return before

    def _place(self, queue: np.ndarray, turn: np.ndarray, time: np.ndarray) -> np.ndarray:
        others = np.arange(len(self.weights))[None, :]
        n = np.maximum(np.floor(time * self.weights[None, :] / self.grain + 0.5), 0).astype(np.int64)
        first = queue > others
        while True:
            late, soon = self.due(others, n - 1), self.due(others, n)
            back = (n > 0) & ((late > time) | (late == time) & ~first)
            on = ~back & ((soon < time) | (soon == time) & first)
            if not (back | on)[queue != others].any():
                break
            n += on.astype(np.int64) - back
        return np.minimum(np.where(queue == others, turn, n) * self.grain, self.totals[None, :]).sum(1)

    def turns(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts tokens ``first`` to ``first + n`` of queues into turns: row, first token in the queue, length, place among all turns' tokens."""
        begin, end = first // self.grain, (first + n - 1) // self.grain
        row = np.repeat(np.arange(len(n)), end - begin + 1)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(end - begin + 1) - (end - begin + 1), end - begin + 1) + begin[row]
        low = np.maximum(first[row], turn * self.grain)
        length = np.minimum((first + n)[row], (turn + 1) * self.grain) - low
        at = np.concatenate([
            self.place(queue[row[k:k + STEP]], turn[k:k + STEP]) for k in range(0, len(row), STEP)
        ]) + low - turn * self.grain
        return row, low, length, at

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Cuts documents (tokens ``first`` to ``first + n`` of their queues): row, start in the document, length, window, offset."""
        row, low, length, at = self.turns(queue, first, n)
        fits = np.minimum(length, (at // size + 1) * size - at)
        over = np.flatnonzero(length > fits)  # a turn is at most a window long, so it meets one boundary at most
        row, low, length, at = (
            np.concatenate((x, y)) for x, y in (
                (row, row[over]), (low, (low + fits)[over]), (fits, (length - fits)[over]), (at, (at + fits)[over]))
        )
        return joined(row, low - first[row], length, at, size)


def joined(row: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Pieces of a document that follow each other in a window as one: row, start, length, window, offset."""
    order = np.lexsort((start, row))
    row, start, length, at = row[order], start[order], length[order], at[order]
    on = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + length[:-1]) & (at[1:] // size == at[:-1] // size)
    head = np.flatnonzero(np.concatenate(([True], ~on)))
    return row[head], start[head], np.add.reduceat(length, head), at[head] // size, at[head] % size


class Tree:
    """Schedules of schedules: those of node 0 hold the windows; a further node's tokens are one queue of the node above it."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, grain: int, queues: int):
        """``totals`` and ``shares`` are by source; the first ``queues`` of them have a queue in node 0, the others share one more."""
        self.nodes: list[Schedule] = []
        self.above: list[tuple[int, int, int]] = []  # node, queue, depth
        self.node, self.queue = np.zeros(len(totals), np.int64), np.arange(len(totals))
        rest = np.arange(queues, len(totals))
        total = max(1, int(totals.sum()))
        tail = int(totals[rest].sum())
        shares = np.append(shares[:queues], [tail / total] * bool(len(rest)))
        self.nodes.append(Schedule(np.append(totals[:queues], [tail] * bool(len(rest))), np.where(shares > 0, shares, 1e-9) * total, grain))
        self.above.append((-1, -1, 0))
        todo = [(rest, 0, queues)] if len(rest) else []
        fan = max(2, queues + 1)
        while todo:
            own, above, slot = todo.pop()
            node = len(self.nodes)
            self.above.append((above, slot, self.above[above][2] + 1))
            if len(own) <= fan:
                self.node[own], self.queue[own] = node, np.arange(len(own))
                sums = totals[own]
            else:
                groups = [own[k::fan] for k in range(fan)]
                sums = np.array([totals[g].sum() for g in groups])
                todo += [(g, node, k) for k, g in enumerate(groups)]
            self.nodes.append(Schedule(sums, np.maximum(sums, 1e-9), grain))

    def pieces(self, source: np.ndarray, first: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """As those of a schedule, of documents whose tokens are ``first`` to ``first + n`` of their sources."""
        node, queue = self.node[source], self.queue[source]
        if not node.any():
            return self.nodes[0].pieces(queue, first, n, size)
        row, start = np.arange(len(n)), np.zeros(len(n), np.int64)
        depths = np.array([depth for *_, depth in self.above])
        for depth in range(int(depths[node].max()), 0, -1):
            parts = []
            for k in np.unique(node):
                at = np.flatnonzero(node == k)
                if depths[k] < depth:
                    parts.append((row[at], start[at], node[at], queue[at], first[at], n[at]))
                    continue
                own, low, length, place = self.nodes[k].turns(queue[at], first[at], n[at])
                own = at[own]
                above, slot, _ = self.above[k]
                parts.append((row[own], start[own] + low - first[own], np.full(len(own), above), np.full(len(own), slot), place, length))
            row, start, node, queue, first, n = (np.concatenate(x) for x in zip(*parts))
        own, within, length, window, offset = self.nodes[0].pieces(queue, first, n, size)
        return joined(row[own], start[own] + within, length, window * size + offset, size)


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: int = SIZE,
    end_id: int | None = END_ID, weights: dict[str, float] | None = None, grain: int = GRAIN, queues: int = QUEUES, keep_ids: bool = True,
) -> DataFrame:
    """Pieces ``(doc_id, source, start, length, doc_tokens, sequence_id, offset, ids_crc32, ids)``; each id lies in one piece.

    The sources named in ``weights`` and those with the most tokens, ``queues`` - 1 if no more are named, have a queue each; all
    others share one, whose turns they take by schedules of at most ``queues`` queues. The sources' sums pass the driver.
    ``weights`` are target shares by source (those not named: their corpus share); None takes the corpus's shares. Null texts are empty (one piece with the end id), null sources are one source, an empty table has no pieces.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        coded = materialize(tokens(docs, path, id_col, text_col, source_col, end_id), "tokens")
    sums = materialize(coded.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-sums")
    weights = weights or {}
    sources = sorted(
        ((r["source"], int(r["n"])) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()),
        key=lambda x: (x[0] not in weights, -x[1], x[0]),
    )
    own = max(sum(s in weights for s, _ in sources), min(queues - 1, len(sources)))
    sources[:own] = sorted(sources[:own], key=lambda x: (-x[1], x[0]))
    totals = np.array([n for _, n in sources], np.int64)
    total = max(1, int(totals.sum()))
    tree = Tree(totals, np.array([weights.get(s, n / total) for s, n in sources], np.float64), min(grain, size), own)
    named = spark.createDataFrame([(s, k) for k, (s, _) in enumerate(sources)], "source string, queue int")
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    queued = sums.join(broadcast_if_small(named), "source")
    bases = materialize(queued.select("source", "part", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")), "bases")
    placed = coded.join(broadcast_if_small(bases), ["source", "part"])
    sent = share(spark, tree)
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared(sent)
        for batch in pieces(batches):
            n = batch.column("n").to_numpy()
            live = pa.array(np.flatnonzero(n))  # without an end id, empty texts have no piece
            batch, n = batch.take(live), n[n > 0]
            if not len(n):
                continue
            first = batch.column("base").to_numpy() + batch.column("before").to_numpy()
            row, start, length, window, offset = tree.pieces(batch.column("queue").to_numpy(), first, n, size)
            ids = batch.column("ids").to_pylist()
            widths = (np.fromiter(map(len, ids), np.int64, len(ids)) // n).tolist()
            blobs = [
                np.frombuffer(ids[r], f"<u{widths[r]}", k, s * widths[r]).astype("<u4").tobytes()
                for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())
            ]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(take), batch.column("source").take(take), pa.array(start), pa.array(length),
                batch.column("n").take(take), pa.array(window), pa.array(offset), pa.array([zlib.crc32(b) for b in blobs], pa.int64()),
                pa.array(blobs if keep_ids else [None] * len(blobs), pa.binary()),
            ], names=["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "ids"])

    found = placed.mapInArrow(
        run, f"doc_id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long, ids binary"
    )
    return found.withColumn("source", F.nullif("source", F.lit(NO_SOURCE)))
