"""Language identification with a byte convolutional network, written and trained in numpy.

A window of ``WINDOW`` bytes is embedded byte by byte; filters of several widths slide over it, each keeps its highest response,
and a softmax over these gives the languages' probabilities. The net is trained on windows of labelled texts, a bounded sample
per language. A document is cut into windows from end to end, batched into matrices, and its prediction is the
language with the highest mean probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import crc32_of_id, pieces, spread, utf8
from quirefold.session import broadcast_if_small, materialize

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
FOLDS, HELD = 4, 2
#: Bounds of the training sample: documents per language, windows per document.
TRAIN_DOCS = 1500
TRAIN_WINDOWS = 6
EPOCHS = 6
BATCH = 128
RATE = 4e-3
SEED = 7
UNKNOWN = "und"
APPLY_ROWS = 32


@dataclass
class Net:
    """Byte embedding, one filter matrix and bias per width, softmax weights, and the languages of its outputs."""

    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    langs: list[str]

    @staticmethod
    def fresh(langs: list[str], seed: int = SEED) -> Net:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return Net(
            rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5, [make(w * EMBED, FILTERS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], make(FILTERS * len(WIDTHS), len(langs)), np.zeros(len(langs), np.float32), langs,
        )

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.out, self.out_bias]

    def forward(self, windows: np.ndarray, keep: bool = False):
        """Probabilities of the windows (rows of bytes); with ``keep`` also what the gradient needs."""
        n, length = windows.shape
        x = self.embed[windows].reshape(n, length * EMBED)
        pooled, kept = [], []
        for width, weights, bias in zip(WIDTHS, self.filters, self.biases):
            steps = length - width + 1
            rows = np.lib.stride_tricks.as_strided(
                x, (n, steps, width * EMBED), (x.strides[0], EMBED * x.itemsize, x.itemsize), writeable=False
            )
            response = rows.reshape(n * steps, width * EMBED) @ weights
            response = response.reshape(n, steps, FILTERS)
            if keep:
                best = response.argmax(axis=1)
                kept.append(best)
                top = np.take_along_axis(response, best[:, None, :], axis=1)[:, 0]
            else:
                top = response.max(axis=1)
            pooled.append(np.maximum(top + bias, 0))
        hidden = np.concatenate(pooled, axis=1)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        return (p, hidden, x, kept) if keep else p

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in a filter, the filters' response to each of the 256 bytes there."""
        return [
            [np.ascontiguousarray(self.embed @ part) for part in weights.reshape(width, EMBED, FILTERS)]
            for width, weights in zip(WIDTHS, self.filters)
        ]

    def predict(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """``forward`` with the products of embedding and filters looked up instead of computed for every byte."""
        columns = np.ascontiguousarray(windows.T)
        pooled = []
        for parts, bias in zip(tables, self.biases):
            steps = len(columns) - len(parts) + 1
            response = parts[0][columns[:steps]]
            for k, part in enumerate(parts[1:], 1):
                response += part[columns[k:k + steps]]
            pooled.append(np.maximum(response.max(axis=0) + bias, 0))
        logits = np.concatenate(pooled, axis=1) @ self.out + self.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def gradient(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean cross-entropy by parameter, in the order of ``params``."""
        p, hidden, x, kept = self.forward(windows, keep=True)
        n = len(windows)
        d = p.copy()
        d[np.arange(n), labels] -= 1
        d /= n
        d_hidden = (d @ self.out.T) * (hidden > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_biases = [], []
        for k, (width, weights, best) in enumerate(zip(WIDTHS, self.filters, kept)):
            dh = d_hidden[:, k * FILTERS:(k + 1) * FILTERS]
            d_biases.append(dh.sum(axis=0))
            places = best[:, :, None] + np.arange(width)  # bytes that gave each filter its highest response
            codes = windows[np.arange(n)[:, None, None], places]
            rows = self.embed[codes].reshape(n, FILTERS, width * EMBED)
            d_filters.append(np.einsum("nfi,nf->if", rows, dh))
            back = dh[:, :, None] * weights.T[None]
            np.add.at(d_embed, codes.ravel(), back.reshape(-1, EMBED))
        return [d_embed, *d_filters, *d_biases, hidden.T @ d, d.sum(axis=0)]


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, the last one filled up with zeros."""
    n = max(1, -(-len(text) // length))
    out = np.zeros(n * length, np.uint8)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, length)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS) -> Net:
    """Adam on shuffled batches, deterministic; small samples are passed over more often, up to a fixed number of steps."""
    net, rng = Net.fresh(langs), np.random.default_rng(SEED)
    first, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    per_epoch = max(1, -(-len(windows) // BATCH))
    epochs = max(epochs, min(40, 300 // per_epoch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            batch = windows[rows].copy()
            # windows of short texts end in zeros: a share of the batch is cut so that the net knows such windows
            for row, end in zip(np.flatnonzero(rng.random(len(batch)) < 0.3), rng.integers(12, WINDOW, len(batch))):
                batch[row, end:] = 0
            step += 1
            rate = RATE * min(1.0, 1.5 - step / (epochs * per_epoch))
            for p, g, m, v in zip(net.params(), net.gradient(batch, labels[rows]), first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int = TRAIN_DOCS) -> DataFrame:
    """``(lang, windows)``: windows spread evenly over the texts of up to ``docs_per_lang`` documents of each language.

    Which documents is decided by a hash of the id; the held-out fold and rows without a language or text teach nothing. A
    language with many documents is first thinned by the hash to about twice the bound, so that what meets in the
    task that ranks it is of one size at any scale.
    """
    text = F.col(text_col).cast("string").cast("binary")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("raw")).filter(
        F.col("lang").isNotNull() & (F.octet_length("raw") > 0) & (crc32_of_id("doc_id") % FOLDS != HELD)
    )
    counts = materialize(rows.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n")), "languages")
    chance = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 32) - 1))) / float(1 << 32)
    rows = rows.join(broadcast_if_small(counts), F.col("lang") == F.col("__lang")).filter(chance * F.col("__n") < 2 * docs_per_lang)
    span = F.greatest(F.octet_length("raw") - WINDOW, F.lit(0))
    taken = rows.select("lang", F.xxhash64("doc_id").alias("h"), F.transform(
        F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)),
        lambda k: F.substring("raw", (F.floor(span * k / (TRAIN_WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW)),
    ).alias("windows")).withColumn("windows", F.array_distinct("windows"))
    best = Window.partitionBy("lang").orderBy("h")
    return taken.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= docs_per_lang).orderBy("lang", "h").select("lang", "windows")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = TRAIN_DOCS) -> Net | None:
    """The net trained on a bounded sample of labelled rows; None without any."""
    rows = sample(docs, id_col, text_col, lang_col, docs_per_lang).toArrow().to_pydict()
    langs = sorted(set(rows["lang"]))
    if not langs:
        return None
    number = {x: k for k, x in enumerate(langs)}
    windows = np.concatenate([windows_of(w)[:1] for ws in rows["windows"] for w in ws])
    labels = np.array([number[x] for x, ws in zip(rows["lang"], rows["windows"]) for _ in ws])
    # languages count alike, however many rows each has: those with few are repeated
    counts = np.bincount(labels, minlength=len(langs))
    rng = np.random.default_rng(SEED)
    order = np.concatenate([rng.permutation(np.resize(np.flatnonzero(labels == k), counts.max())) for k in range(len(langs))])
    return train(windows[order], labels[order], langs)


def classify(net: Net, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Best language and its mean probability over all windows, each window weighted by its bytes."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    owner = np.repeat(np.arange(len(texts)), counts)
    weight = np.full(len(owner), float(WINDOW))
    weight[np.cumsum(counts) - 1] = [len(t) - (c - 1) * WINDOW or 1 for t, c in zip(texts, counts.tolist())]
    windows = np.concatenate([windows_of(t) for t in texts])
    total, tables = np.zeros((len(texts), len(net.langs))), net.tables()
    for at in range(0, len(windows), APPLY_ROWS):
        part = slice(at, at + APPLY_ROWS)
        np.add.at(total, owner[part], net.predict(windows[part], tables) * weight[part, None])
    mean = total / np.bincount(owner, weight)[:, None]
    best = mean.argmax(axis=1)
    return best, mean[np.arange(len(texts)), best]


def identify(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row; texts that are null or have no letter are ``und`` with score 0.

    Ties go to the first language by name. Without a net (no labels) all texts are ``und``. Repeated rows and null ids are
    predicted like any other, an empty table gives no rows, and further columns are not read.
    """
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select(
        "doc_id", (crc32_of_id("doc_id") % FOLDS == HELD).alias("held_out"),
        F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = utf8(batch.column(2))
            live = [k for k, t in enumerate(texts) if t is not None and net is not None]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if live:
                best, score = classify(net, [texts[k] for k in live])
                scores[live] = np.clip(np.round(score, 6), 0, 1)
                for k, b in zip(live, best.tolist()):
                    langs[k] = net.langs[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    return rows.mapInArrow(run, rows.select("doc_id", "held_out").schema.add("lang_pred", "string").add("score", "double"))
