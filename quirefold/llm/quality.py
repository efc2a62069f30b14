"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Statistics are counted over whole texts in Arrow batches. The fit needs, for each class, a count, a sum and a sum of outer
products, which every partition adds up for itself, so all learnable labels are used and nothing grows on the driver. A class
covariance is shrunk towards the pooled one and that towards its diagonal. The score is the logistic of the difference of
the classes' log densities, each from a Mahalanobis distance by the cached inverse Cholesky factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quirefold.llm.common import crc32_of_id, give_back, pieces, small_batches, spread, utf8
from quirefold.session import materialize

FOLDS = 5
CUT = 0.3
TO_POOLED = 0.1
TO_DIAGONAL = 0.05
SYMBOLS = b"#$%&*@^~_=+<>{}[]\\/"


def _classes() -> np.ndarray:
    """Byte classes as rows of a 0/1 table: lower, upper, digit, stop, comma, exclamation, bar, symbol, other ASCII mark, high byte."""
    groups = [
        range(97, 123), range(65, 91), range(48, 58), b".?", b",;:", b"!", b"|", SYMBOLS, b"\"'()-`", range(128, 256),
    ]
    found = np.zeros((len(groups), 256))
    for k, group in enumerate(groups):
        found[k, list(group)] = 1
    return found


CLASSES = _classes()
#: Shares of the byte classes in plain prose, and the weight in bytes that they have in every text, so that the statistics
#: of very short texts stay near those of prose.
USUAL = np.array([0.78, 0.02, 0.001, 0.012, 0.008, 0.0, 0.0, 0.0, 0.001, 0.02])
PRIOR_BYTES = 200
REACH = 5.0
NAMES = [
    "lower", "upper", "digit", "stop", "comma", "exclaim", "bar", "symbol", "mark", "high", "word_length", "word_spread",
    "long_words", "distinct_words", "top_word", "doubled_words", "lines", "distinct_lines", "shouted",
]


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of one text; null and empty texts have those of a text without any content."""
    text = text or b""
    n = len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = CLASSES @ histogram
    words, lines = text.split(), text.split(b"\n")
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    shares = np.log(1000 * (classes + PRIOR_BYTES * USUAL) / (n + PRIOR_BYTES) + 1)
    count = len(words)
    return [
        *shares.tolist(), np.log((lengths.sum() + 20 * 5) / (count + 20)),
        np.log(((lengths - lengths.mean()) ** 2).sum() / (count + 20) + 1),
        np.log(1000 * float((lengths > 15).sum()) / (count + 100) + 1), np.log((len(seen) + 20) / (count + 30)),
        np.log((max(seen.values(), default=0) + 2) / (count + 40)),
        np.log(1000 * sum(map(bytes.__eq__, words, words[1:])) / (count + 40) + 1), np.log((len(lines) + 1) / (count + 40)),
        np.log((len(set(lines)) + 10) / (len(lines) + 10)),
        np.log(1000 * float(classes[1] + 5) / (classes[0] + classes[1] + PRIOR_BYTES) + 1),
    ]


@dataclass
class Model:
    """Means, inverse Cholesky factors, half log determinants and log priors of the classes 0 and 1."""

    shift: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    half_logdet: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, in [0, 1]."""
        z = np.clip((x - self.shift) / self.scale, -REACH, REACH)  # beyond, a text is no less like one class than the other
        density = [
            self.log_prior[c] - self.half_logdet[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1)
            for c in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(counts: np.ndarray, sums: np.ndarray, outer: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """The model from each class's count, sum and sum of outer products. A class without rows takes the other's shape, and
    without any labels every score is the prior, one half."""
    d = sums.shape[1]
    total = max(1.0, counts.sum())
    shift = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(outer.sum(axis=0)) / total - shift**2, 1e-6))
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        if counts[c]:
            mean = sums[c] / counts[c]
            means[c] = (mean - shift) / scale
            scatter[c] = (outer[c] - counts[c] * np.outer(mean, mean)) / np.outer(scale, scale)
    pooled = scatter.sum(axis=0) / total
    factors, half = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        own = scatter[c] / counts[c] if counts[c] else pooled
        weight = min(1.0, max(to_pooled, 2 * d / max(1.0, counts[c])))  # few rows: mostly the pooled shape
        cov = (1 - weight) * own + weight * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * (np.diag(np.diag(cov)) + 0.01 * np.eye(d))
        chol = np.linalg.cholesky(cov + 1e-6 * np.eye(d))
        factors[c], half[c] = np.linalg.inv(chol), np.log(np.diag(chol)).sum()
    if not counts.all():
        means[:], factors[:], half[:] = means.sum(axis=0), factors[0], half[0]
    return Model(shift, scale, means, factors, half, np.log((counts + 1) / (counts.sum() + 2)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)``: the statistics of every row's whole text."""
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = [statistics(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("x", ArrayType(DoubleType())))


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    return crc32_of_id(id_col) % folds == 0


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = FOLDS) -> Model:
    """Fits on every labelled row of ``stats(doc_id, x)`` outside the held-out fold.

    Labels other than 0 and 1, and rows without an id, teach nothing. The driver gets two classes' moments, of one size for any input.
    """
    d = len(NAMES)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    rows = stats.filter(~held_out()).join(known, "doc_id").select("label", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                own = x[label == c]
                moments[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(moments.size)), pa.array(moments.ravel())], names=["slot", "value"]
        )

    slots = rows.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    moments = np.zeros(2 * (1 + d + d * d))
    for row in slots:
        moments[row["slot"]] = row["value"]
    moments = moments.reshape(2, -1)
    return fit(moments[:, 0], moments[:, 1:1 + d], moments[:, 1 + d:].reshape(2, d, d))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, empty and null texts too, by their statistics.

    Repeated label rows count as often as they occur, repeated documents and null ids are scored like any other, without labels
    every score is one half, an empty table gives no rows, and further columns are not read.
    """
    with small_batches(docs.sparkSession):
        stats = materialize(features(docs, id_col, text_col), "statistics")
    model = train(stats, labels, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(model.score(x), 9))], names=["doc_id", "score"])

    found = stats.mapInArrow(run, stats.select("doc_id").schema.add("score", "double"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows that the classifier accepts, columns as they are, whatever their names.

    Null and empty texts, repeated rows and null ids are judged like any other. The statistics are counted again, as a
    filter, rather than joined to the texts, so the texts are neither shuffled nor sent back from Python.
    """
    with small_batches(docs.sparkSession):
        stats = materialize(features(docs, id_col, text_col), "statistics")
    model = train(stats, labels, id_col)

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([statistics(t) for t in utf8(texts)]).reshape(-1, len(NAMES))
            yield pa.array(np.round(model.score(x), 9) >= cut)
        give_back()

    return spread(docs).filter(good(F.col(f"`{text_col}`")))
