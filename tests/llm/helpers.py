"""Rows that every operator has to take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta eta iota rho tau phi chi psi nu xi mu".split()


def prose(rng: random.Random, lines: int, words: int = 12) -> str:
    return "\n".join(" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", str(rng.randrange(99))]) for _ in range(words)) + "." for _ in range(lines))


def odd_documents(seed: int = 1) -> list[tuple]:
    """Documents with shared passages, copies, near copies and every odd case."""
    rng = random.Random(seed)
    passage = prose(rng, 6)
    texts = [prose(rng, rng.randrange(1, 12)) for _ in range(20)]
    texts += [texts[0], texts[0], texts[1] + " extra", passage, prose(rng, 2) + "\n" + passage, passage + "\n" + prose(rng, 3)]
    texts += [None, None, "", " \n\t ", "word", "ümläut ñ 漢字 É", "A" * 30000, prose(rng, 1, 4000), "\n".join(["same line of six words here"] * 40)]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t) if t is not None else None) for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[4], "en", "a", 1), (None, None, None, None, None), (5, "another text under a used id", "en", "b", 3)]


def frame(spark: SparkSession, rows: list[tuple], schema: str = SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def clashing(df: DataFrame) -> DataFrame:
    """The same rows with extra columns named like the operators' own."""
    names = ["fp", "text_key", "fingerprint", "component_id", "score", "x", "n", "id", "idx", "rank", "part", "before", "ids", "queue", "matches", "label"]
    return df.selectExpr("*", *[f"'x' as {n}" for n in names])
