"""Top-k and fusion helpers shared by the search legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import fixed_values as fv
from quirefold.session import broadcast_if_small, materialize

SCORE_DIGITS = 9


def stable(score: Column) -> Column:
    """Scores rounded for ordering: sums in another order must not change a rank."""
    return F.round(score, SCORE_DIGITS)


def top_k(df: DataFrame, key: str, k: int, order: list[Column], rank: str = "rnk") -> DataFrame:
    """The first ``k`` rows per key with their 1-based rank.

    Spark pushes the rank limit below the shuffle, so each input partition sends at most
    ``k`` rows per key and no task holds all rows of a key.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def place_in_group(df: DataFrame, key: str, order: str, place: str) -> DataFrame:
    """Number the rows of each ``key`` in the order of the unique ``order``, also where one key has most of the rows.

    Rows are sorted by range, so a large key lies in several ranges; a range knows how many rows of the key lie in earlier ones.
    """
    ranged = materialize(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part", key).agg(F.count("*").alias("_n"))  # a range has the ends of two keys and whole keys between
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("_part", key, before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part", key).orderBy(order))
    numbered = ranged.withColumn("_at", within).join(broadcast_if_small(bases), ["_part", key])
    return numbered.select(*df.columns, (F.col("_before") + F.col("_at")).cast("int").alias(place))


def fuse(legs: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = fv.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rnk) legs, in the order given.

    ``first_seen`` is the earliest (leg, rank) of a chunk and decides ties.
    """
    union = None
    for i, (name, leg) in enumerate(legs.items()):
        weight = 1.0 if weights is None else weights[name]
        part = leg.select(
            "query_id", "chunk_id", (F.lit(weight) / (F.col("rnk") + k)).alias("w"),
            (F.lit(i).cast("long") * (1 << 40) + F.col("rnk")).alias("seen"),
        )
        union = part if union is None else union.unionByName(part)
    return union.groupBy("query_id", "chunk_id").agg(F.sum("w").alias("score"), F.min("seen").alias("first_seen"))


def ranked(fused: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of fused results per query: ranks offset+1 … offset+limit."""
    out = top_k(fused, "query_id", offset + limit, [stable(F.col("score")).desc(), F.asc("first_seen")])
    return out.filter(F.col("rnk") > offset)
