"""Ranks and rank curves as column expressions. Lists are partitions; ties of a value go by `pos`, so sorts are stable."""

from __future__ import annotations

from pyspark.sql import Column, Window as W, functions as F


def midrank(value: Column, *partition: str) -> Column:
    """0-based ascending rank, ties averaged."""
    of = W.partitionBy(*partition)
    return F.rank().over(of.orderBy(value)) - 1 + (F.count("*").over(W.partitionBy(*partition, value)) - 1) / 2


def _last_change(value: Column, partition: list[str], first_counts: bool) -> tuple[Column, Column, Column]:
    """Position, the position of the last value change before it (null if none), and the list's length."""
    order = W.partitionBy(*partition).orderBy(value.desc(), F.col("pos"))
    k = F.row_number().over(order)
    changed = F.lag(value).over(order) != value
    if first_counts:
        changed = F.coalesce(changed, F.lit(True))
    return k, F.when(changed, k), F.count("*").over(W.partitionBy(*partition))


def rank_curve(df, value: str, partition: list[str], max_rank: float = 1000, percentile: float = 10):
    """df with `rank`: points that fall from max_rank to half of it up to the percentile, and to 0 from there; equal values share them."""
    k, change, n = _last_change(F.col(value), partition, False)
    df = df.withColumn("_k", k).withColumn("_cp", change).withColumn("_n", n)
    order = W.partitionBy(*partition).orderBy("_k")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_both", F.when(F.col("_cp").isNotNull(), F.struct("_cp", F.max("_cp").over(before).alias("_prev"))))
    df = df.withColumn("_last", F.max("_both").over(before)).withColumn("_cp1", F.col("_last._cp")).withColumn("_cp2", F.col("_last._prev")).drop("_both", "_last")
    half, th = F.floor(F.lit(max_rank) / 2), F.col("_n") * percentile / 100
    upper = F.greatest(F.lit(0.0), max_rank - F.col("_cp1") * half / th)
    lower = F.greatest(F.lit(0.0), half - F.greatest(F.lit(0.0), F.col("_cp1") - th) * half / (F.col("_n") - th))
    rank = F.when(F.col("_cp1").isNull(), F.lit(float(max_rank))).when(F.col("_cp2").isNull() | (F.col("_cp2") < th), upper).otherwise(lower)
    return df.withColumn("rank", rank).drop("_k", "_cp", "_n", "_cp1", "_cp2")


def change_rank(df, value: str, partition: list[str], max_rank: float = 1000):
    """df with `rank`: max_rank less the last position before the row where the value changed; the first row is a change."""
    k, change, _ = _last_change(F.col(value), partition, True)
    df = df.withColumn("_k", k).withColumn("_cp", change)
    before = F.max("_cp").over(W.partitionBy(*partition).orderBy("_k").rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("rank", max_rank - F.coalesce(before, F.lit(0))).drop("_k", "_cp")


def ordinal_points(value: Column, *partition: str) -> Column:
    """n + 1 for the best, then one less each, without ties."""
    return F.count("*").over(W.partitionBy(*partition)) + 2 - F.row_number().over(W.partitionBy(*partition).orderBy(value.desc(), F.col("pos")))
