"""Event logs: counts, differences, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def frequency(events: DataFrame) -> DataFrame:
    return events.groupBy("product_id").agg(F.count("*").alias("freq"))


def frequency_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """How much each product's number of events changed."""
    a, b = frequency(old).withColumnRenamed("freq", "was"), frequency(new)
    return a.join(b, "product_id", "full_outer").select("product_id", (F.coalesce("freq", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("delta")).where("delta != 0")


def keep_last(events: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    w = W.partitionBy("consumer_id").orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def keep_recent(events: DataFrame, seconds: int) -> DataFrame:
    """Events within a time of their consumer's last one."""
    return events.withColumn("_last", F.max("ts_sec").over(W.partitionBy("consumer_id"))).where(F.col("ts_sec") >= F.col("_last") - seconds).drop("_last")


def compared(pairs: DataFrame) -> DataFrame:
    """pairs: product_id, product_id_2, selected. cmp: 1 the first, -1 the second, 0 neither."""
    return pairs.withColumn("cmp", F.when(F.col("selected") == F.col("product_id"), 1).when(F.col("selected") == F.col("product_id_2"), -1).otherwise(0).cast("tinyint"))


def decayed(counts: DataFrame, n: str = "n") -> DataFrame:
    """Every count one less; those of one go."""
    return counts.where(F.col(n) > 1).withColumn(n, F.col(n) - 1)
