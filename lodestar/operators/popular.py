"""The most bought products that a consumer has not bought."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def most_bought_unseen(events: DataFrame, n: int) -> DataFrame:
    """events: consumer_id, product_id. consumer_id, rank, product_id, n (the product's events).

    A consumer who has bought m products finds n others among the m + n most bought, so the work follows the number of
    events and not consumers times products. Products are ranked in one small sort, a row for each.
    """
    counts = events.groupBy("product_id").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "product_id")))
    had = events.select("consumer_id", "product_id").distinct()
    asks = had.groupBy("consumer_id").agg(F.count("*").alias("m")).select("consumer_id", F.explode(F.sequence(F.lit(1), (F.col("m") + n).cast("int"))).alias("place"))
    left = asks.join(ranked, "place").join(had, ["consumer_id", "product_id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("consumer_id").orderBy("place"))
    return left.withColumn("rank", rank).where(F.col("rank") <= n).select("consumer_id", "rank", "product_id", "n")
