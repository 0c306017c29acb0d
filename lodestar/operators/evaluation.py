"""Offline measures. lists: consumer_id, relevant and recommended (arrays of product ids, the latter in order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def precision(lists: DataFrame) -> DataFrame:
    hits = F.size(F.array_intersect("relevant", "recommended"))
    return lists.agg(F.avg(F.when(F.size("recommended") > 0, hits / F.size("recommended")).otherwise(0.0)).alias("precision"))


def recall_precision_f(lists: DataFrame) -> DataFrame:
    both = lists.where((F.size("relevant") > 0) & (F.size("recommended") > 0))
    hits = F.size(F.array_intersect("relevant", "recommended"))
    m = both.agg(F.avg(hits / F.size("recommended")).alias("precision"), F.avg(hits / F.size("relevant")).alias("recall"))
    return m.withColumn("f", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def mean_average_precision(lists: DataFrame) -> DataFrame:
    """Mean over consumers of the sum of precisions at hits, over the number of recommended items. Each list is gone through once."""
    both = lists.where((F.size("relevant") > 0) & (F.size("recommended") > 0))

    def state(hits: Column, place: Column, gain: Column) -> Column:
        return F.struct(hits.alias("hits"), place.alias("place"), gain.alias("gain"))

    def step(so_far: Column, product: Column) -> Column:
        hit, place = F.array_contains("relevant", product), so_far["place"] + 1
        hits = so_far["hits"] + F.when(hit, 1).otherwise(0)
        return state(hits, place, so_far["gain"] + F.when(hit, hits / place).otherwise(0.0))

    gain = F.aggregate("recommended", state(F.lit(0), F.lit(0), F.lit(0.0)), step, lambda s: s["gain"])
    return both.agg(F.avg(gain / F.size("recommended")).alias("map"))


def root_mean_squared_error(pairs: DataFrame) -> DataFrame:
    """pairs: rating, prediction of relevant items."""
    return pairs.agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))).alias("rmse"))


def recommending_time(times: DataFrame) -> DataFrame:
    return times.agg(F.avg("seconds").alias("mean_time"), F.max("seconds").alias("max_time"))


#: Ranges of counts, both ends in.
BUCKETS = ((0, 20), (20, 50), (50, 10000))


def focus_buckets(pairs: DataFrame, consumer: str, product: str) -> DataFrame:
    """pairs with the consumer's and the product's number of events: each in all buckets of either that hold it."""
    def of(c: str):
        return F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(BUCKETS)]), lambda x: F.col(c).between(x["a"], x["b"]))

    return pairs.withColumn("_c", F.explode(of(consumer))).withColumn("_p", F.explode(of(product))).select(*pairs.columns, F.col("_c.i").alias("consumer_bucket"), F.col("_p.i").alias("product_bucket"))


def split_by_date(events: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    return events.where(F.col("ts_sec") <= at), events.where(F.col("ts_sec") > at)
