"""Filters of candidates. candidates: request_id, pos, consumer_id, product_id; attrs: product_id, attr_idx, attr_name, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def unseen(cands: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates that their consumer has no event with."""
    return cands.join(events.select("consumer_id", "product_id").distinct(), ["consumer_id", "product_id"], "left_anti")


def without_seeds(cands: DataFrame, seeds: DataFrame) -> DataFrame:
    return cands.join(seeds.select("request_id", "product_id").distinct(), ["request_id", "product_id"], "left_anti")


def newest(df: DataFrame, partition: list[str], by: str, n: int) -> DataFrame:
    """The n largest of each partition, ties kept."""
    return df.withColumn("_r", F.rank().over(W.partitionBy(*partition).orderBy(F.desc(by)))).where(F.col("_r") <= n).drop("_r")


def values_of(events: DataFrame, attrs: DataFrame) -> DataFrame:
    return events.join(attrs.select("product_id", "attr_idx", "value"), "product_id")


def blocked_values(events: DataFrame, attrs: DataFrame, windows: dict[str, int], now: Column | int, most: int) -> DataFrame:
    """events: event_name, consumer_id, product_id, ts_sec. (consumer_id, attr_idx, value, expiry) that still block: expiry is the latest event's end of window."""
    window = F.create_map(*[F.lit(x) for kv in windows.items() for x in kv])
    each = values_of(events.where(F.col("event_name").isin(*windows)), attrs).withColumn("expiry", F.col("ts_sec") + window[F.col("event_name")])
    held = each.groupBy("consumer_id", "attr_idx", "value").agg(F.max("expiry").alias("expiry")).where(F.col("expiry") >= now)
    return newest(held, ["consumer_id"], "expiry", most)


def attribute_filter(cands: DataFrame, attrs: DataFrame, blocked: DataFrame) -> DataFrame:
    """Drops candidates with a blocked value, and those without any value."""
    mine = cands.join(attrs.select("product_id", "attr_idx", "value"), "product_id")
    hit = mine.join(blocked.select("consumer_id", "attr_idx", "value"), ["consumer_id", "attr_idx", "value"], "left_semi").select("request_id", "product_id").distinct()
    return cands.join(attrs.select("product_id").distinct(), "product_id", "left_semi").join(hit, ["request_id", "product_id"], "left_anti")


def frequency_filter(cands: DataFrame, events: DataFrame, attrs: DataFrame, threshold: int, skip: tuple[int, ...] = ()) -> DataFrame:
    """Drops candidates whose values the consumer has met more than threshold times in all."""
    counts = values_of(events, attrs).groupBy("consumer_id", "attr_idx", "value").agg(F.count("*").alias("n"))
    met = cands.join(attrs, "product_id").join(counts, ["consumer_id", "attr_idx", "value"]).groupBy("request_id", "product_id", "consumer_id").agg(F.sum("n").alias("n"))
    over = met.where((F.col("n") > threshold) & ~F.col("consumer_id").isin(*skip) if skip else F.col("n") > threshold)
    return cands.join(over.select("request_id", "product_id"), ["request_id", "product_id"], "left_anti")


def negative_rating_filter(cands: DataFrame, ratings: DataFrame, attrs: DataFrame, negative: int, order: list[str]) -> DataFrame:
    """Drops candidates with a value whose latest rating by the consumer is at most `negative`."""
    last = values_of(ratings, attrs).groupBy("consumer_id", "attr_idx", "value").agg(F.max_by("rating", F.struct(*order)).alias("last"))
    hit = cands.join(attrs, "product_id").join(last.where(F.col("last") <= negative), ["consumer_id", "attr_idx", "value"], "left_semi")
    return cands.join(hit.select("request_id", "product_id").distinct(), ["request_id", "product_id"], "left_anti")


def short_programmes(df: DataFrame, least: int, title_word: str = "rodaj", most: int = 3 * 3600) -> DataFrame:
    """df: begin_ts, end_ts, title. Programmes of a fit length whose title has not the word."""
    length = F.col("end_ts") - F.col("begin_ts")
    return df.where(length.between(least, most) & ~F.coalesce(F.col("title").contains(title_word), F.lit(False)))


def series_state(events: DataFrame, order: list[str]) -> DataFrame:
    """events: consumer_id, series, season, episode, ts_sec. The last season, episode and time of each consumer's series; 0 or null keep what was there."""
    key = F.struct(*order)
    known = lambda c: F.max_by(F.when(F.col(c) > 0, F.col(c)), F.when(F.col(c) > 0, key))
    return events.groupBy("consumer_id", "series").agg(F.coalesce(known("season"), F.lit(0)).alias("w_season"), F.coalesce(known("episode"), F.lit(0)).alias("w_episode"), F.max("ts_sec").alias("watched"))


def series_next(cands: DataFrame, state: DataFrame, now: Column, relevant: int, add_others: bool = False) -> DataFrame:
    """cands with series, season, episode. One unseen episode of each series, with prediction and reliability."""
    far = F.lit(2**31 - 1)
    c = cands.where("series IS NOT NULL").withColumn("s", F.coalesce("season", far)).withColumn("e", F.coalesce("episode", far)).join(state, ["consumer_id", "series"], "left")
    seen = F.col("watched").isNotNull() & ((F.col("s") < F.col("w_season")) | ((F.col("s") == F.col("w_season")) & (F.col("e") <= F.col("w_episode"))))
    first = F.row_number().over(W.partitionBy("request_id", "series").orderBy("s", "e", "pos"))
    c = c.where(~seen).withColumn("r", first).where("r = 1")
    follows = state.groupBy("consumer_id").agg(F.count("*").alias("follows"))
    c = c.join(follows, "consumer_id", "left")
    watched, recent = F.col("watched").isNotNull(), F.col("watched") > now - relevant
    same, later = F.col("s") == F.col("w_season"), F.col("s") > F.col("w_season")
    cases = [
        (watched & recent & same & (F.col("e") == F.col("w_episode") + 1), 5.0, 1.0),
        (watched & recent & same, 4.0, 0.8),
        (watched & later & (F.col("e") == 1), 3.0, 0.5),
        (watched & recent & later, 4.0, 1.0),
        (watched & recent, 1.0, 1.0),
        (~watched & (F.col("follows") > 3) & (F.col("s") == 1) & (F.col("e") == 1), 1.0, 0.2),
    ]
    prediction = reliability = F.lit(0.0)
    for when, p, r in reversed(cases):
        prediction, reliability = F.when(when, p).otherwise(prediction), F.when(when, r).otherwise(reliability)
    out = c.select("request_id", "pos", "consumer_id", "product_id", prediction.alias("prediction"), reliability.alias("reliability"))
    others = cands.where("series IS NULL").select("request_id", "pos", "consumer_id", "product_id", F.lit(0.0).alias("prediction"), F.lit(0.0).alias("reliability"))
    return out.unionByName(others) if add_others else out


def series_latest(cands: DataFrame) -> DataFrame:
    """The latest episode of each series."""
    w = W.partitionBy("request_id", "series").orderBy(F.desc_nulls_last("season"), F.desc_nulls_last("episode"), "pos")
    return cands.where("series IS NOT NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def language_caps(history: DataFrame, n: int, unknown: tuple[str, ...] = ("null", "nullnull"), spoken: str = "sl") -> DataFrame:
    """history: consumer_id, language of each event. How many of n items of a language a consumer gets; unknown ones, and those that contain the language spoken by all, have no cap."""
    counts = history.groupBy("consumer_id", "language").agg(F.count("*").alias("n_lang"))
    of = W.partitionBy("consumer_id")
    capped = ~(F.col("language").isin(*unknown) | F.col("language").contains(spoken))
    share = F.round((F.col("n_lang") + 3) / (F.sum("n_lang").over(of) + 3) * n).cast("long") + 1
    return counts.withColumn("max_items", F.when(capped, share)).where(capped)


def within_language_caps(scored: DataFrame, caps: DataFrame) -> DataFrame:
    """scored: request_id, consumer_id, pos, language, prediction. Without the items that the better ones of their language leave no room for."""
    place = F.row_number().over(W.partitionBy("request_id", "language").orderBy(F.desc("prediction"), "pos"))
    each = scored.join(caps.select("consumer_id", "language", "max_items"), ["consumer_id", "language"], "left").withColumn("_place", place)
    return each.where(F.col("max_items").isNull() | (F.col("_place") <= F.col("max_items"))).select(*scored.columns)


def live_tag(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumn("live", F.coalesce((F.col("begin_ts") < now) & (now < F.col("end_ts")), F.lit(False)))
