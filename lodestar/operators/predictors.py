"""Models and scores of candidates. Fits are aggregations of events; scores are left joins of candidates to models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.operators.filters import newest

KEY = ["request_id", "product_id"]


def recent(events: DataFrame, seconds: int | None) -> DataFrame:
    """Events within so many seconds of the last one."""
    if seconds is None:
        return events
    last = events.agg(F.max("ts_sec").alias("_last"))
    return events.crossJoin(F.broadcast(last)).where(F.col("ts_sec") >= F.col("_last") - seconds).drop("_last")  # one row


def average_probability(cands: DataFrame, events: DataFrame, seconds: int | None = None) -> DataFrame:
    """How many of the consumers with recent events a product's recent events stand for, at most 1."""
    now = recent(events, seconds)
    n = now.groupBy("product_id").agg(F.count("*").alias("n"))
    who = now.agg(F.count_distinct("consumer_id").alias("consumers"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.01 + F.coalesce("n", F.lit(0))) / F.col("consumers")))
    return cands.join(n, "product_id", "left").crossJoin(F.broadcast(who)).withColumn("prediction", p).drop("n", "consumers")


def probability_by_context(events: DataFrame) -> DataFrame:
    """events with context. (product_id, context, prediction): events of the product over consumers, both in the context."""
    who = events.groupBy("context").agg(F.count_distinct("consumer_id").alias("consumers"))
    return events.groupBy("product_id", "context").agg(F.count("*").alias("n")).join(who, "context").select("product_id", "context", (F.col("n") / F.col("consumers")).alias("prediction"))


def average_rating(cands: DataFrame, ratings: DataFrame, attrs: DataFrame, blend: float) -> DataFrame:
    """The best blended mean of the values of the first attribute that has a rated one."""
    rated = ratings.join(attrs, "product_id")
    by_value = rated.groupBy("attr_idx", "value").agg(F.sum("rating").alias("s"), F.count("*").alias("n"))
    total = rated.agg((F.sum("rating") / (F.count("*") + 1e-6)).alias("g"))
    means = by_value.crossJoin(F.broadcast(total)).select("attr_idx", "value", ((F.col("s") + blend * F.col("g")) / (F.col("n") + blend)).alias("m"))
    best = attrs.join(means, ["attr_idx", "value"]).groupBy("product_id", "attr_idx").agg(F.max("m").alias("m"))
    first = best.groupBy("product_id").agg(F.min_by("m", "attr_idx").alias("prediction"))
    return cands.join(first, "product_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def count_views(cands: DataFrame, views: DataFrame, asked: Sequence[int]) -> DataFrame:
    """views: product_id, context. Mean over the asked contexts, from 1 on; 1 for a product never seen."""
    n = views.where(F.col("context").isin(*asked)).groupBy("product_id").agg(F.count("*").alias("n"))
    seen = views.select("product_id").distinct().withColumn("seen", F.lit(True))
    p = F.when(F.col("seen"), (1 + F.coalesce("n", F.lit(0))) / len(asked)).otherwise(F.lit(1.0))
    return cands.join(n, "product_id", "left").join(seen, "product_id", "left").withColumn("prediction", p).drop("n", "seen")


def count_views_window(cands: DataFrame, events: DataFrame, seconds: int) -> DataFrame:
    n = recent(events, seconds).groupBy("product_id").agg(F.count("*").cast("double").alias("prediction"))
    return cands.join(n, "product_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def count_views_by_consumer(cands: DataFrame, views: DataFrame, asked: Sequence[int], m: float) -> DataFrame:
    """views: consumer_id, product_id, context, 0 among the contexts of each. The consumer's views of the product, blended with everyone's."""
    sets = views.groupingSets([["consumer_id", "product_id", "context"], ["consumer_id", "context"]], "consumer_id", "product_id", "context").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    own, all_of = sets.where("g = 0"), sets.where("g > 0")
    share = lambda name: F.sum(F.when(F.col("context").isin(*asked), F.col("n")).otherwise(0)).alias(name) / len(asked)
    zero = lambda name: F.sum(F.when(F.col("context") == 0, F.col("n")).otherwise(0)).alias(name)
    a = own.groupBy("consumer_id", "product_id").agg(share("x").alias("n_mean"), zero("n0").alias("n0"))
    b = all_of.groupBy("consumer_id").agg(share("x").alias("all_mean"), zero("all0").alias("all0"))
    by_product = views.where("context = 0").groupBy("product_id").agg(F.count("*").alias("n_product"))
    total = views.where("context = 0").agg(F.count("*").alias("total"))
    z = lambda c: F.coalesce(c, F.lit(0))
    p0 = (z("n0") + m * z("n_product") / F.col("total")) / (z("all0") + m)
    joined = cands.join(a, ["consumer_id", "product_id"], "left").join(b, "consumer_id", "left").join(by_product, "product_id", "left").crossJoin(F.broadcast(total))
    return joined.withColumn("prediction", (z("n_mean") + m * p0) / (z("all_mean") + m)).select(*cands.columns, "prediction")


def attribute_views(cands: DataFrame, events: DataFrame, attrs: DataFrame, seconds: int) -> DataFrame:
    """Mean recent count of the product's values that have any."""
    n = recent(events, seconds).join(attrs, "product_id").groupBy("attr_idx", "value").agg(F.count("*").alias("n"))
    p = attrs.join(n, ["attr_idx", "value"]).groupBy("product_id").agg(F.avg("n").alias("prediction"))
    return cands.join(p, "product_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def float_attribute(products: DataFrame, column: str) -> DataFrame:
    mean = products.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("_mean"))
    return products.crossJoin(F.broadcast(mean)).withColumn("prediction", F.coalesce(column, "_mean")).drop("_mean")


def substituted(cands: DataFrame, ids: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with the score of the product that another id of theirs names. ids: product_id, other_id; scores: product_id, prediction."""
    there = scores.select(F.col("product_id").alias("other_id"), "prediction")
    return cands.join(ids, "product_id", "left").join(there, "other_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def decrease_by_attribute(scored: DataFrame, positive: DataFrame, negative: DataFrame, attrs: DataFrame, decrease: int, skip: tuple[int, ...] = ()) -> DataFrame:
    """scored: request_id, consumer_id, product_id, prediction. Takes each score so many dense ranks lower as its values' negative events ask for."""
    cnt = negative.join(attrs, "product_id").groupBy("consumer_id", "attr_idx", "value").agg(F.count("*").alias("n"))
    cnt = cnt.join(positive.join(attrs, "product_id").select("consumer_id", "attr_idx", "value").distinct(), ["consumer_id", "attr_idx", "value"], "left_anti")
    met = scored.join(attrs, "product_id").join(cnt, ["consumer_id", "attr_idx", "value"]).groupBy("request_id", "product_id").agg((decrease * F.sum("n")).alias("step"))
    dense = scored.withColumn("dr", F.dense_rank().over(W.partitionBy("request_id").orderBy(F.desc("prediction"))))
    steps = dense.join(met, KEY, "left").withColumn("step", F.when(F.col("consumer_id").isin(*skip), 0).otherwise(F.coalesce("step", F.lit(0))) if skip else F.coalesce("step", F.lit(0)))
    at = dense.groupBy("request_id", F.col("dr").alias("at")).agg(F.first("prediction").alias("lower"))
    low = steps.withColumn("at", (F.col("dr") + F.col("step")).cast("int")).join(at, ["request_id", "at"], "left")
    return low.select(*scored.columns[:-1], F.when(F.col("step") > 0, F.coalesce("lower", F.lit(0.0))).otherwise(F.col("prediction")).alias("prediction"))


# Co-occurrence: events of one consumer within a time of each other.


def close_pairs(events: DataFrame, key: str, seconds: int, itself: bool = False) -> DataFrame:
    """events: consumer_id, ts_sec, `key`. (a, b, w), a before b: pairs of a consumer's events at most so far apart, to be summed for a and b.

    Events need no numbers: of two that differ in time or key the earlier is on the left, so each pair is met once. With
    `itself`, w counts ordered pairs of different events of one key too: equal events meet in both orders, and with
    themselves, which a negative row for each key takes off. Events meet in slots of that width, their own and the one
    before, so that long histories are not joined whole.
    """
    e = events.select("consumer_id", "ts_sec", F.col(key).alias("k")).where("consumer_id IS NOT NULL AND ts_sec IS NOT NULL AND k IS NOT NULL")
    left = e.withColumn("slot", F.floor(F.col("ts_sec") / max(1, seconds)))
    right = left.withColumn("slot", F.explode(F.array("slot", F.col("slot") - 1)))
    a, b = left.alias("a"), right.alias("b")
    before = F.col("a.k") <= F.col("b.k") if itself else F.col("a.k") < F.col("b.k")
    before = (F.col("a.ts_sec") < F.col("b.ts_sec")) | ((F.col("a.ts_sec") == F.col("b.ts_sec")) & before)
    on = (F.col("a.consumer_id") == F.col("b.consumer_id")) & (F.col("a.slot") == F.col("b.slot")) & before & (F.col("b.ts_sec") - F.col("a.ts_sec") <= seconds)
    on = on if itself else on & (F.col("a.k") != F.col("b.k"))
    twice = (F.col("a.k") == F.col("b.k")) & (F.col("a.ts_sec") < F.col("b.ts_sec"))
    pairs = a.join(b, on).select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"), F.when(twice, 2).otherwise(1).alias("w"))
    return pairs.unionByName(e.groupBy("k").agg((-F.count("*")).alias("w")).select(F.col("k").alias("a"), F.col("k").alias("b"), "w")) if itself else pairs


def both_ways(pairs: DataFrame, *more: str) -> DataFrame:
    """pairs (a, b), a != b, and the same with a and b changed round."""
    each = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    return pairs.select(each, *more).select("x.a", "x.b", *more)


def cooccurrence(events: DataFrame, seconds: int) -> DataFrame:
    """(a, b, co) of different products."""
    return both_ways(close_pairs(events, "product_id", seconds).groupBy("a", "b").agg(F.count("*").alias("co")), "co")


def item_lift(cands: DataFrame, history: DataFrame, co: DataFrame, counts: DataFrame, least: int = 5, fallback: Column | None = None) -> DataFrame:
    """Sum of co / (n_j sqrt(n_i)) over the distinct history items j. counts: product_id, n; history: consumer_id (or request_id), product_id."""
    by = "consumer_id" if "consumer_id" in history.columns else "request_id"
    h = history.select(by, F.col("product_id").alias("j")).distinct()
    co = co.where(F.col("co") >= least).select(F.col("a").alias("product_id"), F.col("b").alias("j"), "co")
    # Repeated pairs are few, so they come before the product of each consumer's candidates and history.
    s = cands.join(h.join(co, "j"), [by, "product_id"]) if least > 1 else cands.join(h, by).join(co, ["product_id", "j"])
    s = s.join(counts, "product_id").join(counts.select(F.col("product_id").alias("j"), F.col("n").alias("n_j")), "j")
    p = s.groupBy("request_id", "product_id").agg(F.sum(F.col("co") / (F.col("n_j") * F.sqrt("n"))).alias("prediction"))
    return cands.join(p, KEY, "left").withColumn("prediction", F.coalesce("prediction", fallback if fallback is not None else F.lit(0.0)))


def item_cosine(cands: DataFrame, history: DataFrame, co: DataFrame, counts: DataFrame, threshold: float, most: int = 4096) -> DataFrame:
    """1 and the sum of the cosines over the threshold; to be multiplied by an average score.

    A score is that of a consumer and a product. The consumer's history goes to the product in one array and meets the
    product's neighbours, one array too, so that the product of candidates and history is not written. As each candidate
    goes through all its neighbours, products of more than `most` events meet the items of the history one by one.
    """
    by = ["consumer_id", "product_id"]
    h = history.select("consumer_id", F.col("product_id").alias("j")).distinct().join(counts.select(F.col("product_id").alias("j"), F.col("n").alias("n_j")), "j")
    items = h.groupBy("consumer_id").agg(F.collect_list(F.struct("j", "n_j")).alias("items")).select("consumer_id", F.col("items.j").alias("items"), F.col("items.n_j").alias("items_n"))
    near = co.select(F.col("a").alias("product_id"), F.col("b").alias("j"), "co").join(counts.select("product_id", "n"), "product_id")
    lists = near.where(F.col("n") <= most).groupBy("product_id", "n").agg(F.collect_list(F.struct("j", "co")).alias("near")).select("product_id", "n", F.col("near.j").alias("near"), F.col("near.co").alias("near_co"))
    at = lambda values, keys, j: F.element_at(values, F.array_position(keys, j).cast("int"))
    cosine = lambda co, n_j: co / F.sqrt(F.col("n") * n_j)
    over = lambda s: F.when(s > threshold, s).otherwise(0.0)
    pairs = cands.select(*by).distinct()
    few = pairs.join(items, "consumer_id").join(lists, "product_id")
    few = few.select(*by, F.aggregate(F.array_intersect("items", "near"), F.lit(0.0), lambda s, j: s + over(cosine(at("near_co", "near", j), at("items_n", "items", j)))).alias("s"))
    many = pairs.join(counts.where(F.col("n") > most).select("product_id"), "product_id").join(h, "consumer_id").join(near.where(F.col("n") > most), ["product_id", "j"])
    many = many.groupBy(*by).agg(F.sum(over(cosine(F.col("co"), F.col("n_j")))).alias("s"))
    return cands.join(few.unionByName(many), by, "left").select(*cands.columns, "s").withColumn("prediction", 1 + F.coalesce("s", F.lit(0.0))).drop("s")


def first_values(attrs: DataFrame) -> DataFrame:
    """The values of the first attribute that has any."""
    first = attrs.groupBy("product_id").agg(F.min("attr_idx").alias("attr_idx"))
    return attrs.join(first, ["product_id", "attr_idx"]).select("product_id", "value")


def attribute_lift_model(events: DataFrame, attrs: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, co; values: value, n). Each ordered pair of close events counts each pair of their values."""
    v = first_values(attrs)
    pairs = close_pairs(events, "product_id", seconds, itself=True).groupBy("a", "b").agg(F.sum("w").alias("w")).where("w > 0")
    pairs = pairs.where("a = b").unionByName(both_ways(pairs.where("a != b"), "w"))
    each = pairs.join(v.select(F.col("product_id").alias("a"), F.col("value").alias("va")), "a").join(v.select(F.col("product_id").alias("b"), F.col("value").alias("vb")), "b")
    co = each.groupBy(F.col("va").alias("a"), F.col("vb").alias("b")).agg(F.sum("w").alias("co"))
    return co, co.groupBy(F.col("a").alias("value")).agg(F.sum("co").alias("n"))


def value_lift(co: DataFrame, n: DataFrame, m: float, stabilise: float, least: int = 0) -> DataFrame:
    """(a, b, lift): how much more often a comes with b than by itself."""
    total = n.agg(F.sum("n").alias("total"))
    p = n.crossJoin(F.broadcast(total)).select(F.col("value").alias("a"), (F.col("n") / F.col("total")).alias("p"))
    x = co.where(F.col("co") > least).join(p, "a").join(n.select(F.col("value").alias("b"), F.col("n").alias("n_b")), "b")
    return x.select("a", "b", (((F.col("co") + m * F.col("p")) / (F.col("n_b") + m) + stabilise) / (F.col("p") + stabilise)).alias("lift"))


def attribute_lift(cands: DataFrame, history: DataFrame, attrs: DataFrame, lift: DataFrame, now: Column, recent_time: int, most: int = 20) -> DataFrame:
    """history: consumer_id, product_id, ts_sec. exp of the best contributions' mean, shrunk; 0 where nothing contributes."""
    v = first_values(attrs)
    weight = F.sum(F.when(F.col("ts_sec") > now - recent_time, 2).otherwise(1))
    w = history.join(v, "product_id").groupBy("consumer_id", F.col("value").alias("b")).agg(weight.alias("w"))
    # A score is that of a consumer and a product's values, however many candidates have them.
    values = v.groupBy("product_id").agg(F.sort_array(F.collect_list("value")).alias("values"))
    mine = cands.join(values, "product_id", "left")
    s = mine.where("values IS NOT NULL").select("consumer_id", "values").distinct().join(w, "consumer_id")
    s = s.select("consumer_id", "values", "b", "w", F.explode("values").alias("a")).join(lift, ["a", "b"])
    s = s.groupBy("consumer_id", "values", "b", "w").agg(F.sum(F.log("lift")).alias("sim"))
    s = s.withColumn("s", F.sqrt("w") * F.col("sim") / F.size("values"))
    s = newest(s, ["consumer_id", "values"], "s", most)
    p = s.groupBy("consumer_id", "values").agg(F.exp(F.sum("s") / (20 + F.sum(F.sqrt("w")))).alias("prediction"))
    return mine.join(p, ["consumer_id", "values"], "left").select(*cands.columns, F.coalesce("prediction", F.lit(0.0)).alias("prediction"))


def attribute_lift_similar(cands: DataFrame, seeds: DataFrame, attrs: DataFrame, lift: DataFrame) -> DataFrame:
    """seeds: request_id, product_id. The product over seeds and values of the geometric mean lift; pairs without one count 1."""
    v = first_values(attrs)
    size = v.groupBy("product_id").agg(F.count("*").alias("size"))
    s = seeds.select("request_id", F.col("product_id").alias("seed")).join(v.select(F.col("product_id").alias("seed"), F.col("value").alias("b")), "seed").join(size.withColumnRenamed("product_id", "seed"), "seed")
    x = cands.select("request_id", "product_id").join(v.select("product_id", F.col("value").alias("a")), "product_id").join(s, "request_id").join(lift, ["a", "b"])
    p = x.groupBy(*KEY).agg(F.exp(F.sum(F.log("lift") / F.col("size"))).alias("prediction"))
    return cands.join(p, KEY, "left").withColumn("prediction", F.coalesce("prediction", F.lit(1.0)))


# Content models.


def combinations(attrs: DataFrame, size: int = 2) -> DataFrame:
    """(product_id, combo, k) of one value, or of two of rising attribute and value."""
    name = lambda p: F.concat(F.col(f"{p}attr_idx"), F.lit("="), F.col(f"{p}value"))
    one = attrs.select("product_id", name("").alias("combo"), F.col("attr_idx").alias("first"))
    if size == 1:
        return one
    a, b = attrs.alias("a"), attrs.alias("b")
    on = (F.col("a.product_id") == F.col("b.product_id")) & (F.struct("a.attr_idx", "a.value") < F.struct("b.attr_idx", "b.value"))
    return one.unionByName(a.join(b, on).select(F.col("a.product_id").alias("product_id"), F.concat(name("a."), F.lit("&"), name("b.")).alias("combo"), F.col("a.attr_idx").alias("first")))


def bayes_stats(views: DataFrame, combos: DataFrame) -> DataFrame:
    """views: consumer_id, product_id, context. (consumer_id, combo, context, n, g) of the levels that scores need: g 0 consumer, combo and context; 2 consumer and context; 5 combo; 7 all."""
    each = views.join(combos.select("product_id", "combo"), "product_id")
    levels = [["consumer_id", "combo", "context"], ["consumer_id", "context"], ["combo", "context"], ["context"]]
    return each.groupingSets(levels, "consumer_id", "combo", "context").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


def naive_bayes(cands: DataFrame, views: DataFrame, combos: DataFrame, asked: Sequence[int], m: float, weight: float = 1.0) -> DataFrame:
    """The geometric mean of how much more the consumer takes to the product's combinations than all do, less 1. views: as for bayes_stats.

    A score is that of a consumer and a product. Both the consumer's views and the products asked for go to the consumer
    once, one row for each product with its combinations in an array, and everything that is counted by consumer is
    counted there.
    """
    by, contexts = ["consumer_id", "product_id"], sorted({0, *asked})
    z = lambda c: F.coalesce(c, F.lit(0))
    glob = views.where("context = 0").groupBy("product_id").agg(F.count("*").alias("n")).join(combos.select("product_id", "combo"), "product_id").groupBy("combo").agg(F.sum("n").alias("n_a"))
    total = glob.agg(F.sum("n_a").alias("total"))
    of = combos.groupBy("product_id", "combo").agg(F.count("*").alias("times")).join(glob, "combo", "left")
    of = of.groupBy("product_id").agg(F.collect_list(F.struct("combo", "times", z("n_a").alias("n_a"))).alias("of"))
    seen = views.where(F.col("context").isin(contexts) & F.col("consumer_id").isNotNull()).groupBy(*by).agg(*[F.count_if(F.col("context") == c).alias(f"n_{c}") for c in contexts])
    both = seen.join(cands.select(*by, F.lit(True).alias("asks")).distinct(), by, "full_outer").join(of, "product_id").repartition("consumer_id")
    x = both.select(*by, "asks", *[f"n_{c}" for c in contexts], F.explode("of").alias("x")).select(*by, "asks", "x.combo", "x.times", "x.n_a", *[(F.col(f"n_{c}") * F.col("x.times")).alias(f"n_{c}") for c in contexts])
    own, per = W.partitionBy("consumer_id", "combo"), W.partitionBy("consumer_id")
    x = x.select("*", *[F.sum(f"n_{c}").over(own).alias(f"own_{c}") for c in contexts]).select("*", *[F.sum(f"n_{c}").over(per).alias(f"all_{c}") for c in contexts])
    x = x.where("asks AND all_0 > 0").crossJoin(F.broadcast(total)).withColumn("p0", (z("n_a") + 1e-6) / (F.col("total") + 2))
    x = x.withColumn("pu", (z("own_0") + m * F.col("p0")) / (F.col("all_0") + m))
    w = weight / len(asked)
    ln = sum((F.log((z(f"own_{c}") + m * F.col("pu")) / (z(f"all_{c}") + m) / F.col("p0")) for c in asked), F.lit(0.0)) * F.col("times")
    factor = F.greatest(F.lit(0.9), F.least(1 + z("own_0") / 2, F.exp(ln * w)))
    p = x.groupBy(*by).agg(F.greatest(F.exp(F.sum(F.log(factor)) / (F.count("*") * w)) - 1, F.lit(0.0)).alias("prediction"))
    return cands.join(p, by, "left").select(*cands.columns, F.coalesce("prediction", F.lit(0.0)).alias("prediction"))


def naive_bayes_similar(cands: DataFrame, seeds: DataFrame, stats: DataFrame, combos: DataFrame, m: float, attributes: int) -> DataFrame:
    """The same with the seeds in the consumer's place."""
    glob = stats.where("g = 4 AND context = 0").select("combo", F.col("n").alias("n_a"))
    total = stats.where("g = 6 AND context = 0").select(F.col("n").alias("total"))
    of_seeds = seeds.select("request_id", "product_id").join(combos.select("product_id", "combo"), "product_id")
    by = of_seeds.groupBy("request_id", "combo").agg(F.count("*").alias("s_a"))
    every = of_seeds.groupBy("request_id").agg(F.count("*").alias("s"))
    z = lambda c: F.coalesce(c, F.lit(0))
    x = cands.select(*KEY).join(combos.select("product_id", "combo"), "product_id").join(glob, "combo", "left").crossJoin(F.broadcast(total)).join(by, ["request_id", "combo"], "left").join(every, "request_id", "left")
    x = x.withColumn("p0", (z("n_a") + 0.01) / (F.col("total") + 2)).withColumn("pu", (z("s_a") + m * F.col("p0")) / (z("s") + m))
    p = x.groupBy(*KEY).agg(F.greatest(F.exp(F.sum(F.log(F.least(F.lit(3.0), F.col("pu") / F.col("p0")))) / attributes) - 1, F.lit(0.0)).alias("prediction"))
    return cands.join(p, KEY, "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def bayes_constraints(cands: DataFrame, attrs: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """(request_id, value, max_items): how many of n items of each value that candidates have."""
    m = cands.join(attrs, "product_id").groupBy("request_id", "consumer_id", "value").agg(F.count("*").alias("m"))
    items = cands.groupBy("request_id").agg(F.count("*").alias("items"))
    own = events.join(attrs, "product_id").groupBy("consumer_id", "value").agg(F.count("*").alias("c"))
    x = m.join(items, "request_id").join(own, ["consumer_id", "value"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    top = F.greatest(F.max("c").over(W.partitionBy("request_id")), F.lit(1))
    room = F.greatest(F.lit(0), n - F.floor((F.col("items") - F.col("m")) / 2))
    return x.select("request_id", "value", F.greatest(room, F.floor(n * F.col("c") / top / 2 + 0.5) + 1).cast("long").alias("max_items"))


def univariate_linear(cands: DataFrame, ratings: DataFrame, attrs: DataFrame, blending: float, threshold: float = 0.0) -> DataFrame:
    """The consumer's mean and a weighted mean of what the product's values shift it by."""
    each = ratings.join(attrs, "product_id")
    sets = each.groupingSets([["consumer_id", "attr_idx", "value"], ["attr_idx", "value"], ["consumer_id"], []], "consumer_id", "attr_idx", "value").agg(F.sum("rating").alias("s"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    cv = sets.where("g = 0").select("consumer_id", "attr_idx", "value", F.col("s").alias("s_cv"), F.col("n").alias("n_cv"))
    val = sets.where("g = 4").select("attr_idx", "value", F.col("n").alias("n_v"))
    con = sets.where("g = 3").select("consumer_id", F.col("s").alias("s_c"), F.col("n").alias("n_c"))
    tot = sets.where("g = 7").select((F.col("s") / F.col("n")).alias("g_mean"), F.col("n").alias("total"))
    x = cands.select("request_id", "consumer_id", "product_id").join(attrs, "product_id").join(cv, ["consumer_id", "attr_idx", "value"], "left").join(val, ["attr_idx", "value"], "left").join(con, "consumer_id").crossJoin(F.broadcast(tot))
    mu = (F.col("s_c") + F.col("g_mean")) / (F.col("n_c") + 1)
    x = x.withColumn("mu", mu).withColumn("d", (F.col("s_cv") + blending * F.col("mu")) / (F.col("n_cv") + blending) - F.col("mu")).withColumn("w", F.log(F.col("total") / (F.col("n_v") + 1)) * F.log(F.col("n_cv") + 1.1))
    p = x.groupBy(*KEY).agg(F.first("mu").alias("mu"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("d")).alias("wd"), F.count("s_cv").alias("rated"), F.count("*").alias("values"))
    score = F.col("mu") + F.col("wd") / F.col("w")
    p = p.select(*KEY, F.when((F.col("w") >= 1e-6) & (score >= threshold), score).otherwise(0.0).alias("prediction"), ((F.col("rated") + 1) / (F.col("values") + 1)).alias("reliability"))
    return cands.join(p, KEY, "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def factorisation(ratings: DataFrame, rank: int = 8, epochs: int = 10, reg: float = 0.1, seed: int = 1):
    """A model of ratings centred by consumer. fit(...).transform(consumer_id, product_id) adds prediction, centred too."""
    from pyspark.ml.recommendation import ALS

    centred = ratings.groupBy("consumer_id", "product_id").agg(F.avg("rating").alias("r")).withColumn("r", (F.col("r") - F.avg("r").over(W.partitionBy("consumer_id"))).cast("float"))
    return ALS(rank=rank, maxIter=epochs, regParam=reg, seed=seed, userCol="consumer_id", itemCol="product_id", ratingCol="r", coldStartStrategy="nan").fit(centred)


# Hybrids over long scores: request_id, pos, product_id, predictor_id, prediction, reliability.


def max_value(scores: DataFrame) -> DataFrame:
    return scores.groupBy("request_id", "pos", "product_id").agg(F.greatest(F.lit(0.0), F.max("prediction")).alias("prediction"))


def _weighted(scores: DataFrame, weights: dict[int, float]) -> DataFrame:
    return scores.where(F.col("predictor_id").isin(*weights)).withColumn("weight", F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])[F.col("predictor_id")])


def multiply(scores: DataFrame, weights: dict[int, float]) -> DataFrame:
    """The product of the scores to the powers of their weights; small scores are raised where the power is negative."""
    base = F.when((F.col("weight") < 0) & (F.col("prediction") < 1e-6), 1e-6).otherwise(F.col("prediction"))
    return _weighted(scores, weights).groupBy("request_id", "pos", "product_id").agg(F.product(F.pow(base, "weight")).alias("prediction"))


def hybrid_sum(scores: DataFrame, weights: dict[int, float]) -> DataFrame:
    from lodestar.functions.ranks import ordinal_points

    points = _weighted(scores, weights).withColumn("points", ordinal_points(F.col("prediction"), "request_id", "predictor_id"))
    return points.groupBy("request_id", "pos", "product_id").agg(F.sum(F.col("weight") * F.col("points")).alias("prediction"))


def combine_by_ranks(scores: DataFrame, weights: dict[int, float], max_rank: float = 1000, percentile: float = 10, explained: DataFrame | None = None) -> DataFrame:
    """Weighted mean of rank curves; explained: request_id, product_id, ranks (distinct ranks of its explanations) adds a bonus."""
    from lodestar.functions.ranks import rank_curve

    x = rank_curve(_weighted(scores, {k: w for k, w in weights.items() if w > 0}), "prediction", ["request_id", "predictor_id"], max_rank, percentile)
    wr = F.col("weight") * F.col("reliability")
    good = (F.col("prediction") > 0) & (F.col("rank") > 0.01)
    out = x.groupBy("request_id", "pos", "product_id").agg((F.sum(F.when(good, F.col("rank") * wr).otherwise(0.0)) / F.greatest(F.lit(1e-6), F.sum(wr))).alias("prediction"))
    if explained is None:
        return out
    bonus = F.when(F.col("ranks") >= 2, 2 * max_rank).when(F.col("ranks") == 1, max_rank).otherwise(0.0)
    return out.join(explained, KEY, "left").withColumn("prediction", F.col("prediction") + bonus).drop("ranks")


def combine_by_ranks_similar(scores: DataFrame, weights: dict[int, float], max_rank: float = 1000) -> DataFrame:
    from lodestar.functions.ranks import change_rank

    x = change_rank(_weighted(scores, {k: w for k, w in weights.items() if w > 0}), "prediction", ["request_id", "predictor_id"], max_rank)
    wr = F.col("weight") * F.col("reliability")
    good = (F.col("prediction") > 0) & (F.col("rank") > 0.01)
    return x.groupBy("request_id", "pos", "product_id").agg((F.sum(F.when(good, F.col("rank") * wr).otherwise(0.0)) / F.greatest(F.lit(1e-6), F.sum(wr))).alias("prediction"))


def last_distinct(events: DataFrame, order: list[str], n: int) -> DataFrame:
    """Each consumer's last n different products."""
    last = events.groupBy("consumer_id", "product_id").agg(F.max(F.struct(*order)).alias("at"))
    return last.withColumn("rank", F.row_number().over(W.partitionBy("consumer_id").orderBy(F.desc("at"), "product_id"))).where(F.col("rank") <= n).select("consumer_id", "product_id", "rank")
