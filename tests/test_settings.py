"""Every kind of predictor and decision by its settings, over a few hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import predictors as P
from lodestar.plans.settings import DECISIONS, PREDICTORS, Data, Settings, apply, choose, decision, predictor, recommend, similar

BASE = {"pop_CLASS": "CountViewsTimeWindow", "pop_ID": "1", "pop_TIME_WINDOW": "1000000", "price_CLASS": "FloatAttribute", "price_ID": "2", "price_ATTRIBUTE": "price"}
KINDS = {
    "AverageProb": {"NDAYS": "9"}, "AverageProbContext": {"CONTEXT": "0"}, "AverageRating": {"KA": "1"}, "CountViews": {"CONTEXTS": "0"},
    "CountViewsTimeWindow": {"TIME_WINDOW": "1000000"}, "CountViewsAttributeTimeWindow": {"TIME_WINDOW": "1000000"}, "FloatAttribute": {"ATTRIBUTE": "price"},
    "CountViewsByConsumer": {"M": "1"}, "ItemBasedLift": {"RELEVANT_TIME": "1000", "THRESHOLD": "0"},
    "ItemBasedCosine": {"RELEVANT_TIME": "1000", "THRESHOLD": "0", "AVERAGE_ID": "1"},
    "AttributeBasedLift": {"RELEVANT_TIME": "1000", "M": "1", "STABILIZE": "0.01", "RECENT_TIME": "100"},
    "NaiveBayesContent": {"M": "1", "ATTRIBUTES": "a;b"}, "UnivariateLinearContent": {"BLENDING": "1"},
    "AttributeFilter": {"EVENTS": "buy", "TIME_WINDOWS": "0", "MAX_CONSUMER_ITEMS": "1"}, "FilterByAttributeFrequency": {"THRESHOLD": "2", "SKIP_CONSUMERS": "9"},
    "NegativeRatingFilter": {"NEGATIVE_VALUE": "1"}, "ShortProgrammesFilter": {"MIN_LENGTH": "60"}, "SeriesFilter": {"RELEVANT_TIME": "1000000", "ADD_NONSERIES": "yes"},
    "DecreaseWeightByAttribute": {"PREDICTOR_ID": "1", "POSITIVE_BUYS": "buy", "NEGATIVE_BUYS": "rate", "DECREASE_RANK": "1"},
    "MaxValue": {"PREDICTOR_IDS": "1;2"}, "MultiplyHybrid": {"PREDICTOR_IDS": "1;2", "PREDICTOR_WEIGHTS": "1;1"},
    "HybridSum": {"PREDICTOR_IDS": "1;2", "PREDICTION_MULTIPLIERS": "1;1", "FIND_SIMILAR_MULTIPLIERS": "3;1"},
    "CombineByRanks": {"PREDICTOR_IDS": "1;2", "PREDICTOR_WEIGHTS": "1;1"}, "StickTogether": {"PREDICTORS": "pop;price"},
    "AddSimilarLastProducts": {"PREDICTOR": "lift", "ID_SHIFT": "100", "NITEMS": "1"},
}
NO_SIMILAR = {"CountViewsByConsumer", "ItemBasedCosine", "UnivariateLinearContent", "AttributeFilter", "FilterByAttributeFrequency", "NegativeRatingFilter", "DecreaseWeightByAttribute", "AddSimilarLastProducts"}
LIFT = {"lift_CLASS": "ItemBasedLift", "lift_ID": "7", "lift_RELEVANT_TIME": "1000", "lift_THRESHOLD": "0"}
CHOICES = {
    "WithinLanguageCaps": {"DECISION": "best"}, "GetBestNProducts": {"MIN_PREDICTION": "0"}, "GetBestProbProducts": {}, "GetBestRatingProducts": {"ACCEPTABLE_RATINGS": "0"}, "GetLargestOffsetProducts": {"AVERAGE_ID": "1"},
    "GetPopularProducts": {"BUYS": "buy"}, "HybridDecision": {"DECISIONS": "best;known"}, "CombineByRanksDecision": {"PREDICTOR_IDS": "1;2", "PREDICTOR_WEIGHTS": "1;1"},
    "AttributeFrequencyDecision": {}, "RemoveDuplicates": {"MAX_ITEMS_t": "1"}, "CombinePredictorsDecision": {"PREDICTOR_IDS": "1;2", "PREDICTOR_WEIGHTS": "1;1"},
}
CHILDREN = {"best_CLASS": "GetBestNProducts", "best_MIN_PREDICTION": "0", "known_CLASS": "GetPopularProducts"}


def of(kind, values, more=()):
    return Settings(BASE | LIFT | dict(more) | {"x_CLASS": kind, "x_ID": "5"} | {f"x_{k}": v for k, v in values.items()})


@pytest.fixture(scope="module")
def data(spark):
    events = [("buy", 1, 1, 11, 100, 5), ("buy", 2, 1, 12, 200, 1), ("buy", 3, 2, 11, 300, 3), ("buy", 4, 2, 13, 350, 4), ("rate", 5, 2, 12, 9000, 2), ("buy", 6, 3, 11, 9100, 5)]
    events = spark.createDataFrame(events, "event_name string, event_id long, consumer_id long, product_id long, ts_sec long, rating int")
    products = [(11, 1.0, 0, 3600, "one", 1, 1, 1, "one", "t"), (12, 2.0, 0, 30, "two", 1, 1, 2, "two", "t"), (13, 3.0, 0, 3600, "three", 1, 1, 3, "three", "u"), (14, None, 0, 3600, "four", None, None, None, "four", None)]
    products = spark.createDataFrame(products, "product_id long, price double, begin_ts long, end_ts long, title string, series long, season int, episode int, title_key string, tags string").withColumn("language", F.lit("en"))
    attrs = spark.createDataFrame([(11, 0, "x"), (12, 0, "x"), (13, 0, "y"), (14, 0, "z"), (11, 1, "p"), (13, 1, "p")], "product_id long, attr_idx int, value string")
    return Data(events, products, attrs)


@pytest.fixture(scope="module")
def cands(spark):
    rows = [(r, p, c, 10 + p) for r, c in ((1, 1), (2, 2), (3, 4)) for p in range(1, 5)]
    return spark.createDataFrame(rows, "request_id long, pos int, consumer_id long, product_id long")


def ready(data, cands, seeds=None):
    s, x = Settings(BASE), None
    for name in ("pop", "price"):
        cands, x = apply(s, name, data, cands, x, seeds)
    return cands, x


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.select(*columns).collect()}


def test_all_kinds_are_here():
    assert set(KINDS) == set(PREDICTORS) and set(CHOICES) == set(DECISIONS)
    with pytest.raises(ValueError):
        predictor("MaxValue", None)
    with pytest.raises(ValueError):
        decision("HybridDecision", None)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_predictors(spark, data, cands, kind):
    seeds = spark.createDataFrame([(1, 11), (2, 13)], "request_id long, product_id long")
    for given in (None, seeds):
        c, x = ready(data, cands, given)
        left, scores = apply(of(kind, KINDS[kind]), "x", data, c, x, given)
        before, after = x.count(), scores.collect()
        assert rows(left, "request_id", "product_id") <= rows(cands, "request_id", "product_id") and left.columns == cands.columns
        assert len({(r.request_id, r.product_id, r.predictor_id) for r in after}) == len(after) - (before if kind == "StickTogether" else 0)
        if given is not None and kind in NO_SIMILAR:
            assert (left.count(), len(after)) == (12, before)


@pytest.mark.parametrize("kind", sorted(CHOICES))
def test_decisions(data, cands, kind):
    c, x = ready(data, cands)
    scored = c.join(x.where("predictor_id = 2").select("request_id", "product_id", "prediction"), ["request_id", "product_id"])
    got = choose(of(kind, CHOICES[kind], CHILDREN), "x", data, scored, x, 2).collect()
    assert got and all(sorted(r.rank for r in got if r.request_id == i) in ([1], [1, 2], []) for i in (1, 2, 3))


def test_filters_by_value(data, cands):
    left = lambda kind, **more: rows(apply(of(kind, KINDS[kind] | more), "x", data, cands)[0], "request_id", "product_id")
    every = rows(cands, "request_id", "product_id")
    assert left("NegativeRatingFilter") == every - {(1, 11), (1, 12)}  # consumer 1 rated value x at 5, then at 1
    assert left("ShortProgrammesFilter") == {r for r in every if r[1] != 12}
    unseen = {(1, 13), (1, 14), (2, 14), (3, 11), (3, 14)}
    assert left("SeriesFilter", BUYS="buy") == unseen
    assert left("SeriesFilter") == unseen | {(2, 13)}  # the last event of consumer 2 is a rating of episode 2
    latest = apply(of("SeriesFilter", KINDS["SeriesFilter"]), "x", data, cands, None, cands.limit(0))[0]
    assert rows(latest, "product_id") == {(13,)}


def test_products_like_the_last_ones(spark, data, cands):
    _, x = apply(of("AddSimilarLastProducts", KINDS["AddSimilarLastProducts"]), "x", data, cands)
    last = spark.createDataFrame([(1, 12), (2, 12)], "request_id long, product_id long")  # the consumer of request 3 has none
    co = P.cooccurrence(data.events.withColumn("event", F.col("event_id")), 1000)
    want = P.item_lift(cands, last, co, data.events.groupBy("product_id").agg(F.count("*").alias("n")), 0)
    assert rows(x.where("predictor_id = 107"), "request_id", "product_id", "prediction") == rows(want, "request_id", "product_id", "prediction")
    assert rows(x.where("request_id = 3 AND predictor_id = 7"), "product_id", "prediction") == rows(x.where("request_id = 3 AND predictor_id = 107"), "product_id", "prediction")


def test_events_that_keep_products_out(data, cands):
    s = Settings(BASE | {"PREDICTOR": "pop", "DECISION": "best", "best_CLASS": "GetBestNProducts", "best_MIN_PREDICTION": "0", "NOT_RECOMMEND_EVENTS": "rate"})
    assert rows(recommend(s, data, cands, 9), "request_id", "product_id") == rows(cands, "request_id", "product_id") - {(2, 12)}


def test_similar(spark, data, cands):
    s = Settings(BASE | {"PREDICTOR": "pop", "DECISION": "best", "best_CLASS": "GetBestNProducts", "best_MIN_PREDICTION": "0", "NOT_RECOMMEND_EVENTS": "buy"})
    seeds = spark.createDataFrame([(1, 11), (1, 99), (2, 99)], "request_id long, product_id long")
    assert rows(similar(s, data, cands, seeds, 9), "request_id", "product_id") == rows(cands, "request_id", "product_id") - {(1, 11)}
    assert similar(s, data, cands.limit(0), seeds, 9).count() == 0
    only = Settings({"PREDICTOR": "p", "DECISION": "d", "p_CLASS": "ItemBasedCosine", "p_ID": "1"})
    with pytest.raises(ValueError):
        similar(only, data, cands, seeds, 9)
    with pytest.raises(ValueError):
        recommend(Settings({"PREDICTOR": "p", "p_CLASS": "ShortProgrammesFilter"}), data, cands, 9)
