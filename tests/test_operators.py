"""Order-dependent operators against plain loops, on small fixtures."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar import schema
from lodestar.functions import ranks, scalars
from lodestar.operators import decisions, evaluation, events, filters, predictors
from lodestar.plans import snapshots
from lodestar.plans.settings import Data, Settings, apply
from lodestar.sources import tables


def lists(seed):
    rng = random.Random(seed)
    return [(r, p, p * 10 + r, float(rng.choice([0, 0, 1, 2, 2, 3, 7]))) for r in range(6) for p in range(1, rng.choice([1, 2, 12, 40]) + 1)]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(lists(3), "request_id long, pos int, product_id long, prediction double")


def test_midrank(spark, scored):
    got = {(r.request_id, r.pos): r.m for r in scored.withColumn("m", ranks.midrank(F.col("prediction"), "request_id")).collect()}
    for r in range(6):
        mine = [x for x in lists(3) if x[0] == r]
        for _, p, _, v in mine:
            less, same = sum(x[3] < v for x in mine), sum(x[3] == v for x in mine)
            assert got[r, p] == less + (same - 1) / 2


@pytest.mark.parametrize("percentile", [10, 50])
def test_rank_curve(scored, percentile):
    got = {(r.request_id, r.pos): r["rank"] for r in ranks.rank_curve(scored, "prediction", ["request_id"], 1000, percentile).collect()}
    for r in range(6):
        mine = sorted((x for x in lists(3) if x[0] == r), key=lambda x: (-x[3], x[1]))
        n, th = len(mine), len(mine) * percentile / 100
        points, cp, prev = 1000.0, None, None
        for k, x in enumerate(mine, 1):
            assert got[r, x[1]] == pytest.approx(points)
            if k > 1 and x[3] != mine[k - 2][3]:
                prev, cp = cp, k
                points = max(0, 1000 - k * 500 / th) if prev is None or prev < th else max(0, 500 - max(0, k - th) * 500 / (n - th))


def test_change_rank(scored):
    got = {(r.request_id, r.pos): r["rank"] for r in ranks.change_rank(scored, "prediction", ["request_id"]).collect()}
    for r in range(6):
        mine, last = sorted((x for x in lists(3) if x[0] == r), key=lambda x: (-x[3], x[1])), 0
        for k, x in enumerate(mine, 1):
            assert got[r, x[1]] == 1000 - last
            if k == 1 or x[3] != mine[k - 2][3]:
                last = k


def test_greedy_selection(spark):
    rows = [(1, i, i, 13.0 - i, t, g) for i, (t, g) in enumerate([("abc", "x"), ("abc", "y"), ("", "x"), ("", "x"), ("d", "y"), ("e", "z"), ("f", "x;y")], 1)]
    df = spark.createDataFrame(rows, "request_id long, pos int, product_id long, prediction double, title_key string, tags string")
    got = [r.product_id for r in decisions.remove_duplicates(df, 6, {"x": 2}, {"y": 1}).orderBy("rank").collect()]
    assert got == [1, 3, 5, 6, 2, 4]  # strict: 1, 3, 5, 6; normal: none, as 2 has a title again and x is full; forced: 2, 4
    assert [r.product_id for r in decisions.remove_duplicates(df, 3, forced=(7,)).orderBy("rank").collect()] == [7, 1, 3]


def test_series(spark):
    cands = [(1, p, 9, p, s, e) for p, (s, e) in enumerate([(1, 1), (1, 2), (1, 3), (1, 5), (2, 1), (None, None)], 1)]
    df = spark.createDataFrame([(*c[:4], 7, *c[4:]) for c in cands], "request_id long, pos int, consumer_id long, product_id long, series long, season int, episode int")
    ev = spark.createDataFrame([(9, 7, 1, 2, 100)], "consumer_id long, series long, season int, episode int, ts_sec long")
    state = filters.series_state(ev, ["ts_sec"])
    (got,) = filters.series_next(df, state, F.lit(120), 50).collect()
    assert (got.product_id, got.prediction, got.reliability) == (3, 5.0, 1.0)
    (late,) = filters.series_next(df.where("product_id > 4"), state, F.lit(1000), 50).collect()
    assert (late.product_id, late.prediction) == (5, 3.0)
    assert filters.series_latest(df).collect()[0].product_id == 5


def test_language_and_ttl(spark):
    h = spark.createDataFrame([(1, "sl"), (1, "en"), (1, "de"), (1, "nullnull")], "consumer_id long, language string")
    assert {r.language: r.max_items for r in filters.language_caps(h, 7).collect()} == {"en": 5, "de": 5}
    ev = spark.createDataFrame([("a", 1, 1, 10), ("b", 1, 1, 12), ("a", 1, 2, 1)], "event_name string, consumer_id long, product_id long, ts_sec long")
    attrs = spark.createDataFrame([(1, 0, "n", "x"), (2, 0, "n", "y")], schema.PRODUCT_ATTRS)
    got = filters.blocked_values(ev, attrs, {"a": 10, "b": 2}, 15, 5).collect()
    assert [(r.value, r.expiry) for r in got] == [("x", 20)]


def test_nulls_and_empty(spark):
    none = spark.createDataFrame([], "request_id long, pos int, consumer_id long, product_id long, prediction double")
    ev = spark.createDataFrame([], "consumer_id long, product_id long, ts_sec long, rating int")
    attrs = spark.createDataFrame([], schema.PRODUCT_ATTRS)
    assert decisions.best_n(none, 0, 3).count() == 0
    assert filters.unseen(none, ev).count() == 0
    assert predictors.univariate_linear(none.drop("prediction"), ev, attrs, 1).count() == 0
    assert [tuple(r) for r in spark.sql("SELECT 'x' AS rating UNION ALL SELECT '7' UNION ALL SELECT '999' UNION ALL SELECT NULL").select(scalars.rating_of("rating * 2")).collect()] == [(None,), (14,), (100,), (None,)]
    assert scalars.mean_and_std(spark.createDataFrame([], "x double"), "x").first() == (0.0, 0.0)


def test_formula_is_arithmetic():
    with pytest.raises(ValueError):
        scalars.rating_of("rating; drop table x")


def test_json_and_refresh(spark):
    products = spark.createDataFrame([(1,)], "product_id long")
    raw = spark.createDataFrame([(1, '{"title":"T","y":null}', '{"series-id":5}', "c"), (2, "{}", "{}", "d")], "product_id long, attributes string, related string, partner_product_code string")
    wide = tables.attributes(raw, products, ["title", "related:series-id", "y", "$partner_product_code"])
    assert [tuple(r) for r in wide.collect()] == [(1, "T", "5", None, "c")]
    old = spark.createDataFrame([(1, "O", "4", "Y", "b")], wide.schema)
    assert tuple(tables.refreshed(old, wide).first()) == (1, "T", "5", "Y", "c")
    assert schema.domain("int;string:20", "a;b").names == ["a", "b"]


def test_settings(spark):
    data = spark.createDataFrame([(1, 1, 1.0)], "product_id long, x long, price double")
    c = spark.createDataFrame([(1, 1, 1, 1)], schema.CANDIDATES)
    cfg = Settings({"p_CLASS": "FloatAttribute", "p_ID": "4", "p_ATTRIBUTE": "price", "q_CLASS": "Nothing", "on": "yes", "l": "1; 2;"})
    assert cfg.flag("on") and cfg.numbers("l") == [1.0, 2.0]
    _, scores = apply(cfg, "p", Data(c, data, c), c)
    assert scores.first().predictor_id == 4
    with pytest.raises(ValueError):
        apply(cfg, "q", Data(c, data, c), c)


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    snapshots.save(spark.range(3).toDF("x"), path)
    before = snapshots.load(spark, path)
    snapshots.save(spark.range(5).toDF("x"), path)
    assert (before.count(), snapshots.load(spark, path).count()) == (3, 5)
    snapshots.save(spark.range(7).toDF("x"), path, {"event_id": 41})
    assert snapshots.current(spark, path)["read_up_to"] == {"event_id": 41} and snapshots.load(spark, path).count() == 7
    assert len(list(tmp_path.glob("m/v-*"))) == len(list(tmp_path.glob("m/pointers/0*"))) == 2
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, f"file://{tmp_path}/none")


def test_random_selection_is_the_same_in_each_run(spark, scored):
    chosen = [sorted(map(tuple, decisions.select_best(scored.repartition(n), F.col("prediction"), 3, seed=5).collect())) for n in (1, 7)]
    assert chosen[0] == chosen[1] and len({r[0] for r in chosen[0]}) == scored.select("request_id").distinct().count()


def test_measures(spark):
    df = spark.createDataFrame([(1, [1, 2], [2, 3, 1]), (2, [5], []), (3, [], [4])], "consumer_id long, relevant array<long>, recommended array<long>")
    assert evaluation.precision(df).first()[0] == pytest.approx(2 / 9)
    assert evaluation.mean_average_precision(df).first()[0] == pytest.approx((1 + 2 / 3) / 3)
    assert evaluation.recall_precision_f(df).first().recall == 1.0


def test_retention(spark):
    ev = spark.createDataFrame([(1, i, i) for i in range(5)], "consumer_id long, product_id long, ts_sec long")
    assert sorted(r.product_id for r in events.keep_last(ev, ["ts_sec"], 2).collect()) == [3, 4]
    assert events.decayed(spark.createDataFrame([(1,), (3,)], "n long")).collect()[0].n == 2


def test_close_events_need_no_numbers(spark):
    """Numbers that change from one reading to the next, as those of rows behind a shuffle do, make no difference; nor do equal events."""
    rows = [(1, 7, 0), (1, 7, 0), (1, 8, 0), (1, 8, 15), (1, 7, 15), (1, 9, 100), (2, 8, 0), (2, 7, 10), (2, 7, 10), (None, 7, 0), (2, None, 10)] + [(c, p, 0) for c in range(3, 30) for p in (7, 8)]
    ev = spark.createDataFrame(rows, "consumer_id long, product_id long, ts_sec long").withColumn("event", (F.rand() * 2).cast("int"))
    pairs = [(x[1], y[1]) for i, x in enumerate(rows) for j, y in enumerate(rows) if i != j and x[0] and x[0] == y[0] and x[1] and y[1] and abs(x[2] - y[2]) <= 10]
    want = {p: pairs.count(p) for p in set(pairs)}
    co = {(r.a, r.b): r.co for r in predictors.cooccurrence(ev, 10).collect()}
    assert co == {p: n for p, n in want.items() if p[0] != p[1]}
    attrs = spark.createDataFrame([(p, 0, "n", str(p)) for p in (7, 8, 9)], schema.PRODUCT_ATTRS)
    model, n = predictors.attribute_lift_model(ev, attrs, 10)
    assert {(int(r.a), int(r.b)): r.co for r in model.collect()} == want
    assert {int(r.value): r.n for r in n.collect()} == {k: sum(c for (a, _), c in want.items() if a == k) for k in (7, 8)}


def test_greedy_selections_take_many_requests_at_a_time(spark):
    """No call for each request, and missing predictions and times stand last or fit nothing."""
    rows = [(r, 1, 10, None, "a", "x") for r in range(300)] + [(r, p, 10 + p, float(p), "b", "y") for r in range(300) for p in (2, 3)]
    df = spark.createDataFrame(rows, "request_id long, pos int, product_id long, prediction double, title_key string, tags string")
    got = decisions.remove_duplicates(df, 2)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == [(r, k, p, float(p - 10)) for r in range(300) for k, p in ((1, 13), (2, 12))]
    got = decisions.combine_predictors(df.withColumn("predictor_id", F.lit(1)), {1: 1}, 3).collect()
    assert sorted(map(tuple, got)) == [(r, k, *x) for r in range(300) for k, x in enumerate([(13, 3.0), (10, None), (12, 2.0)], 1)]
    shows = [(1, 1, 5, 1.0, 0, 90, ["g"], 10), (1, 2, 6, 2.0, None, 90, None, 10), (2, 1, 7, 1.0, 0, 90, ["g"], None)]
    df = spark.createDataFrame(shows, "request_id long, pos int, product_id long, prediction double, begin_ts long, end_ts long, genres array<string>, now_ts long")
    assert [tuple(r) for r in decisions.virtual_channels(df, {}, 2, 6).collect()] == [(1, 0, 5, 1.0)]


LIKED = [(1, 1, 1, 11), (1, 2, 1, 12), (2, 1, 1, 11), (3, 1, 2, 13), (4, 1, 3, 11), (4, 2, 3, 14)]  # consumer 3 has no events, product 14 no value


def test_lift_scores_are_of_consumers_and_values(spark):
    cands = spark.createDataFrame(LIKED, schema.CANDIDATES)
    ev = spark.createDataFrame([(1, 12, 5), (1, 13, 50), (2, 11, 5)], "consumer_id long, product_id long, ts_sec long")
    attrs = spark.createDataFrame([(11, 0, "n", "x"), (12, 0, "n", "y"), (13, 0, "n", "x"), (13, 0, "n", "y")], schema.PRODUCT_ATTRS)
    lift = spark.createDataFrame([("x", "y", 2.0), ("y", "x", 3.0), ("x", "x", 0.5)], "a string, b string, lift double")
    df = predictors.attribute_lift(cands, ev, attrs, lift, F.lit(60), 20)
    assert "windowspecdefinition(request_id" not in df._jdf.queryExecution().optimizedPlan().toString()
    own = {1: {"x": 2, "y": 3}, 2: {"x": 1}}  # a recent event counts 2
    of, lifts = {11: "x", 12: "y", 13: "xy"}, {("x", "y"): 2.0, ("y", "x"): 3.0, ("x", "x"): 0.5}

    def score(consumer, product):
        met = [(w, [math.log(lifts[a, b]) for a in of.get(product, "") if (a, b) in lifts]) for b, w in own.get(consumer, {}).items()]
        met = [(math.sqrt(w), sum(x) / len(of[product])) for w, x in met if x]
        return math.exp(sum(w * x for w, x in met) / (20 + sum(w for w, _ in met))) if met else 0.0

    got = {(r.request_id, r.product_id): r.prediction for r in df.collect()}
    assert got == {(r, p): pytest.approx(score(c, p)) for r, _, c, p in LIKED}


def test_item_lift_meets_repeated_pairs_first(spark):
    cands = spark.createDataFrame(LIKED, schema.CANDIDATES)
    h = spark.createDataFrame([(1, 12), (1, 12), (1, 13), (2, 11), (2, 13)], "consumer_id long, product_id long")
    co = spark.createDataFrame([(11, 12, 2), (12, 11, 2), (11, 13, 1), (13, 11, 3)], "a long, b long, co long")
    n = spark.createDataFrame([(11, 4), (12, 2), (13, 9)], "product_id long, n long")
    df = predictors.item_lift(cands, h, co, n, 2)
    assert not re.search(r"Join Inner, \(consumer_id#\d+L = consumer_id#\d+L\)", df._jdf.queryExecution().optimizedPlan().toString())
    want = {k: 0.0 for k in [(1, 12), (4, 11), (4, 14)]} | {(1, 11): 0.5, (2, 11): 0.5, (3, 13): 0.25}
    assert {(r.request_id, r.product_id): r.prediction for r in df.collect()} == want


@pytest.mark.parametrize("most", [4096, 3, 0])
def test_item_cosine_takes_histories_in_arrays(spark, most):
    rng = random.Random(most)
    cands = [(r, i + 1, r % 4 or None, p) for r in range(1, 9) for i, p in enumerate(rng.sample(range(12), 6))]
    h = [(c, rng.randrange(12)) for c in [1, 1, 2, 2, 2, 3, None] * 5]
    co = {(a, b): rng.choice([1, 2, 9]) for a in range(12) for b in range(a) if rng.random() < 0.5}
    co |= {(b, a): n for (a, b), n in co.items()}
    n = {p: rng.choice([1, 2, 3, 7, 50]) for p in range(11)}  # product 11 is not counted
    frames = [spark.createDataFrame(rows, of) for rows, of in [(cands, schema.CANDIDATES), (h, "consumer_id long, product_id long"), ([(*k, v) for k, v in co.items()], "a long, b long, co long"), (list(n.items()), "product_id long, n long")]]
    df = predictors.item_cosine(*frames, 0.2, most)
    assert df.columns == [*frames[0].columns, "prediction"]
    # one row for each consumer and product of a candidate, whatever the history's length
    assert "array_intersect" in df._jdf.queryExecution().optimizedPlan().toString()

    def score(consumer, product):
        met = [co[product, j] / math.sqrt(n[product] * n[j]) for j in {p for c, p in h if c == consumer and c} if (product, j) in co and product in n and j in n]
        return 1 + sum(s for s in met if s > 0.2)

    got = {(r.request_id, r.product_id): r.prediction for r in df.collect()}
    assert got == {(r, p): pytest.approx(score(c, p)) for r, _, c, p in cands}


def test_naive_bayes_counts_at_the_consumer(spark):
    rng = random.Random(5)
    cands = [(r, i + 1, r % 4 or None, p) for r in range(1, 9) for i, p in enumerate(rng.sample(range(10), 5))]
    seen = [(rng.choice([1, 2, 3, 5, None]), rng.randrange(10), rng.choice([0, 0, 7, 2])) for _ in range(60)]
    seen = [v for v in seen if v[0] != 3 or v[2] == 7]  # consumer 3 has no view of context 0
    combos = [(p, rng.choice("abcd")) for p in range(9) for _ in range(3)]  # some twice; product 9 has none
    frames = [spark.createDataFrame(rows, of) for rows, of in [(cands, schema.CANDIDATES), (seen, "consumer_id long, product_id long, context int"), (combos, "product_id long, combo string")]]
    df = predictors.naive_bayes(*frames, [0, 7], 10, 1.5)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.columns == [*frames[0].columns, "prediction"] and "grouping_id" not in plan
    assert not re.search(r"Join \w+, .*combo.*consumer_id|Join \w+, .*consumer_id.*combo", plan)  # nothing is joined by consumer and combination
    each = [(c, k, x) for c, p, x in seen for q, k in combos if p == q]
    n = lambda c=None, k=None, x=0: sum((c is None or c == e[0]) and (k is None or k == e[1]) and x == e[2] for e in each)

    def score(consumer, product):
        mine = [k for p, k in combos if p == product]
        if not consumer or not mine or not n(consumer):
            return 0.0
        logs = []
        for k in set(mine):
            p0 = (n(None, k) + 1e-6) / (n() + 2)
            pu = (n(consumer, k) + 10 * p0) / (n(consumer) + 10)
            ln = sum(math.log((n(consumer, k, x) + 10 * pu) / (n(consumer, None, x) + 10) / p0) for x in (0, 7)) * mine.count(k)
            logs.append(math.log(max(0.9, min(1 + n(consumer, k) / 2, math.exp(ln * 0.75)))))
        return max(math.exp(sum(logs) / (len(logs) * 0.75)) - 1, 0.0)

    got = {(r.request_id, r.product_id): r.prediction for r in df.collect()}
    assert got == {(r, p): pytest.approx(score(c, p)) for r, _, c, p in cands} and any(got.values())
