"""From settings to a plan: a tree of named operators becomes one lazy pipeline over all requests.

`recommend` scores candidates for their consumers, `similar` for the seed products of their requests. Both go through the
same tree: each kind of predictor says what it does in either case, and those without an answer to `similar` leave
candidates and scores as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.functions import scalars as S
from lodestar.operators import decisions as D, filters as FL, predictors as P


class Settings:
    """Text by name; lists are separated by `;`, and yes or true is true."""

    def __init__(self, values: dict[str, str]) -> None:
        self.values = dict(values)

    def get(self, name: str, default: str | None = None) -> str:
        if name not in self.values and default is None:
            raise KeyError(f"setting {name} is missing")
        return self.values.get(name, default)

    def number(self, name: str, default: float | None = None) -> float:
        return float(self.get(name, None if default is None else str(default)))

    def flag(self, name: str, default: bool = False) -> bool:
        return self.get(name, "yes" if default else "no").strip().lower() in ("yes", "true")

    def list(self, name: str, default: str | None = None) -> list[str]:
        return [x.strip() for x in self.get(name, default).split(";") if x.strip()]

    def numbers(self, name: str, default: str | None = None) -> list[float]:
        return [float(x) for x in self.list(name, default)]


@dataclass
class Data:
    """What models are fitted on. events may hold several types (event_name); now is the time of the request, by default the last event's."""

    events: DataFrame
    products: DataFrame
    attrs: DataFrame
    now: Column | None = None

    def of_types(self, names: list[str]) -> DataFrame:
        """Events of the named types; all of them if none is named."""
        return self.events.where(F.col("event_name").isin(names)) if names else self.events

    def time(self) -> Column:
        return self.events.agg(F.max("ts_sec").alias("now")).scalar() if self.now is None else self.now

    def with_columns(self, cands: DataFrame, *names: str) -> DataFrame:
        return cands.join(self.products.select("product_id", *names), "product_id")


@dataclass(frozen=True)
class Kind:
    """Steps take (settings, name, data, candidates, scores, seeds) and give (candidates, scores)."""

    predict: Callable
    similar: Callable


PREDICTORS: dict[str, Kind] = {}
#: Decisions take (settings, name, data, scored candidates, scores, how many are asked for).
DECISIONS: dict[str, Callable] = {}
SCORE = ["request_id", "pos", "product_id", "predictor_id", "prediction", "reliability"]


def predictor(name: str, predict: Callable, similar: Callable | None = None) -> None:
    if name in PREDICTORS:
        raise ValueError(f"there is a predictor {name} already")
    PREDICTORS[name] = Kind(predict, similar or (lambda s, n, d, c, x, seeds: (c, x)))


def decision(name: str, choose: Callable) -> None:
    if name in DECISIONS:
        raise ValueError(f"there is a decision {name} already")
    DECISIONS[name] = choose


def with_scores(scores: DataFrame | None, new: DataFrame, settings: Settings, name: str, shift: int = 0) -> DataFrame:
    reliability = F.col("reliability") if "reliability" in new.columns else F.lit(1.0)
    one = new.withColumn("reliability", reliability).withColumn("predictor_id", F.lit(int(settings.number(f"{name}_ID")) + shift)).withColumn("prediction", F.col("prediction").cast("double")).select(*SCORE)
    return one if scores is None else scores.unionByName(one)


def scoring(f: Callable) -> Callable:
    """A step that gives candidates a prediction."""
    return lambda s, n, d, c, x, seeds: (c, with_scores(x, f(s, n, d, c, x, seeds), s, n))


def dropping(f: Callable) -> Callable:
    """A step that drops candidates, and their scores."""

    def run(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame | None, seeds: DataFrame | None):
        left = f(s, n, d, c).select(*c.columns)
        return left, x if x is None else x.join(left.select("request_id", "product_id"), ["request_id", "product_id"], "left_semi")

    return run


def weights(s: Settings, name: str, key: str) -> dict[int, float]:
    ids = [int(x) for x in s.numbers(f"{name}_PREDICTOR_IDS")]
    return dict(zip(ids, s.numbers(f"{name}_{key}"), strict=True))


def some(s: Settings, name: str, scores: DataFrame, key: str = "PREDICTOR_IDS") -> DataFrame:
    return scores.where(F.col("predictor_id").isin([int(i) for i in s.numbers(f"{name}_{key}")]))


def whole(s: Settings, name: str, default: int | None = None) -> int:
    return int(s.number(name, default))


def buys(s: Settings, n: str, d: Data, key: str = "BUYS") -> DataFrame:
    return d.of_types(s.list(f"{n}_{key}", ""))


def views(events: DataFrame) -> DataFrame:
    """Each event in context 0 and in that of its time."""
    return events.select("consumer_id", "product_id", F.explode(F.array(F.lit(0), S.dayweekhour(F.timestamp_seconds("ts_sec")))).alias("context"))


def contexts(s: Settings, n: str) -> list[int]:
    return [int(x) for x in s.numbers(f"{n}_CONTEXTS", "0")]


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("product_id").agg(F.count("*").alias("n"))


def together(s: Settings, n: str, events: DataFrame) -> DataFrame:
    """How often products are bought together."""
    return P.cooccurrence(events, whole(s, f"{n}_RELEVANT_TIME"))


def order_of(events: DataFrame) -> list[str]:
    return ["ts_sec", "event_id" if "event_id" in events.columns else "product_id"]


# Scores without regard to the consumer: the same for similar products.


def same(name: str, f: Callable) -> None:
    step = scoring(lambda s, n, d, c, x, seeds: f(s, n, d, c))
    predictor(name, step, step)


same("AverageProb", lambda s, n, d, c: P.average_probability(c, buys(s, n, d), whole(s, f"{n}_NDAYS") * 86400))
same("AverageRating", lambda s, n, d, c: P.average_rating(c, buys(s, n, d, "RATINGS"), d.attrs, s.number(f"{n}_KA")))
same("CountViews", lambda s, n, d, c: P.count_views(c, views(buys(s, n, d)), contexts(s, n)))
same("CountViewsTimeWindow", lambda s, n, d, c: P.count_views_window(c, buys(s, n, d), whole(s, f"{n}_TIME_WINDOW")))
same("CountViewsAttributeTimeWindow", lambda s, n, d, c: P.attribute_views(c, buys(s, n, d), d.attrs, whole(s, f"{n}_TIME_WINDOW")))
same("FloatAttribute", lambda s, n, d, c: c.join(P.float_attribute(d.products, s.get(f"{n}_ATTRIBUTE")).select("product_id", "prediction"), "product_id"))


def probability_in_context(s: Settings, n: str, d: Data, c: DataFrame) -> DataFrame:
    p = P.probability_by_context(views(buys(s, n, d))).where(F.col("context") == whole(s, f"{n}_CONTEXT", 0)).drop("context")
    return c.join(p, "product_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


same("AverageProbContext", probability_in_context)


# Scores from what the consumer, or the seeds, have been with.


def item_lift(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame | None, seeds: DataFrame | None) -> DataFrame:
    e = buys(s, n, d)
    history = e.select("consumer_id", "product_id") if seeds is None else seeds
    return P.item_lift(c, history, together(s, n, e), counts(e), whole(s, f"{n}_THRESHOLD", 5))


def item_cosine(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame, seeds: DataFrame | None) -> DataFrame:
    e = buys(s, n, d)
    average = some(s, n, x, "AVERAGE_ID").select("request_id", "product_id", F.col("prediction").alias("average"))
    factor = P.item_cosine(c, e, together(s, n, e), counts(e), s.number(f"{n}_THRESHOLD"))
    return factor.join(average, ["request_id", "product_id"], "left").withColumn("prediction", F.col("prediction") * F.coalesce("average", F.lit(0.0))).drop("average")


def attribute_lift(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame | None, seeds: DataFrame | None) -> DataFrame:
    e = buys(s, n, d)
    lift = P.value_lift(*P.attribute_lift_model(e, d.attrs, whole(s, f"{n}_RELEVANT_TIME")), s.number(f"{n}_M"), s.number(f"{n}_STABILIZE"), whole(s, f"{n}_LIMIT_VALUES", 0))
    if seeds is not None:
        return P.attribute_lift_similar(c, seeds, d.attrs, lift)
    return P.attribute_lift(c, e, d.attrs, lift, d.time(), whole(s, f"{n}_RECENT_TIME"), whole(s, f"{n}_RECENT_PRODUCTS", 20))


def naive_bayes(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame | None, seeds: DataFrame | None) -> DataFrame:
    combos = P.combinations(d.attrs, whole(s, f"{n}_COMBINATION_SIZE", 2))
    seen = views(buys(s, n, d))
    if seeds is not None:
        return P.naive_bayes_similar(c, seeds, P.bayes_stats(seen, combos), combos, s.number(f"{n}_M"), len(s.list(f"{n}_ATTRIBUTES")))
    return P.naive_bayes(c, seen, combos, contexts(s, n), s.number(f"{n}_M"), s.number(f"{n}_ATTRIBUTES_WEIGHTS", 1))


predictor("CountViewsByConsumer", scoring(lambda s, n, d, c, x, _: P.count_views_by_consumer(c, views(buys(s, n, d)), contexts(s, n), s.number(f"{n}_M"))))
predictor("ItemBasedLift", scoring(item_lift), scoring(item_lift))
predictor("ItemBasedCosine", scoring(item_cosine))
predictor("AttributeBasedLift", scoring(attribute_lift), scoring(attribute_lift))
predictor("NaiveBayesContent", scoring(naive_bayes), scoring(naive_bayes))
predictor("UnivariateLinearContent", scoring(lambda s, n, d, c, x, _: P.univariate_linear(c, buys(s, n, d, "RATINGS"), d.attrs, s.number(f"{n}_BLENDING"), s.number(f"{n}_THRESHOLD", 0)).drop("reliability")))


# Filters. What they know of a consumer says nothing about similar products, so these pass unless the filter has a form for them.


def blocked(s: Settings, n: str, d: Data) -> DataFrame:
    windows = dict(zip(s.list(f"{n}_EVENTS"), (int(x) for x in s.numbers(f"{n}_TIME_WINDOWS")), strict=True))
    return FL.blocked_values(d.events, d.attrs, windows, d.time(), whole(s, f"{n}_MAX_CONSUMER_ITEMS"))


def short_programmes(s: Settings, n: str, d: Data, c: DataFrame) -> DataFrame:
    return FL.short_programmes(d.with_columns(c, "begin_ts", "end_ts", "title"), whole(s, f"{n}_MIN_LENGTH"))


def series(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame | None, seeds: DataFrame | None):
    episodes = ("series", "season", "episode")
    e = buys(s, n, d).join(d.products.select("product_id", *episodes), "product_id").where("series IS NOT NULL")
    scored = FL.series_next(d.with_columns(c, *episodes), FL.series_state(e, order_of(e)), d.time(), whole(s, f"{n}_RELEVANT_TIME"), s.flag(f"{n}_ADD_NONSERIES"))
    left, x = dropping(lambda *_: c.join(scored.select("request_id", "product_id"), ["request_id", "product_id"], "left_semi"))(s, n, d, c, x, seeds)
    return left, with_scores(x, scored, s, n)


predictor("AttributeFilter", dropping(lambda s, n, d, c: FL.attribute_filter(c, d.attrs, blocked(s, n, d))))
predictor("FilterByAttributeFrequency", dropping(lambda s, n, d, c: FL.frequency_filter(c, buys(s, n, d), d.attrs, whole(s, f"{n}_THRESHOLD"), tuple(int(i) for i in s.numbers(f"{n}_SKIP_CONSUMERS", "")))))
predictor("NegativeRatingFilter", dropping(lambda s, n, d, c: FL.negative_rating_filter(c, buys(s, n, d, "RATINGS"), d.attrs, whole(s, f"{n}_NEGATIVE_VALUE"), order_of(d.events))))
predictor("ShortProgrammesFilter", dropping(short_programmes), dropping(short_programmes))
predictor("SeriesFilter", series, dropping(lambda s, n, d, c: FL.series_latest(d.with_columns(c, "series", "season", "episode"))))


# Scores of scores.


def decreased(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame, seeds: DataFrame | None) -> DataFrame:
    scored = c.join(some(s, n, x, "PREDICTOR_ID").select("request_id", "product_id", "prediction"), ["request_id", "product_id"]).select(*c.columns, "prediction")
    return P.decrease_by_attribute(scored, buys(s, n, d, "POSITIVE_BUYS"), buys(s, n, d, "NEGATIVE_BUYS"), d.attrs, whole(s, f"{n}_DECREASE_RANK"), tuple(int(i) for i in s.numbers(f"{n}_SKIP_CONSUMERS", "")))


def both(name: str, f: Callable, key: str, similar: Callable | None = None, similar_key: str | None = None) -> None:
    """f(settings, name, scores, weights); for similar products the weights may have a setting of their own."""
    g, own = similar or f, similar_key or key
    predictor(
        name,
        scoring(lambda s, n, d, c, x, _: f(s, n, x, weights(s, n, key))),
        scoring(lambda s, n, d, c, x, _: g(s, n, x, weights(s, n, own if f"{n}_{own}" in s.values else key))),
    )


def largest(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame, seeds: DataFrame | None) -> DataFrame:
    return P.max_value(some(s, n, x))


def stick_together(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame | None, seeds: DataFrame | None):
    for child in s.list(f"{n}_PREDICTORS"):
        c, x = apply(s, child, d, c, x, seeds)
    return c, x


def similar_to_last(s: Settings, n: str, d: Data, c: DataFrame, x: DataFrame | None, seeds: DataFrame | None):
    """The child's scores, and under shifted ids its scores for products similar to the consumer's last ones; without history these are the child's own."""
    child, shift = s.get(f"{n}_PREDICTOR"), whole(s, f"{n}_ID_SHIFT")
    e = d.of_types(s.list(f"{n}_EVENT", ""))
    last = P.last_distinct(e, order_of(e), whole(s, f"{n}_NITEMS"))
    seeds_of = c.select("request_id", "consumer_id").distinct().join(last, "consumer_id").select("request_id", "product_id")
    c, own = apply(s, child, d, c, None, None)
    _, like = apply(s, child, d, c, None, seeds_of)
    there = seeds_of.select("request_id").distinct()
    shifted = like.join(there, "request_id", "left_semi").unionByName(own.join(there, "request_id", "left_anti")).withColumn("predictor_id", F.col("predictor_id") + shift)
    every = own.unionByName(shifted.select(*SCORE))
    return c, every if x is None else x.unionByName(every)


predictor("DecreaseWeightByAttribute", scoring(decreased))
predictor("MaxValue", scoring(largest), scoring(largest))
both("MultiplyHybrid", lambda s, n, x, w: P.multiply(x, w), "PREDICTOR_WEIGHTS")
both("HybridSum", lambda s, n, x, w: P.hybrid_sum(x, w), "PREDICTION_MULTIPLIERS", None, "FIND_SIMILAR_MULTIPLIERS")
both(
    "CombineByRanks",
    lambda s, n, x, w: P.combine_by_ranks(x, w, s.number(f"{n}_MAX_RANK", 1000), s.number(f"{n}_PERCENTILE", 10)),
    "PREDICTOR_WEIGHTS",
    lambda s, n, x, w: P.combine_by_ranks_similar(x, w, s.number(f"{n}_MAX_RANK", 1000)),
    "PREDICTOR_SIMILAR_WEIGHTS",
)
predictor("StickTogether", stick_together, stick_together)
predictor("AddSimilarLastProducts", similar_to_last)


# Decisions.


def with_prediction(s: Settings, name: str, key: str, scored: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """scored, with the score of the predictor that a setting names in a column."""
    other = some(s, name, scores, key).select("request_id", "product_id", F.col("prediction").alias(column))
    return scored.join(other, ["request_id", "product_id"])


def hybrid(s: Settings, name: str, d: Data, scored: DataFrame, x: DataFrame, n: int) -> DataFrame:
    return D.round_robin([choose(s, child, d, scored, x, n) for child in s.list(f"{name}_DECISIONS")], n)


def tagged(d: Data, scored: DataFrame) -> DataFrame:
    """With the columns that selection under caps goes by, from the products' title_key and tags."""
    return scored.join(d.products.select("product_id", "title_key", "tags"), "product_id", "left")


def caps(s: Settings, name: str) -> dict[str, int]:
    """MAX_ITEMS_<tag> settings of a decision."""
    start = f"{name}_MAX_ITEMS_"
    return {k.removeprefix(start): int(v) for k, v in s.values.items() if k.startswith(start)}


def choose(s: Settings, name: str, d: Data, scored: DataFrame, x: DataFrame, n: int) -> DataFrame:
    kind = s.get(f"{name}_CLASS")
    if kind not in DECISIONS:
        raise ValueError(f"{name}: no decision {kind}; there are {sorted(DECISIONS)}")
    return DECISIONS[kind](s, name, d, scored, x, n)


def within_languages(s: Settings, name: str, d: Data, scored: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """Another decision, over what the caps of the consumer's languages leave. Products have a column language."""
    spoken = d.products.select("product_id", "language")
    caps = FL.language_caps(buys(s, name, d).join(spoken, "product_id"), n)
    left = FL.within_language_caps(scored.join(spoken, "product_id"), caps).drop("language")
    return choose(s, s.get(f"{name}_DECISION"), d, left, x, n)


decision("WithinLanguageCaps", within_languages)
decision("GetBestNProducts", lambda s, name, d, c, x, n: D.best_n(c, s.number(f"{name}_MIN_PREDICTION"), n))
decision("GetBestProbProducts", lambda s, name, d, c, x, n: D.best_prob(c, d.events, n))
decision("GetBestRatingProducts", lambda s, name, d, c, x, n: D.best_rating(c, buys(s, name, d, "RATINGS"), s.number(f"{name}_ACCEPTABLE_RATINGS"), n))
decision("GetLargestOffsetProducts", lambda s, name, d, c, x, n: D.largest_offset(with_prediction(s, name, "AVERAGE_ID", c, x, "average"), "average", n))
decision("GetPopularProducts", lambda s, name, d, c, x, n: D.popular(c.join(counts(buys(s, name, d)), "product_id"), "n", n))
decision("HybridDecision", hybrid)
decision("CombineByRanksDecision", lambda s, name, d, c, x, n: D.by_midranks(x, weights(s, name, "PREDICTOR_WEIGHTS"), n))
decision("AttributeFrequencyDecision", lambda s, name, d, c, x, n: D.by_attribute_frequency(c, d.events, d.attrs, n))
decision("RemoveDuplicates", lambda s, name, d, c, x, n: D.remove_duplicates(tagged(d, c), n, caps(s, name), None, s.number(f"{name}_MIN_PREDICTION", 0)))
decision("CombinePredictorsDecision", lambda s, name, d, c, x, n: D.combine_predictors(tagged(d, x), {k: int(w) for k, w in weights(s, name, "PREDICTOR_WEIGHTS").items()}, n, caps(s, name)))


def apply(settings: Settings, name: str, data: Data, cands: DataFrame, scores: DataFrame | None = None, seeds: DataFrame | None = None):
    """Runs the predictor that settings define under a name: for the candidates' consumers, or for seeds if there are any."""
    kind = settings.get(f"{name}_CLASS")
    if kind not in PREDICTORS:
        raise ValueError(f"{name}: no predictor {kind}; there are {sorted(PREDICTORS)}")
    step = PREDICTORS[kind].predict if seeds is None else PREDICTORS[kind].similar
    return step(settings, name, data, cands, scores, seeds)


def deciding(settings: Settings, name: str) -> int | None:
    """The id of the last step that scores."""
    for child in reversed(settings.list(f"{name}_PREDICTORS", "")):
        if (found := deciding(settings, child)) is not None:
            return found
    return whole(settings, f"{name}_ID") if f"{name}_ID" in settings.values else None


def decided(settings: Settings, data: Data, cands: DataFrame, n: int, seeds: DataFrame | None) -> DataFrame:
    top = settings.get("PREDICTOR")
    last = deciding(settings, top)
    if last is None:
        raise ValueError(f"{top}: no step gives a score")
    cands, scores = apply(settings, top, data, cands, None, seeds)
    if scores is None:
        raise ValueError(f"{top}: no step has scores for similar products")
    final = scores.where(F.col("predictor_id") == last).select("request_id", "product_id", "prediction")
    return choose(settings, settings.get("DECISION"), data, cands.join(final, ["request_id", "product_id"]), scores, n)


def recommend(settings: Settings, data: Data, cands: DataFrame, n: int) -> DataFrame:
    """request_id, rank, product_id, prediction: the last score decides. Products that the consumer has an event of the types NOT_RECOMMEND_EVENTS with stay out."""
    if names := settings.list("NOT_RECOMMEND_EVENTS", ""):
        cands = FL.unseen(cands, data.of_types(names))
    return decided(settings, data, cands, n, None)


def similar(settings: Settings, data: Data, cands: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """The same for products like a request's seeds (request_id, product_id). Seeds that are no known product count nothing; seeds are no candidates."""
    known = seeds.join(data.products.select("product_id"), "product_id", "left_semi").select("request_id", "product_id")
    return decided(settings, data, FL.without_seeds(cands, known), n, known)
