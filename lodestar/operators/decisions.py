"""Selection of final lists from scored candidates: top-n by weights, round-robin, greedy selection under title and tag caps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.functions.ranks import midrank

RESULT = "request_id long, rank int, product_id long, prediction double"


def by_request(items: DataFrame, columns: Sequence[str], choose: Callable[[dict[str, list]], list[tuple]], result: str) -> DataFrame:
    """The rows of `choose` for each request's items, in the order of predictions and then pos, as a list for each column.

    Spark gathers the lists and Python goes through many requests of a batch in plain loops: a call with a data frame for
    each request would take much longer than the choice.
    """
    names = [c.split()[0] for c in result.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in result.split(", ")])
    at, by = list(columns).index("prediction"), list(columns).index("pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column(1), []
            ends = lists.offsets.to_pylist()
            flat = lists.flatten()
            flat = [flat.field(i).to_pylist() for i in range(len(columns))]
            for r, start, end in zip(batch.column(0).to_pylist(), ends, ends[1:], strict=False):
                start, end = start - ends[0], end - ends[0]
                score, pos = flat[at], flat[by]
                order = range(start, end)
                if end - start > 1:  # missing ones last
                    order = sorted(order, key=lambda i: (score[i] is None or score[i] != score[i], -(score[i] or 0.0), pos[i] is None, pos[i] or 0))
                out.extend((r, *x) for x in choose({c: [v[i] for i in order] for c, v in zip(columns, flat, strict=True)}))
            rows = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema, strict=True)], schema=schema)

    return items.groupBy("request_id").agg(F.collect_list(F.struct(*columns)).alias("items")).mapInArrow(run, result)


def select_best(scored: DataFrame, weight: Column, n: int | str, seed: int | None = None) -> DataFrame:
    """The n best by weight, ties by pos; a column may hold n. With a seed each weight is multiplied by a random number, the same for a request and product in each run."""
    w = weight if seed is None else weight * (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "request_id", "product_id"), 11) / F.lit(float(2**53)))
    ranked = scored.withColumn("_w", w).withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("_w"), "pos")))
    return ranked.where(F.col("rank") <= (F.col(n) if isinstance(n, str) else n)).drop("_w")


def best_n(scored: DataFrame, least: float, n: int) -> DataFrame:
    return select_best(scored.where(F.col("prediction") >= least), F.col("prediction") - least, n)


def best_prob(scored: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """Weight: how far the prediction is above the consumer's number of events."""
    count = events.groupBy("consumer_id").agg(F.count("*").alias("_n"))
    x = scored.join(count, "consumer_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return select_best(x.where(F.col("prediction") >= F.col("_n")), F.col("prediction") - F.col("_n"), n).drop("_n")


def best_rating(scored: DataFrame, ratings: DataFrame, acceptable: float, n: int) -> DataFrame:
    mean = ratings.groupBy("consumer_id").agg((F.sum("rating") / (F.count("*") + 0.1)).alias("_m"))
    x = scored.join(mean, "consumer_id", "left").withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    x = x.where((F.col("prediction") >= acceptable) | (F.col("prediction") >= F.col("_m")))
    return select_best(x, F.col("prediction") - F.least(F.col("_m"), F.lit(float(acceptable))), n).drop("_m")


def largest_offset(scored: DataFrame, average: str, n: int) -> DataFrame:
    return select_best(scored.where(F.col("prediction") >= F.col(average)), F.col("prediction") - F.col(average), n)


def popular(scored: DataFrame, count: str, n: int) -> DataFrame:
    return select_best(scored, F.col(count), n)


def round_robin(lists: Sequence[DataFrame], n: int) -> DataFrame:
    """lists: request_id, pos, product_id, prediction, rank. Takes from each in turn until n different ones are had; then by prediction."""
    every = None
    for i, x in enumerate(lists):
        x = x.select("request_id", "pos", "product_id", "prediction", F.col("rank").alias("k"), F.lit(i).alias("i"))
        every = x if every is None else every.unionByName(x)
    once = every.groupBy("request_id", "pos", "product_id", "prediction").agg(F.min(F.struct("k", "i")).alias("at"))
    taken = once.withColumn("turn", F.row_number().over(W.partitionBy("request_id").orderBy("at"))).where(F.col("turn") <= n)
    return taken.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("prediction"), "pos"))).select("request_id", "pos", "product_id", "prediction", "rank")


def by_midranks(scores: DataFrame, weights: dict[int, float], n: int) -> DataFrame:
    """scores: request_id, pos, product_id, predictor_id, prediction. The n largest weighted sums of midranks."""
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.col("predictor_id")]
    x = scores.where(F.col("predictor_id").isin(*weights)).withColumn("points", w * midrank(F.col("prediction"), "request_id", "predictor_id"))
    return select_best(x.groupBy("request_id", "pos", "product_id").agg(F.sum("points").alias("prediction")), F.col("prediction"), n)


def by_attribute_frequency(scored: DataFrame, events: DataFrame, attrs: DataFrame, n: int) -> DataFrame:
    """Weight: the prediction times the geometric mean of the consumer's counts of the values, each one more; rounded, so that equal weights are ties on any engine."""
    counts = events.join(attrs, "product_id").groupBy("consumer_id", "attr_idx", "value").agg(F.count("*").alias("c"))
    g = scored.select("request_id", "consumer_id", "product_id").join(attrs, "product_id").join(counts, ["consumer_id", "attr_idx", "value"], "left")
    g = g.groupBy("request_id", "product_id").agg(F.pow(F.product(F.coalesce("c", F.lit(0)) + 1.0), 1.0 / F.count("*")).alias("freq"))
    x = scored.join(g, ["request_id", "product_id"], "left").withColumn("weight", F.round(F.col("prediction") * F.coalesce("freq", F.lit(1.0)), 6))
    return select_best(x, F.col("weight"), n)


def by_tag_rank(selected: DataFrame, tags: str, ranks: Column) -> DataFrame:
    """Sorts by the mean of the ranks that a map gives the row's tags."""
    of = F.filter(F.transform(tags, lambda t: ranks[t]), lambda r: r.isNotNull())
    mean = F.aggregate(of, F.lit(0.0), lambda s, r: s + r) / F.size(of)
    return selected.withColumn("rank", F.row_number().over(W.partitionBy("request_id").orderBy(mean.asc_nulls_last(), "rank")))


def distinct_titles(scored: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """The best of each title prefix, then the n best. scored with title_key, "" where there is no title to compare."""
    x = scored.where(F.col("prediction") >= least)
    first = F.row_number().over(W.partitionBy("request_id", "title_key").orderBy(F.desc("prediction"), "pos"))
    return select_best(x.withColumn("_t", first).where((F.col("_t") == 1) | (F.col("title_key") == "")), F.col("prediction"), n).drop("_t")


@lru_cache(1 << 16)
def tags_of(tags: str | None) -> tuple[str, ...]:
    return tuple(t for t in (tags or "").split(";") if t)


class Adder:
    """Adds items of one request in turn, as long as titles and tag counts allow. items: lists of product_id, prediction, title_key and tags; an item is a place in them."""

    def __init__(self, n: int, caps: dict[str, int], secondary: dict[str, int], items: dict[str, list], needs_reason: bool = False) -> None:
        self.n, self.caps, self.secondary, self.needs_reason = n, caps, secondary, needs_reason
        self.products, self.keys, self.tags, self.items = items["product_id"], items["title_key"], items["tags"], items
        self.titles, self.ids, self.counts, self.taken = set(), set(), {}, []

    def fits(self, tags: Sequence[str], caps: dict[str, int]) -> bool:
        return all(self.counts.get(t, 0) < caps[t] for t in tags if t in caps)

    def add(self, i: int, mode: str) -> bool:
        """strict: title, both kinds of caps and, if asked for, an explanation; normal: title and primary caps; forced: only what is not had yet."""
        if len(self.taken) >= self.n or self.products[i] in self.ids:
            return False
        title, tags = self.keys[i] or "", tags_of(self.tags[i])
        if mode != "forced" and ((title and title in self.titles) or not self.fits(tags, self.caps)):
            return False
        if mode == "strict" and (not self.fits(tags, self.secondary) or (self.needs_reason and not self.items["explained"][i])):
            return False
        self.taken.append(i)
        self.ids.add(self.products[i])
        self.titles.add(title)
        for t in tags:
            self.counts[t] = self.counts.get(t, 0) + 1
        return True

    def rows(self) -> list[tuple]:
        return [(k, self.products[i], self.items["prediction"][i]) for k, i in enumerate(self.taken, 1)]


GREEDY = ["pos", "product_id", "prediction", "title_key", "tags"]


def remove_duplicates(scored: DataFrame, n: int, caps: dict[str, int] | None = None, secondary: dict[str, int] | None = None, least: float = 0.0, forced: Sequence[int] = ()) -> DataFrame:
    """scored with title_key and tags (`a;b`). Three passes in the order of predictions: strict, normal, forced; forced ids come first.

    Taking one item decides what may follow, so each request's list is gone through in a Python worker. Requests are bounded by their candidates.
    """
    caps, secondary, forced = caps or {}, secondary or {}, set(forced)

    def run(items: dict[str, list]) -> list[tuple]:
        adder = Adder(n, caps, secondary, items)
        for i, product in enumerate(items["product_id"] if forced else ()):
            if product in forced:
                adder.add(i, "forced")
        good = [i for i, p in enumerate(items["prediction"]) if p is not None and p >= least]
        for mode in ("strict", "normal", "forced"):
            if len(adder.taken) >= n:
                break
            for i in good:
                adder.add(i, mode)
        return adder.rows()

    return by_request(scored, GREEDY, run, RESULT)


def combine_predictors(scores: DataFrame, weights: dict[int, int], n: int, caps: dict[str, int] | None = None) -> DataFrame:
    """scores long, with title_key and tags. In each round so many items of each predictor's list as its weight says; what is missing is filled from the first list."""
    caps, first = caps or {}, next(iter(weights))

    def run(items: dict[str, list]) -> list[tuple]:
        places = {}
        for i, p in enumerate(items["predictor_id"]):
            places.setdefault(p, []).append(i)
        lists = {p: iter(x) for p, x in places.items()}
        adder, live = Adder(n, caps, {}, items), [p for p in weights if p in lists]
        while live and len(adder.taken) < n:
            for p in list(live):
                got = 0
                for i in lists[p]:
                    got += adder.add(i, "strict")
                    if got >= weights[p] or len(adder.taken) >= n:
                        break
                else:
                    live.remove(p)
        for i in places.get(first, ()):
            adder.add(i, "forced")
        return adder.rows()

    return by_request(scores, [*GREEDY, "predictor_id"], run, RESULT)


def genre_cooccurrence(programmes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """programmes: channel, begin_ts, product_id, genres. (pairs: a, b, co; genres: a, f), of one programme and of it and the channel's next."""
    after = F.lead("genres").over(W.partitionBy("channel").orderBy("begin_ts", "product_id"))
    p = programmes.withColumn("next", after)
    f = p.select(F.explode("genres").alias("a")).groupBy("a").agg(F.count("*").alias("f"))
    own = p.select(F.explode("genres").alias("a"), "genres").select("a", F.explode("genres").alias("b")).where("a != b")
    adjacent = p.select(F.explode("genres").alias("a"), "next").select("a", F.explode("next").alias("b")).where("a != b")
    both = own.unionByName(adjacent).unionByName(adjacent.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a", "b").agg(F.count("*").alias("co")), f


def genre_similarity(a: Sequence[str], b: Sequence[str], s: dict[tuple[str, str], float]) -> float:
    """The mean over both sets' genres of the best similarity to the other set."""
    if not a or not b:
        return 0.0
    one = lambda x, y: 1.0 if x == y else s.get((x, y), 0.0)
    return (sum(max(one(x, y) for y in b) for x in a) + sum(max(one(y, x) for x in a) for y in b)) / (len(a) + len(b))


def virtual_channels(scored: DataFrame, similarity: dict[tuple[str, str], float], channels: int, most: int, catch_up: float = 0.5, late: float = 0.25) -> DataFrame:
    """scored: request_id, pos, product_id, prediction, begin_ts, end_ts, genres, now_ts. (request_id, channel, product_id, prediction).

    Live programmes are pivots: channel 0 gets the best, each further one the pivot least similar to those had. The others
    join the most similar channel, else the second, where their time is free and its share, that of catch-up programmes
    and that of those hours ahead allow. Genres are few: their similarities come as a dictionary.
    """
    per = max(1, most // channels)

    def run(items: dict[str, list]) -> list[tuple]:
        genres, unknown = [x or () for x in items["genres"]], float("nan")  # compares with nothing
        times = {c: [unknown if t is None else t for t in items[c]] for c in ("begin_ts", "end_ts", "now_ts")}
        items = items | times | {"genres": genres}
        order = [dict(zip(items, x, strict=True)) for x in zip(*items.values(), strict=True)]
        sim = lambda x, y: genre_similarity(x["genres"], y["genres"], similarity)
        live = [x for x in order if x["begin_ts"] <= x["now_ts"] and x["now_ts"] - x["begin_ts"] <= 1800 and x["end_ts"] - x["now_ts"] > x["now_ts"] - x["begin_ts"]][: 4 * channels + 1]
        pivots = live[:1]
        while len(pivots) < channels:
            left = [x for x in live if all(x is not p for p in pivots) and all(sim(x, p) <= 0.8 for p in pivots)]
            if not left:
                break
            pivots.append(min(left, key=lambda x: sum(sim(x, p) for p in pivots)))
        slots: list[list[dict]] = [[p] for p in pivots]
        past, ahead, used = 0, 0, {id(p) for p in pivots}
        for forced in (False, True):
            for x in order:
                if id(x) in used or not slots or sum(map(len, slots)) >= most:
                    continue
                old, far = x["end_ts"] <= x["now_ts"], x["begin_ts"] > x["now_ts"] + 6 * 3600
                if not forced and ((old and past >= catch_up * most) or (far and ahead >= late * most)):
                    continue
                for i in sorted(range(len(slots)), key=lambda i: -sim(x, pivots[i]))[:2]:
                    if (len(slots[i]) < per or forced) and all(x["end_ts"] <= y["begin_ts"] or x["begin_ts"] >= y["end_ts"] for y in slots[i]):
                        slots[i].append(x)
                        used.add(id(x))
                        past, ahead = past + old, ahead + far
                        break
        return [(i, x["product_id"], x["prediction"]) for i, s in enumerate(slots) for x in s]

    columns = ["pos", "product_id", "prediction", "begin_ts", "end_ts", "genres", "now_ts"]
    return by_request(scored, columns, run, "request_id long, channel int, product_id long, prediction double")
