"""Queries over the demonstration tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lodestar.functions import ranks as R, scalars as S
from lodestar.operators import decisions as D, evaluation as E, events as EV, filters as FL, popular as POP, predictors as P
from lodestar.plans.settings import Data, Settings, recommend, similar
from lodestar.sources import tables as T
from lodestar.streaming import updates as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = 86400
ATTRS = ("p_brand", "p_type")

# What the functions of sources.tables give, in SQL.
BASE = """
buys AS (SELECT o_custkey AS consumer_id, l_partkey AS product_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts_sec,
         CAST(least(100, floor(l_quantity * 2)) AS INT) AS rating, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
cands AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY product_id) AS pos
          FROM (SELECT DISTINCT l_orderkey AS request_id, consumer_id, product_id FROM buys)),
attrs AS (SELECT p_partkey AS product_id, 0 AS attr_idx, p_brand AS value FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part),
last AS (SELECT max(ts_sec) AS ts FROM buys),
"""
VIEWS = """views AS (SELECT consumer_id, product_id, unnest([0, CAST(floor(hour(to_timestamp(ts_sec) AT TIME ZONE 'UTC') / 4) AS INT)
          + CASE WHEN dayofweek(to_timestamp(ts_sec) AT TIME ZONE 'UTC') IN (0, 6) THEN 6 ELSE 0 END + 1]) AS context FROM buys),
"""
COUNTS = "counts AS (SELECT product_id, count(*) AS n FROM buys GROUP BY 1),\n"
SCORES = (
    COUNTS
    + """scores AS (SELECT request_id, pos, product_id, 1 AS predictor_id, CAST(n AS DOUBLE) AS prediction, 1.0 AS reliability FROM cands JOIN counts USING (product_id)
           UNION ALL SELECT request_id, pos, product_id, 2, p_retailprice, 1.0 FROM cands JOIN part ON product_id = p_partkey
           UNION ALL SELECT request_id, pos, product_id, 3, CAST(p_size AS DOUBLE), 0.5 FROM cands JOIN part ON product_id = p_partkey),
"""
)


def query(sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    """Registers a function, and its SQL behind BASE and `base`."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {BASE}{base}\nanswer AS ({sql})\nSELECT * FROM answer"
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(c, 6).alias(name or c)


def views(s: SparkSession, d: str) -> DataFrame:
    at = F.timestamp_seconds("ts_sec")
    return T.buys(s, d).select("consumer_id", "product_id", F.explode(F.array(F.lit(0), S.dayweekhour(at))).alias("context"))


def counts(s: SparkSession, d: str) -> DataFrame:
    return T.buys(s, d).groupBy("product_id").agg(F.count("*").alias("n"))


def scores(s: SparkSession, d: str) -> DataFrame:
    c = T.candidates(s, d).join(counts(s, d), "product_id").join(T.products(s, d), "product_id")
    each = [(1, F.col("n").cast("double"), 1.0), (2, F.col("p_retailprice"), 1.0), (3, F.col("p_size").cast("double"), 0.5)]
    row = F.explode(F.array(*[F.struct(F.lit(i).alias("predictor_id"), p.alias("prediction"), F.lit(w).alias("reliability")) for i, p, w in each])).alias("x")
    return c.select("request_id", "pos", "product_id", row).select("request_id", "pos", "product_id", "x.*")


def popularity(s: SparkSession, d: str) -> DataFrame:
    """Candidates with the product's number of events as prediction."""
    return T.candidates(s, d).join(counts(s, d), "product_id").select("request_id", "pos", "consumer_id", "product_id", F.col("n").cast("double").alias("prediction"))


POPULARITY = COUNTS + "scored AS (SELECT request_id, pos, consumer_id, product_id, CAST(n AS DOUBLE) AS prediction FROM cands JOIN counts USING (product_id)),\n"


# Recommending.


@query("""SELECT consumer_id, CAST(rank AS INT) AS rank, product_id, n FROM (
            SELECT consumer_id, product_id, n, row_number() OVER (PARTITION BY consumer_id ORDER BY n DESC, product_id) AS rank
            FROM (SELECT DISTINCT consumer_id FROM buys) CROSS JOIN counts
            WHERE (consumer_id, product_id) NOT IN (SELECT (consumer_id, product_id) FROM buys)) WHERE rank <= 10""", COUNTS)
def top_unseen_products(s, d):
    """The ten most bought products that each consumer has not bought."""
    return POP.most_bought_unseen(T.buys(s, d), 10)


@query("SELECT request_id, product_id FROM cands c ANTI JOIN (SELECT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') e ON c.consumer_id = o_custkey AND c.product_id = l_partkey")
def seen_anti_join(s, d):
    returned = T.table(s, d, "lineitem").where("l_returnflag = 'R'").join(T.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return FL.unseen(T.candidates(s, d), returned.select(F.col("o_custkey").alias("consumer_id"), F.col("l_partkey").alias("product_id"))).select("request_id", "product_id")


def seeds(s, d):
    return T.candidates(s, d).where("pos = 1").select("request_id", "product_id")


@query("SELECT request_id, product_id FROM cands WHERE pos != 1")
def seed_exclusion(s, d):
    return FL.without_seeds(T.candidates(s, d), seeds(s, d)).select("request_id", "product_id")


@query("SELECT request_id, product_id FROM cands SEMI JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON product_id = p_partkey")
def known_semi_join(s, d):
    return T.known(T.candidates(s, d), T.products(s, d).where("p_size <= 25")).select("request_id", "product_id")


# Events.


@query("SELECT product_id, count(*) AS freq FROM buys GROUP BY 1")
def product_freq(s, d):
    return EV.frequency(T.buys(s, d))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS consumers FROM events GROUP BY 1")
def event_count_by_type(s, d):
    return T.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("consumers"))


@query(f"""SELECT product_id, CAST(sum(CASE WHEN ts_sec > (SELECT ts FROM last) - {365 * DAY} THEN 1 ELSE -1 END) AS BIGINT) AS delta FROM buys GROUP BY 1
           HAVING sum(CASE WHEN ts_sec > (SELECT ts FROM last) - {365 * DAY} THEN 1 ELSE -1 END) != 0""")
def freq_delta(s, d):
    b = T.buys(s, d)
    at = b.agg(F.max("ts_sec").alias("last"))
    both = b.crossJoin(F.broadcast(at)).withColumn("new", F.col("ts_sec") > F.col("last") - 365 * DAY)
    return EV.frequency_delta(both.where("NOT new"), both.where("new"))


ORDER_SQL = "ts_sec, l_orderkey, l_linenumber, product_id, l_suppkey, l_extendedprice"


@query(f"""SELECT consumer_id, product_id, ts_sec FROM (SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY {', '.join(c + ' DESC' for c in ORDER_SQL.split(', '))}) AS r FROM buys) WHERE r <= 5""")
def retention_last_n(s, d):
    return EV.keep_last(T.buys(s, d), T.EVENT_ORDER, 5).select("consumer_id", "product_id", "ts_sec")


@query(f"SELECT consumer_id, product_id, ts_sec FROM (SELECT *, max(ts_sec) OVER (PARTITION BY consumer_id) AS m FROM buys) WHERE ts_sec >= m - {90 * DAY}")
def retention_time(s, d):
    return EV.keep_recent(T.buys(s, d), 90 * DAY).select("consumer_id", "product_id", "ts_sec")


@query("""SELECT consumer_id, product_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY ts DESC, product_id) AS r
          FROM (SELECT consumer_id, product_id, max(ts_sec) AS ts FROM buys GROUP BY 1, 2)) WHERE r <= 5""")
def last_n_distinct(s, d):
    return P.last_distinct(T.buys(s, d), ["ts_sec"], 5)


@query(f"SELECT ts_sec <= (SELECT ts FROM last) - {365 * DAY} AS train, count(*) AS n, CAST(sum(product_id) AS BIGINT) AS products FROM buys GROUP BY 1")
def train_test_split(s, d):
    b = T.buys(s, d)
    at = b.agg(F.max("ts_sec")).first()[0] - 365 * DAY
    a, z = E.split_by_date(b, at)
    both = a.withColumn("train", F.lit(True)).unionByName(z.withColumn("train", F.lit(False)))
    return both.groupBy("train").agg(F.count("*").alias("n"), F.sum("product_id").alias("products"))


@query("""SELECT CASE WHEN a.product_id = b.selected THEN 1 WHEN b.product_id = b.selected THEN -1 ELSE 0 END AS cmp, count(*) AS n FROM (SELECT l_orderkey, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
          arg_min(product_id, (l_linenumber, product_id, l_suppkey, l_extendedprice)) AS product_id FROM buys GROUP BY 1) a
          JOIN (SELECT l_orderkey, arg_max(product_id, (l_linenumber, product_id, l_suppkey, l_extendedprice)) AS product_id, arg_max(product_id, (l_extendedprice, product_id)) AS selected FROM buys GROUP BY 1) b USING (l_orderkey) GROUP BY 1""")
def compare_events(s, d):
    """The first and the last line of each order, of which the dearest product is selected."""
    at = F.struct("l_linenumber", "product_id", "l_suppkey", "l_extendedprice")
    pairs = T.buys(s, d).groupBy("l_orderkey").agg(F.min_by("product_id", at).alias("product_id"), F.max_by("product_id", at).alias("product_id_2"), F.max_by("product_id", F.struct("l_extendedprice", "product_id")).alias("selected"))
    return EV.compared(pairs).groupBy(F.col("cmp").cast("int").alias("cmp")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT consumer_id, product_id FROM buys WHERE ts_sec BETWEEN (SELECT ts FROM last) - {30 * DAY} AND (SELECT ts FROM last)")
def rec_log_lookup(s, d):
    b, o = T.buys(s, d), T.table(s, d, "orders")
    log = o.select(F.col("o_orderkey").alias("log_id"), F.col("o_custkey").alias("consumer_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"))
    rows = T.table(s, d, "lineitem").select(F.col("l_orderkey").alias("log_id"), F.col("l_partkey").alias("product_id"))
    last = b.agg(F.max("ts_sec")).first()[0]
    return T.recently_recommended(log, rows, F.lit(last - 30 * DAY), F.lit(last))


@query("SELECT p_partkey AS product_id, p_size > 25 AS tombstone FROM part WHERE p_size <= 25 OR p_partkey IN (SELECT product_id FROM buys)")
def product_tombstones(s, d):
    p = T.products(s, d)
    return T.tombstones(p.where("p_size <= 25").select("product_id"), p.select("product_id"), T.buys(s, d)).select("product_id", "tombstone")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id >= 100 AND event_id < 600")
def incremental_scan(s, d):
    """One batch of a given size: reading by ranges of ids is the operator."""
    return T.id_range(T.table(s, d, "events"), 100, 500).select("event_id", "user_id", "event_type")


@query("SELECT max(event_id) AS max_event FROM events")
def max_event_probe(s, d):
    return T.max_event(T.table(s, d, "events"))


@query("SELECT user_id AS consumer_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id, count(*) AS n FROM events GROUP BY 1, 2")
def json_fields(s, d):
    e = T.table(s, d, "events").select(F.col("user_id").alias("consumer_id"), S.json_field(F.col("props"), "k").try_cast("bigint").alias("product_id"))
    return e.groupBy("consumer_id", "product_id").agg(F.count("*").alias("n"))


# Aggregate predictors.


@query(f"""SELECT request_id, product_id, round(least(1, (0.01 + coalesce(n, 0)) / (SELECT count(DISTINCT consumer_id) FROM buys, last WHERE ts_sec >= ts - {365 * DAY})), 6) AS prediction
           FROM cands LEFT JOIN (SELECT product_id, count(*) AS n FROM buys, last WHERE ts_sec >= ts - {365 * DAY} GROUP BY 1) USING (product_id)""")
def avg_prob(s, d):
    return P.average_probability(T.candidates(s, d), T.buys(s, d), 365 * DAY).select("request_id", "product_id", r6("prediction"))


@query("SELECT product_id, context, round(count(*) / any_value(c), 6) AS prediction FROM views JOIN (SELECT context, count(DISTINCT consumer_id) AS c FROM views GROUP BY 1) USING (context) GROUP BY 1, 2", VIEWS)
def avg_prob_context(s, d):
    return P.probability_by_context(views(s, d)).select("product_id", "context", r6("prediction"))


@query("""SELECT request_id, product_id, round(coalesce(m, 0), 6) AS prediction FROM cands LEFT JOIN (
            SELECT product_id, arg_min(m, attr_idx) AS m FROM (SELECT a.product_id, attr_idx, max(m) AS m FROM attrs a JOIN (
              SELECT attr_idx, value, (sum(rating) + 5 * (SELECT sum(rating) / (count(*) + 1e-6) FROM buys JOIN attrs USING (product_id))) / (count(*) + 5) AS m FROM buys JOIN attrs USING (product_id) GROUP BY 1, 2)
              USING (attr_idx, value) GROUP BY 1, 2) GROUP BY 1) USING (product_id)""")
def avg_rating_blend(s, d):
    return P.average_rating(T.candidates(s, d), T.buys(s, d), T.product_attrs(s, d, *ATTRS), 5).select("request_id", "product_id", r6("prediction"))


@query("SELECT request_id, product_id, round(CASE WHEN seen THEN (1 + coalesce(n, 0)) / 2 ELSE 1 END, 6) AS prediction FROM cands LEFT JOIN (SELECT product_id, true AS seen, count(*) FILTER (context IN (0, 7)) AS n FROM views GROUP BY 1) USING (product_id)", VIEWS)
def count_views_context(s, d):
    return P.count_views(T.candidates(s, d), views(s, d), [0, 7]).select("request_id", "product_id", r6("prediction"))


@query("""SELECT request_id, product_id, round((coalesce(nm, 0) + 10 * ((coalesce(n0, 0) + 10 * coalesce(np, 0) / t) / (coalesce(a0, 0) + 10))) / (coalesce(am, 0) + 10), 6) AS prediction FROM cands
          LEFT JOIN (SELECT consumer_id, product_id, count(*) FILTER (context IN (0, 7)) / 2 AS nm, count(*) FILTER (context = 0) AS n0 FROM views GROUP BY 1, 2) USING (consumer_id, product_id)
          LEFT JOIN (SELECT consumer_id, count(*) FILTER (context IN (0, 7)) / 2 AS am, count(*) FILTER (context = 0) AS a0 FROM views GROUP BY 1) USING (consumer_id)
          LEFT JOIN (SELECT product_id, count(*) AS np FROM buys GROUP BY 1) USING (product_id), (SELECT count(*) AS t FROM buys)""", VIEWS)
def count_views_consumer_mest(s, d):
    return P.count_views_by_consumer(T.candidates(s, d), views(s, d), [0, 7], 10).select("request_id", "product_id", r6("prediction"))


@query(f"SELECT request_id, product_id, CAST(coalesce(n, 0) AS DOUBLE) AS prediction FROM cands LEFT JOIN (SELECT product_id, count(*) AS n FROM buys, last WHERE ts_sec >= ts - {365 * DAY} GROUP BY 1) USING (product_id)")
def count_views_window(s, d):
    return P.count_views_window(T.candidates(s, d), T.buys(s, d), 365 * DAY).select("request_id", "product_id", "prediction")


@query(f"""SELECT request_id, product_id, round(coalesce(p, 0), 6) AS prediction FROM cands LEFT JOIN (SELECT a.product_id, avg(n) AS p FROM attrs a JOIN
           (SELECT attr_idx, value, count(*) AS n FROM buys JOIN attrs USING (product_id), last WHERE ts_sec >= ts - {365 * DAY} GROUP BY 1, 2) USING (attr_idx, value) GROUP BY 1) USING (product_id)""")
def attr_views_window(s, d):
    return P.attribute_views(T.candidates(s, d), T.buys(s, d), T.product_attrs(s, d, *ATTRS), 365 * DAY).select("request_id", "product_id", r6("prediction"))


# Filters.


def named_events(s, d):
    lines, orders = T.table(s, d, "lineitem"), T.table(s, d, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("l_returnflag").alias("event_name"), F.col("o_custkey").alias("consumer_id"), F.col("l_partkey").alias("product_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts_sec"))


@query(f"""SELECT request_id, product_id FROM cands WHERE (request_id, product_id) NOT IN (SELECT (request_id, c.product_id) FROM cands c JOIN attrs a USING (product_id) JOIN (
             SELECT * FROM (SELECT *, rank() OVER (PARTITION BY consumer_id ORDER BY expiry DESC) AS r FROM (SELECT consumer_id, attr_idx, value, max(ts_sec + w) AS expiry FROM (
               SELECT o_custkey AS consumer_id, l_partkey AS product_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts_sec, CASE l_returnflag WHEN 'R' THEN {200 * DAY} ELSE {100 * DAY} END AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A'))
             JOIN attrs USING (product_id) GROUP BY 1, 2, 3) WHERE expiry >= (SELECT ts FROM last)) WHERE r <= 20) b ON b.consumer_id = c.consumer_id AND b.attr_idx = a.attr_idx AND b.value = a.value)""")
def attr_history_filter(s, d):
    attrs = T.product_attrs(s, d, *ATTRS)
    now = F.lit(T.buys(s, d).agg(F.max("ts_sec")).first()[0])
    blocked = FL.blocked_values(named_events(s, d), attrs, {"R": 200 * DAY, "A": 100 * DAY}, now, 20)
    return FL.attribute_filter(T.candidates(s, d), attrs, blocked).select("request_id", "product_id")


@query("""SELECT request_id, product_id FROM cands WHERE (request_id, product_id) NOT IN (SELECT (request_id, c.product_id) FROM cands c JOIN attrs a USING (product_id)
          JOIN (SELECT consumer_id, attr_idx, value, count(*) AS n FROM buys JOIN attrs USING (product_id) GROUP BY 1, 2, 3) k ON k.consumer_id = c.consumer_id AND k.attr_idx = a.attr_idx AND k.value = a.value GROUP BY request_id, c.product_id HAVING sum(n) > 12)""")
def attr_freq_filter(s, d):
    return FL.frequency_filter(T.candidates(s, d), T.buys(s, d), T.product_attrs(s, d, *ATTRS), 12).select("request_id", "product_id")


@query(f"""SELECT request_id, product_id FROM cands WHERE (request_id, product_id) NOT IN (SELECT (request_id, c.product_id) FROM cands c JOIN attrs a USING (product_id)
          JOIN (SELECT consumer_id, attr_idx, value, arg_max(rating, ({ORDER_SQL})) AS r FROM buys JOIN attrs USING (product_id) GROUP BY 1, 2, 3) k ON k.consumer_id = c.consumer_id AND k.attr_idx = a.attr_idx AND k.value = a.value WHERE r <= 20)""")
def negative_rating_filter(s, d):
    return FL.negative_rating_filter(T.candidates(s, d), T.buys(s, d), T.product_attrs(s, d, *ATTRS), 20, T.EVENT_ORDER).select("request_id", "product_id")


def programmes(s, d):
    """Lines as programmes: a supplier's channel, from the order's date, as many minutes as pieces times ten."""
    b = T.buys(s, d).join(T.products(s, d), "product_id")
    return b.select("l_orderkey", "l_linenumber", "product_id", "title", "p_brand", "p_type", F.col("l_suppkey").alias("channel"), F.col("ts_sec").alias("begin_ts"), (F.col("ts_sec") + F.col("rating") * 300).alias("end_ts"))


PROGRAMMES = "programmes AS (SELECT l_orderkey, l_linenumber, product_id, p_name AS title, p_brand, p_type, l_suppkey AS channel, ts_sec AS begin_ts, ts_sec + rating * 300 AS end_ts FROM buys JOIN part ON product_id = p_partkey),\n"


@query("SELECT l_orderkey, l_linenumber, product_id, begin_ts, end_ts FROM programmes WHERE end_ts - begin_ts BETWEEN 1800 AND 10800 AND NOT contains(title, 'red')", PROGRAMMES)
def short_programmes(s, d):
    return FL.short_programmes(programmes(s, d), 1800, "red").select("l_orderkey", "l_linenumber", "product_id", "begin_ts", "end_ts")


@query("SELECT channel, count(*) FILTER (begin_ts < now AND now < end_ts) AS live FROM programmes, (SELECT max(ts_sec) + 3600 AS now FROM buys) GROUP BY 1", PROGRAMMES)
def live_tag(s, d):
    now = T.buys(s, d).agg(F.max("ts_sec")).first()[0] + 3600
    return FL.live_tag(programmes(s, d), F.lit(now)).groupBy("channel").agg(F.count_if("live").alias("live"))


def episodes(s, d):
    size = F.col("p_size")
    return T.products(s, d).select("product_id", F.col("p_brand").alias("series"), F.floor(size / 10).cast("int").alias("season"), (size % 10).alias("episode"))


SERIES = """eps AS (SELECT p_partkey AS product_id, p_brand AS series, CAST(floor(p_size / 10) AS INT) AS season, p_size % 10 AS episode FROM part),
state AS (SELECT consumer_id, series, coalesce(arg_max(season, (ts_sec, product_id)) FILTER (season > 0), 0) AS ws, coalesce(arg_max(episode, (ts_sec, product_id)) FILTER (episode > 0), 0) AS we, max(ts_sec) AS watched FROM buys JOIN eps USING (product_id) GROUP BY 1, 2),
"""


@query(f"""SELECT request_id, product_id, CAST(CASE WHEN recent AND season = ws AND episode = we + 1 THEN 5 WHEN recent AND season = ws THEN 4 WHEN season > ws AND episode = 1 THEN 3 WHEN recent AND season > ws THEN 4 WHEN recent THEN 1 ELSE 0 END AS DOUBLE) AS prediction
           FROM (SELECT c.request_id, e.*, ws, we, watched > (SELECT ts FROM last) - {180 * DAY} AS recent, row_number() OVER (PARTITION BY c.request_id, e.series ORDER BY season, episode, pos) AS r
                 FROM cands c JOIN eps e USING (product_id) JOIN state t ON t.consumer_id = c.consumer_id AND t.series = e.series WHERE NOT (season < ws OR (season = ws AND episode <= we))) WHERE r = 1""", SERIES)
def series_next_episode(s, d):
    """For each request the next episode of every series (brand) among its candidates."""
    b = T.buys(s, d).join(episodes(s, d), "product_id")
    now = F.lit(T.buys(s, d).agg(F.max("ts_sec")).first()[0])
    return FL.series_next(T.candidates(s, d).join(episodes(s, d), "product_id"), FL.series_state(b, ["ts_sec", "product_id"]), now, 180 * DAY).select("request_id", "product_id", "prediction")


@query("SELECT request_id, product_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id, series ORDER BY season DESC, episode DESC, pos) AS r FROM cands JOIN eps USING (product_id)) WHERE r = 1", SERIES)
def series_latest(s, d):
    return FL.series_latest(T.candidates(s, d).join(episodes(s, d), "product_id")).select("request_id", "product_id")


@query("""SELECT source AS consumer_id, lang AS language, CAST(round((count(*) + 3) / (any_value(t) + 3) * 10) AS BIGINT) + 1 AS max_items FROM documents JOIN (SELECT source, count(*) AS t FROM documents GROUP BY 1) USING (source)
          WHERE lang NOT IN ('null', 'nullnull') AND NOT contains(lang, 'sl') GROUP BY 1, 2""")
def language_caps(s, d):
    h = T.table(s, d, "documents").select(F.col("source").alias("consumer_id"), F.col("lang").alias("language"))
    return FL.language_caps(h, 10).select("consumer_id", "language", "max_items")


CAPPED = """spoken AS (SELECT p_partkey AS product_id, p_type AS language FROM part),
caps AS (SELECT consumer_id, language, CAST(round((count(*) + 3) / (any_value(t) + 3) * 3) AS BIGINT) + 1 AS max_items
         FROM buys JOIN spoken USING (product_id) JOIN (SELECT consumer_id, count(*) AS t FROM buys GROUP BY 1) USING (consumer_id) WHERE NOT contains(language, 'sl') GROUP BY 1, 2),
"""


@query("""SELECT request_id, CAST(rank AS INT) AS rank, product_id, prediction FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY prediction DESC, pos) AS rank
          FROM (SELECT s.*, max_items, row_number() OVER (PARTITION BY request_id, language ORDER BY prediction DESC, pos) AS place FROM scored s JOIN spoken USING (product_id) LEFT JOIN caps USING (consumer_id, language))
          WHERE max_items IS NULL OR place <= max_items) WHERE rank <= 3""", POPULARITY + CAPPED)
def best_within_languages(s, d):
    """The best candidates, no more of each language (type) than the consumer's events have room for."""
    spoken = T.products(s, d).select("product_id", F.col("p_type").alias("language"))
    caps = FL.language_caps(T.buys(s, d).join(spoken, "product_id"), 3)
    return ranked(D.best_n(FL.within_language_caps(popularity(s, d).join(spoken, "product_id"), caps), 0, 3), "prediction")


@query("SELECT DISTINCT source AS channel, coalesce(lang, 'null') || coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, 'null') AS language FROM documents")
def languages(s, d):
    two = T.table(s, d, "documents").select(F.col("source").alias("channel"), F.col("lang").alias("l1"), F.when(F.col("lang") != "en", F.col("lang")).alias("l2"))
    return T.languages(two).distinct()


# Co-occurrence.

NEAR = 30 * DAY
PAIRS = f"""e AS (SELECT *, row_number() OVER (ORDER BY consumer_id, {ORDER_SQL}, rating) AS event FROM buys),
close AS (SELECT a.product_id AS a, b.product_id AS b FROM e a JOIN e b ON a.consumer_id = b.consumer_id AND a.event != b.event AND abs(a.ts_sec - b.ts_sec) <= {NEAR}),
co AS (SELECT a, b, count(*) AS co FROM close WHERE a != b GROUP BY 1, 2),
"""


@query("SELECT a, b, co FROM co", PAIRS)
def cooc_pairs(s, d):
    return P.cooccurrence(T.buys(s, d), NEAR)


@query("""SELECT request_id, product_id, round(coalesce(p, 0), 6) AS prediction FROM cands LEFT JOIN (SELECT request_id, c.product_id, sum(co / (j.n * sqrt(i.n))) AS p FROM cands c JOIN (SELECT DISTINCT consumer_id, product_id AS j FROM buys) h USING (consumer_id)
          JOIN co ON co.a = c.product_id AND co.b = h.j JOIN counts i ON i.product_id = c.product_id JOIN counts j ON j.product_id = h.j WHERE co >= 2 GROUP BY 1, 2) USING (request_id, product_id)""", PAIRS + COUNTS)
def item_lift_predict(s, d):
    b = T.buys(s, d)
    return P.item_lift(T.candidates(s, d), b.select("consumer_id", "product_id"), P.cooccurrence(b, NEAR), counts(s, d), 2).select("request_id", "product_id", r6("prediction"))


@query("""SELECT request_id, product_id, round(coalesce(p, 0), 6) AS prediction FROM (SELECT * FROM cands WHERE pos > 1) LEFT JOIN (SELECT c.request_id, c.product_id, sum(co / (j.n * sqrt(i.n))) AS p FROM cands c JOIN (SELECT request_id, product_id AS j FROM cands WHERE pos = 1) h USING (request_id)
          JOIN co ON co.a = c.product_id AND co.b = h.j JOIN counts i ON i.product_id = c.product_id JOIN counts j ON j.product_id = h.j WHERE c.pos > 1 GROUP BY 1, 2) USING (request_id, product_id)""", PAIRS + COUNTS)
def item_lift_similar(s, d):
    return P.item_lift(FL.without_seeds(T.candidates(s, d), seeds(s, d)), seeds(s, d), P.cooccurrence(T.buys(s, d), NEAR), counts(s, d), 0).select("request_id", "product_id", r6("prediction"))


@query("""SELECT request_id, product_id, round(1 + coalesce(p, 0), 6) AS prediction FROM cands LEFT JOIN (SELECT request_id, c.product_id, sum(co / sqrt(i.n * j.n)) AS p FROM cands c JOIN (SELECT DISTINCT consumer_id, product_id AS j FROM buys) h USING (consumer_id)
          JOIN co ON co.a = c.product_id AND co.b = h.j JOIN counts i ON i.product_id = c.product_id JOIN counts j ON j.product_id = h.j WHERE co / sqrt(i.n * j.n) > 0.01 GROUP BY 1, 2) USING (request_id, product_id)""", PAIRS + COUNTS)
def item_cosine(s, d):
    b = T.buys(s, d)
    return P.item_cosine(T.candidates(s, d), b, P.cooccurrence(b, NEAR), counts(s, d), 0.01).select("request_id", "product_id", r6("prediction"))


LIFT = (
    PAIRS
    + """vco AS (SELECT x.value AS a, y.value AS b, count(*) AS co FROM close JOIN attrs x ON x.product_id = close.a AND x.attr_idx = 0 JOIN attrs y ON y.product_id = close.b AND y.attr_idx = 0 GROUP BY 1, 2),
vn AS (SELECT a AS value, sum(co) AS n FROM vco GROUP BY 1),
lift AS (SELECT a, b, ((co + 10 * (i.n / t)) / (j.n + 10) + 0.001) / (i.n / t + 0.001) AS lift FROM vco JOIN vn i ON i.value = a JOIN vn j ON j.value = b, (SELECT sum(n) AS t FROM vn)),
"""
)


def lift(s, d):
    """Of brands, which are few, so that pairs of them are broadcast."""
    co, n = P.attribute_lift_model(T.buys(s, d), T.product_attrs(s, d, *ATTRS), NEAR)
    return F.broadcast(P.value_lift(co, n, 10, 0.001))


@query("SELECT a, b, round(lift, 6) AS lift FROM lift", LIFT)
def attr_lift_model(s, d):
    return lift(s, d).select("a", "b", r6("lift"))


@query(f"""SELECT request_id, product_id, round(coalesce(p, 0), 6) AS prediction FROM cands LEFT JOIN (SELECT request_id, product_id, exp(sum(s) / (20 + sum(sqrt(w)))) AS p FROM (
             SELECT *, rank() OVER (PARTITION BY request_id, product_id ORDER BY s DESC) AS r FROM (SELECT request_id, c.product_id, w, sqrt(w) * ln(lift) AS s FROM cands c JOIN attrs v ON v.product_id = c.product_id AND v.attr_idx = 0
             JOIN (SELECT consumer_id, value AS b, sum(CASE WHEN ts_sec > ts - {100 * DAY} THEN 2 ELSE 1 END) AS w FROM buys JOIN attrs USING (product_id), last WHERE attr_idx = 0 GROUP BY 1, 2) h USING (consumer_id) JOIN lift ON lift.a = v.value AND lift.b = h.b)) WHERE r <= 20 GROUP BY 1, 2) USING (request_id, product_id)""", LIFT)
def attr_lift_predict(s, d):
    now = F.lit(T.buys(s, d).agg(F.max("ts_sec")).first()[0])
    return P.attribute_lift(T.candidates(s, d), T.buys(s, d), T.product_attrs(s, d, *ATTRS), lift(s, d), now, 100 * DAY).select("request_id", "product_id", r6("prediction"))


@query("""SELECT request_id, product_id, round(coalesce(p, 1), 6) AS prediction FROM (SELECT * FROM cands WHERE pos > 1) LEFT JOIN (SELECT c.request_id, c.product_id, exp(sum(ln(lift))) AS p FROM cands c JOIN attrs v ON v.product_id = c.product_id AND v.attr_idx = 0
          JOIN (SELECT request_id, value AS b FROM cands JOIN attrs USING (product_id) WHERE pos = 1 AND attr_idx = 0) h USING (request_id) JOIN lift ON lift.a = v.value AND lift.b = h.b GROUP BY 1, 2) USING (request_id, product_id)""", LIFT)
def attr_lift_similar(s, d):
    c = FL.without_seeds(T.candidates(s, d), seeds(s, d))
    return P.attribute_lift_similar(c, seeds(s, d), T.product_attrs(s, d, *ATTRS), lift(s, d)).select("request_id", "product_id", r6("prediction"))


# Content models.

BAYES = (
    VIEWS
    + """combos AS (SELECT product_id, attr_idx || '=' || value AS combo FROM attrs UNION ALL
            SELECT a.product_id, '0=' || a.value || '&1=' || b.value FROM attrs a JOIN attrs b USING (product_id) WHERE a.attr_idx = 0 AND b.attr_idx = 1),
each AS (SELECT * FROM views JOIN combos USING (product_id)),
nca AS (SELECT consumer_id, combo, context, count(*) AS n FROM each GROUP BY ALL),
nc AS (SELECT consumer_id, context, count(*) AS n FROM each GROUP BY ALL),
na AS (SELECT combo, count(*) AS n FROM each WHERE context = 0 GROUP BY ALL),
tot AS (SELECT count(*) AS t FROM each WHERE context = 0),
"""
)


def bayes(s, d):
    combos = P.combinations(T.product_attrs(s, d, *ATTRS))
    return P.bayes_stats(views(s, d), combos), combos


@query("SELECT 0 AS g, context, count(*) AS rows, CAST(sum(n) AS BIGINT) AS n FROM nca GROUP BY ALL UNION ALL SELECT 2, context, count(*), CAST(sum(n) AS BIGINT) FROM nc GROUP BY ALL UNION ALL SELECT 4, context, count(DISTINCT combo), count(*) FROM each GROUP BY ALL UNION ALL SELECT 6, context, 1, count(*) FROM each GROUP BY ALL", BAYES)
def nb_stats(s, d):
    stats, _ = bayes(s, d)
    return stats.groupBy(F.col("g").cast("int").alias("g"), "context").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


@query("""SELECT request_id, product_id, round(coalesce(p, 0), 6) AS prediction FROM cands LEFT JOIN (SELECT request_id, product_id, greatest(exp(sum(ln(f)) / (count(*) * 0.5)) - 1, 0) AS p FROM (
            SELECT request_id, product_id, q.combo, greatest(0.9, least(1 + coalesce(any_value(ca0), 0) / 2, exp(0.5 * sum(ln((coalesce(x.n, 0) + 10 * pu) / (coalesce(y.n, 0) + 10) / p0))))) AS f FROM (
              SELECT *, (coalesce(ca0, 0) + 10 * p0) / (c0 + 10) AS pu, unnest([0, 7]) AS context FROM (
                SELECT c.*, k.combo, (coalesce(na.n, 0) + 1e-6) / (t + 2) AS p0, h.n AS c0, o.n AS ca0 FROM cands c JOIN combos k USING (product_id) JOIN nc h ON h.consumer_id = c.consumer_id AND h.context = 0
                LEFT JOIN na ON na.combo = k.combo LEFT JOIN nca o ON o.consumer_id = c.consumer_id AND o.combo = k.combo AND o.context = 0, tot)) q
            LEFT JOIN nca x ON x.consumer_id = q.consumer_id AND x.combo = q.combo AND x.context = q.context LEFT JOIN nc y ON y.consumer_id = q.consumer_id AND y.context = q.context GROUP BY request_id, product_id, q.combo)
          GROUP BY 1, 2) USING (request_id, product_id)""", BAYES)
def nb_predict(s, d):
    combos = P.combinations(T.product_attrs(s, d, *ATTRS))
    return P.naive_bayes(T.candidates(s, d), views(s, d), combos, [0, 7], 10).select("request_id", "product_id", r6("prediction"))


@query("""SELECT request_id, product_id, round(coalesce(p, 0), 6) AS prediction FROM (SELECT * FROM cands WHERE pos > 1) LEFT JOIN (SELECT request_id, product_id, greatest(exp(sum(ln(least(3, (coalesce(sa, 0) + 10 * p0) / (ss + 10) / p0))) / 2) - 1, 0) AS p FROM (
            SELECT c.request_id, c.product_id, (coalesce(na.n, 0) + 0.01) / (t + 2) AS p0, sd.n AS sa, sn.n AS ss FROM cands c JOIN combos k USING (product_id) LEFT JOIN na ON na.combo = k.combo
            LEFT JOIN (SELECT request_id, combo, count(*) AS n FROM cands JOIN combos USING (product_id) WHERE pos = 1 GROUP BY 1, 2) sd ON sd.request_id = c.request_id AND sd.combo = k.combo
            LEFT JOIN (SELECT request_id, count(*) AS n FROM cands JOIN combos USING (product_id) WHERE pos = 1 GROUP BY 1) sn ON sn.request_id = c.request_id, tot WHERE c.pos > 1) GROUP BY 1, 2) USING (request_id, product_id)""", BAYES)
def nb_similar(s, d):
    stats, combos = bayes(s, d)
    return P.naive_bayes_similar(FL.without_seeds(T.candidates(s, d), seeds(s, d)), seeds(s, d), stats, combos, 10, 2).select("request_id", "product_id", r6("prediction"))


@query("""SELECT request_id, value, CAST(greatest(greatest(0, 5 - floor((items - m) / 2)), floor(5 * coalesce(c, 0) / greatest(max(coalesce(c, 0)) OVER (PARTITION BY request_id), 1) / 2 + 0.5) + 1) AS BIGINT) AS max_items FROM
          (SELECT request_id, consumer_id, value, count(*) AS m FROM cands JOIN attrs USING (product_id) WHERE attr_idx = 1 GROUP BY 1, 2, 3) JOIN (SELECT request_id, count(*) AS items FROM cands GROUP BY 1) USING (request_id)
          LEFT JOIN (SELECT consumer_id, value, count(*) AS c FROM buys JOIN attrs USING (product_id) WHERE attr_idx = 1 GROUP BY 1, 2) USING (consumer_id, value)""")
def nb_constraints(s, d):
    types = T.product_attrs(s, d, *ATTRS).where("attr_idx = 1")
    return P.bayes_constraints(T.candidates(s, d), types, T.buys(s, d), 5)


@query("""SELECT request_id, product_id, round(mu + swd / sw, 6) AS prediction, round(reliability, 6) AS reliability FROM (SELECT request_id, product_id, any_value(mu) AS mu, sum(w) AS sw, sum(w * ((s + 5 * mu) / (n + 5) - mu)) AS swd, (count(s) + 1) / (count(*) + 1) AS reliability FROM (
            SELECT request_id, c.product_id, cv.s, cv.n, (k.s + g.s / g.n) / (k.n + 1) AS mu, ln(g.n / (v.n + 1)) * ln(cv.n + 1.1) AS w FROM cands c JOIN attrs a USING (product_id)
            JOIN (SELECT consumer_id, attr_idx, value, sum(rating) AS s, count(*) AS n FROM buys JOIN attrs USING (product_id) GROUP BY 1, 2, 3) cv ON cv.consumer_id = c.consumer_id AND cv.attr_idx = a.attr_idx AND cv.value = a.value
            JOIN (SELECT attr_idx, value, count(*) AS n FROM buys JOIN attrs USING (product_id) GROUP BY 1, 2) v ON v.attr_idx = a.attr_idx AND v.value = a.value
            JOIN (SELECT consumer_id, sum(rating) AS s, count(*) AS n FROM buys JOIN attrs USING (product_id) GROUP BY 1) k ON k.consumer_id = c.consumer_id, (SELECT sum(rating) AS s, count(*) AS n FROM buys JOIN attrs USING (product_id)) g) GROUP BY 1, 2)""")
def univariate_linear(s, d):
    return P.univariate_linear(T.candidates(s, d), T.buys(s, d), T.product_attrs(s, d, *ATTRS), 5).select("request_id", "product_id", r6("prediction"), r6("reliability"))


@query("SELECT p_partkey AS product_id, round(coalesce(CASE WHEN p_size > 10 THEN p_retailprice END, (SELECT avg(p_retailprice) FROM part WHERE p_size > 10)), 6) AS prediction FROM part")
def float_attr(s, d):
    p = T.products(s, d).withColumn("x", F.when(F.col("p_size") > 10, F.col("p_retailprice")))
    return P.float_attribute(p, "x").select("product_id", r6("prediction"))


@query("SELECT request_id, c.product_id, CAST(coalesce(n, 0) AS DOUBLE) AS prediction FROM cands c JOIN part ON c.product_id = p_partkey LEFT JOIN counts k ON k.product_id = p_size", COUNTS)
def id_substitution(s, d):
    """Each part is scored as the part that its size names."""
    ids = T.products(s, d).select("product_id", F.col("p_size").cast("long").alias("other_id"))
    return P.substituted(T.candidates(s, d), ids, counts(s, d).select("product_id", F.col("n").cast("double").alias("prediction"))).select("request_id", "product_id", "prediction")


@query("""SELECT request_id, product_id, CASE WHEN step > 0 THEN coalesce(lower, 0) ELSE prediction END AS prediction FROM (SELECT q.*, coalesce(step, 0) AS step, dr + coalesce(step, 0) AS spot FROM (SELECT *, dense_rank() OVER (PARTITION BY request_id ORDER BY prediction DESC) AS dr FROM scored) q
            LEFT JOIN (SELECT request_id, c.product_id, sum(n) AS step FROM scored c JOIN attrs a USING (product_id) JOIN neg ON neg.consumer_id = c.consumer_id AND neg.attr_idx = a.attr_idx AND neg.value = a.value GROUP BY 1, 2) USING (request_id, product_id)) z
          LEFT JOIN (SELECT DISTINCT request_id, dense_rank() OVER (PARTITION BY request_id ORDER BY prediction DESC) AS spot, prediction AS lower FROM scored) l USING (request_id, spot)""",
    POPULARITY + """neg AS (SELECT consumer_id, attr_idx, value, count(*) AS n FROM buys JOIN attrs USING (product_id) WHERE rating <= 10 GROUP BY 1, 2, 3 HAVING (consumer_id, attr_idx, value) NOT IN (SELECT (consumer_id, attr_idx, value) FROM buys JOIN attrs USING (product_id) WHERE rating >= 90)),
""")  # fmt: skip
def decrease_weight(s, d):
    b = T.buys(s, d)
    return P.decrease_by_attribute(popularity(s, d), b.where("rating >= 90"), b.where("rating <= 10"), T.product_attrs(s, d, *ATTRS), 1).select("request_id", "product_id", "prediction")


@query()
def mf_predict(s, d):
    """Candidates by a factorisation of centred ratings."""
    model = P.factorisation(T.buys(s, d))
    return model.transform(T.candidates(s, d)).select("request_id", "product_id", F.coalesce(F.nanvl("prediction", F.lit(None).cast("float")), F.lit(0.0)).cast("double").alias("prediction"))


# Hybrids.


@query("SELECT request_id, predictor_id, product_id, rank() OVER w - 1 + (count(*) OVER (PARTITION BY request_id, predictor_id, prediction) - 1) / 2 AS midrank FROM scores WINDOW w AS (PARTITION BY request_id, predictor_id ORDER BY prediction)", SCORES)
def midrank(s, d):
    return scores(s, d).select("request_id", "predictor_id", "product_id", R.midrank(F.col("prediction"), "request_id", "predictor_id").alias("midrank"))


CURVE = SCORES + """k AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY request_id, predictor_id) AS n, lag(prediction) OVER w AS before FROM scores WINDOW w AS (PARTITION BY request_id, predictor_id ORDER BY prediction DESC, pos)),
cp AS (SELECT *, k AS spot, lag(k) OVER (PARTITION BY request_id, predictor_id ORDER BY k) AS prev FROM k WHERE before != prediction),
curve AS (SELECT k.*, CASE WHEN spot IS NULL THEN 1000 WHEN prev IS NULL OR prev < k.n / 10 THEN greatest(0, 1000 - spot * 500 / (k.n / 10)) ELSE greatest(0, 500 - greatest(0, spot - k.n / 10) * 500 / (k.n - k.n / 10)) END AS points,
          CASE k.predictor_id WHEN 1 THEN 2.0 ELSE 1.0 END * k.reliability AS wr FROM k ASOF LEFT JOIN cp ON cp.request_id = k.request_id AND cp.predictor_id = k.predictor_id AND cp.spot < k.k),
"""  # fmt: skip
WEIGHTS = {1: 2.0, 2: 1.0, 3: 1.0}


@query("SELECT request_id, product_id, round(sum(CASE WHEN prediction > 0 AND points > 0.01 THEN points * wr ELSE 0 END) / sum(wr), 6) AS prediction FROM curve GROUP BY 1, 2", CURVE)
def combine_by_ranks(s, d):
    return P.combine_by_ranks(scores(s, d), WEIGHTS).select("request_id", "product_id", r6("prediction"))


@query("""SELECT request_id, product_id, round(sum(CASE WHEN prediction > 0 THEN (1000 - coalesce(last, 0)) * wr ELSE 0 END) / sum(wr), 6) AS prediction FROM (SELECT *, max(CASE WHEN before IS NULL OR before != prediction THEN k END)
          OVER (PARTITION BY request_id, predictor_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM curve) GROUP BY 1, 2""", CURVE)
def combine_by_ranks_similar(s, d):
    return P.combine_by_ranks_similar(scores(s, d), WEIGHTS).select("request_id", "product_id", r6("prediction"))


@query("SELECT request_id, product_id, sum(CASE predictor_id WHEN 1 THEN 2.0 ELSE 1.0 END * (n + 2 - k)) AS prediction FROM k GROUP BY 1, 2", CURVE)
def hybrid_sum(s, d):
    return P.hybrid_sum(scores(s, d), WEIGHTS).select("request_id", "product_id", "prediction")


@query("SELECT request_id, product_id, greatest(0, max(prediction)) AS prediction FROM scores GROUP BY 1, 2", SCORES)
def max_value(s, d):
    return P.max_value(scores(s, d)).select("request_id", "product_id", "prediction")


@query("SELECT request_id, product_id, round(product(pow(prediction, CASE predictor_id WHEN 1 THEN 0.5 WHEN 2 THEN -0.5 ELSE 0.25 END)), 6) AS prediction FROM scores GROUP BY 1, 2", SCORES)
def multiply_hybrid(s, d):
    return P.multiply(scores(s, d), {1: 0.5, 2: -0.5, 3: 0.25}).select("request_id", "product_id", r6("prediction"))


@query("""SELECT request_id, product_id, n, round(coalesce(p, 0), 6) AS similar FROM cands JOIN counts USING (product_id) LEFT JOIN (SELECT request_id, c.product_id, sum(co / (j.n * sqrt(i.n))) AS p FROM cands c
          JOIN (SELECT consumer_id, product_id AS j FROM (SELECT *, row_number() OVER (PARTITION BY consumer_id ORDER BY ts DESC, product_id) AS r FROM (SELECT consumer_id, product_id, max(ts_sec) AS ts FROM buys GROUP BY 1, 2)) WHERE r <= 5) h USING (consumer_id)
          JOIN co ON co.a = c.product_id AND co.b = h.j JOIN counts i ON i.product_id = c.product_id JOIN counts j ON j.product_id = h.j GROUP BY 1, 2) USING (request_id, product_id)""", PAIRS + COUNTS)
def similar_last_items(s, d):
    """Popularity, and item-to-item scores with the consumer's last five products as seeds."""
    b = T.buys(s, d)
    last = P.last_distinct(b, ["ts_sec"], 5).select("consumer_id", "product_id")
    both = P.item_lift(T.candidates(s, d), last, P.cooccurrence(b, NEAR), counts(s, d), 0)
    return both.join(counts(s, d), "product_id").select("request_id", "product_id", "n", r6("prediction", "similar"))


@query("""SELECT request_id, product_id, CAST(n AS DOUBLE) AS prediction FROM cands JOIN counts USING (product_id) JOIN part ON product_id = p_partkey WHERE p_size <= 25 AND (request_id, product_id) NOT IN
          (SELECT (request_id, c.product_id) FROM cands c JOIN attrs a USING (product_id) JOIN (SELECT consumer_id, attr_idx, value, count(*) AS n FROM buys JOIN attrs USING (product_id) GROUP BY 1, 2, 3) k ON k.consumer_id = c.consumer_id AND k.attr_idx = a.attr_idx AND k.value = a.value GROUP BY request_id, c.product_id HAVING sum(k.n) > 12)""", COUNTS)
def stick_together(s, d):
    """Steps in a row on one list: two filters, then popularity."""
    known = T.known(T.candidates(s, d), T.products(s, d).where("p_size <= 25"))
    left = FL.frequency_filter(known, T.buys(s, d), T.product_attrs(s, d, *ATTRS), 12)
    return left.join(counts(s, d), "product_id").select("request_id", "product_id", F.col("n").cast("double").alias("prediction"))


# Decisions.


def ranked(df, *more):
    return df.select("request_id", F.col("rank").cast("int").alias("rank"), "product_id", *more)


TOP = "CAST(row_number() OVER (PARTITION BY request_id ORDER BY {0} DESC, pos) AS INT) AS rank"


@query(f"SELECT * FROM (SELECT request_id, {TOP.format('prediction')}, product_id, prediction FROM scored WHERE prediction >= 25) WHERE rank <= 3", POPULARITY)
def best_n(s, d):
    return ranked(D.best_n(popularity(s, d), 25, 3), "prediction")


@query(f"SELECT * FROM (SELECT request_id, {TOP.format('prediction - m')}, product_id, prediction FROM scored JOIN (SELECT consumer_id, count(*) AS m FROM buys GROUP BY 1) USING (consumer_id) WHERE prediction >= m) WHERE rank <= 3", POPULARITY)
def best_prob(s, d):
    return ranked(D.best_prob(popularity(s, d), T.buys(s, d), 3), "prediction")


@query(f"SELECT * FROM (SELECT request_id, {TOP.format('prediction - least(m, 30)')}, product_id, prediction FROM scored JOIN (SELECT consumer_id, sum(rating) / (count(*) + 0.1) AS m FROM buys GROUP BY 1) USING (consumer_id) WHERE prediction >= 30 OR prediction >= m) WHERE rank <= 3", POPULARITY)
def best_rating(s, d):
    return ranked(D.best_rating(popularity(s, d), T.buys(s, d), 30, 3), "prediction")


def with_size(s, d):
    return popularity(s, d).join(T.products(s, d).select("product_id", "p_size", "p_retailprice", "title", "p_brand"), "product_id")


@query(f"SELECT * FROM (SELECT request_id, {TOP.format('prediction - p_size')}, product_id FROM scored JOIN part ON product_id = p_partkey WHERE prediction >= p_size) WHERE rank <= 3", POPULARITY)
def largest_offset(s, d):
    return ranked(D.largest_offset(with_size(s, d), "p_size", 3))


@query(f"SELECT * FROM (SELECT request_id, {TOP.format('p_retailprice')}, product_id FROM scored JOIN part ON product_id = p_partkey) WHERE rank <= 3", POPULARITY)
def popular(s, d):
    return ranked(D.popular(with_size(s, d), "p_retailprice", 3))


@query(f"""SELECT request_id, {TOP.format('prediction')}, product_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY spot) AS turn FROM (SELECT request_id, pos, product_id, prediction, min((k, i)) AS spot FROM (
             SELECT request_id, pos, product_id, prediction, row_number() OVER (PARTITION BY request_id ORDER BY prediction - 25 DESC, pos) AS k, 0 AS i FROM scored WHERE prediction >= 25
             UNION ALL SELECT request_id, pos, product_id, prediction, row_number() OVER (PARTITION BY request_id ORDER BY p_retailprice DESC, pos), 1 FROM scored JOIN part ON product_id = p_partkey) WHERE k <= 4 GROUP BY 1, 2, 3, 4)) WHERE turn <= 4""", POPULARITY)
def hybrid_decision(s, d):
    return ranked(D.round_robin([D.best_n(popularity(s, d), 25, 4), D.popular(with_size(s, d), "p_retailprice", 4)], 4))


@query(f"""SELECT * FROM (SELECT request_id, {TOP.format('p')}, product_id, p AS prediction FROM (SELECT request_id, pos, product_id, sum(w * m) AS p FROM (SELECT *, CASE predictor_id WHEN 1 THEN 2.0 ELSE 1.0 END AS w,
             rank() OVER (PARTITION BY request_id, predictor_id ORDER BY prediction) - 1 + (count(*) OVER (PARTITION BY request_id, predictor_id, prediction) - 1) / 2 AS m FROM scores) GROUP BY 1, 2, 3)) WHERE rank <= 3""", SCORES)
def rank_decision(s, d):
    return ranked(D.by_midranks(scores(s, d), WEIGHTS, 3), "prediction")


@query(f"""SELECT * FROM (SELECT request_id, {TOP.format('w')}, product_id, w AS weight FROM (SELECT request_id, pos, product_id, round(any_value(prediction) * pow(product(coalesce(c, 0) + 1.0), 1.0 / count(*)), 6) AS w FROM scored s JOIN attrs a USING (product_id)
           LEFT JOIN (SELECT consumer_id, attr_idx, value, count(*) AS c FROM buys JOIN attrs USING (product_id) GROUP BY 1, 2, 3) k ON k.consumer_id = s.consumer_id AND k.attr_idx = a.attr_idx AND k.value = a.value GROUP BY 1, 2, 3)) WHERE rank <= 3""", POPULARITY)
def attr_freq_decision(s, d):
    return ranked(D.by_attribute_frequency(popularity(s, d), T.buys(s, d), T.product_attrs(s, d, *ATTRS), 3), r6("weight"))


@query(f"""SELECT * FROM (SELECT request_id, {TOP.format('prediction')}, product_id, prediction FROM (SELECT *, row_number() OVER (PARTITION BY request_id, substr(p_name, 1, 7) ORDER BY prediction DESC, pos) AS t FROM scored JOIN part ON product_id = p_partkey) WHERE t = 1) WHERE rank <= 3""", POPULARITY)
def remove_duplicate_titles(s, d):
    x = with_size(s, d).withColumn("title_key", S.title_prefix(F.col("title")))
    return ranked(D.distinct_titles(x, 3), "prediction")


@query()
def remove_duplicates(s, d):
    """Greedy passes under title and brand caps."""
    x = with_size(s, d).select("request_id", "pos", "product_id", "prediction", S.title_prefix(F.col("title")).alias("title_key"), F.col("p_brand").alias("tags"))
    return D.remove_duplicates(x, 3, {"Brand#11": 1, "Brand#12": 1})


@query()
def combine_predictors(s, d):
    x = scores(s, d).join(T.products(s, d).select("product_id", S.title_prefix(F.col("title")).alias("title_key"), F.col("p_brand").alias("tags")), "product_id")
    return D.combine_predictors(x, {1: 2, 2: 1}, 4, {"Brand#11": 1})


def genres(s, d):
    return programmes(s, d).withColumn("genres", F.array("p_type", "p_brand"))


@query("""SELECT a, b, count(*) AS co FROM (SELECT unnest([p_type, p_brand]) AS a, unnest([p_brand, p_type]) AS b FROM g UNION ALL SELECT x, y FROM adj UNION ALL SELECT y, x FROM adj) WHERE a != b GROUP BY 1, 2""",
    PROGRAMMES + """g AS (SELECT *, lead(p_type) OVER w AS nt, lead(p_brand) OVER w AS nb FROM programmes WINDOW w AS (PARTITION BY channel ORDER BY begin_ts, product_id, l_orderkey, l_linenumber)),
adj AS (SELECT x, y FROM (SELECT unnest([p_type, p_type, p_brand, p_brand]) AS x, unnest([nt, nb, nt, nb]) AS y FROM g WHERE nt IS NOT NULL) WHERE x != y),
""")  # fmt: skip
def genre_pairs(s, d):
    x = genres(s, d).withColumn("product_id", F.struct("product_id", "l_orderkey", "l_linenumber"))
    return D.genre_cooccurrence(x)[0]


@query()
def virtual_channels(s, d):
    """Each supplier's programmes of a day as a request: two virtual channels out of them."""
    pairs, f = D.genre_cooccurrence(genres(s, d))
    n = {r.a: r.f for r in f.collect()}
    sim = {(r.a, r.b): r.co / (n[r.a] * n[r.b]) ** 0.5 for r in pairs.collect()}
    x = genres(s, d).select(F.xxhash64("channel", "begin_ts").alias("request_id"), "product_id", "begin_ts", "end_ts", "genres", (F.col("begin_ts") + 900).alias("now_ts"), (F.col("end_ts") - F.col("begin_ts")).cast("double").alias("prediction"))
    x = x.withColumn("pos", F.row_number().over(W.partitionBy("request_id").orderBy("product_id", "end_ts")))
    return D.virtual_channels(x, sim, 2, 6)


# Scalars.


@query("""SELECT p_partkey AS product_id, substr(p_name, 1, 7) AS prefix, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(capital, '[^a-zA-Z]+')[2:], lambda t: regexp_full_match(t, '[A-Z].{4,}')))), ' ') AS tokens
          FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS capital FROM part)""")
def title_tokens(s, d):
    return T.products(s, d).select("product_id", S.title_prefix(F.col("title")).alias("prefix"), F.array_join(F.array_sort(S.multisplit(F.initcap("title"))), " ").alias("tokens"))


@query("SELECT CAST(greatest(0, least(100, trunc(l_quantity * 2 + 1))) AS INT) AS rating, count(*) AS n FROM lineitem GROUP BY 1")
def rating_formula(s, d):
    raw = T.table(s, d, "lineitem").select(F.col("l_quantity").cast("string").alias("rating"))
    return raw.select(S.rating_of("rating * 2 + 1").alias("rating")).groupBy("rating").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(floor(hour(ts) / 4) + CASE WHEN dayofweek(ts) IN (0, 6) THEN 6 ELSE 0 END + 1 AS INT) AS slot, CASE WHEN hour(ts) <= 6 THEN 1 WHEN hour(ts) <= 12 THEN 2 WHEN hour(ts) <= 18 THEN 3 WHEN hour(ts) <= 23 THEN 4 END AS part FROM events")
def contexts(s, d):
    at = F.col("ts")
    return T.table(s, d, "events").select("event_id", S.dayweekhour(at).alias("slot"), S.daytime(at, [6, 12, 18, 23]).alias("part"))


@query("""SELECT a.consumer_id, round(len(list_intersect(a.v, b.v)) / len(list_distinct(a.v || b.v)), 6) AS jaccard, round(len(list_intersect(a.v, b.v)) / sqrt(len(a.v) * len(b.v)), 6) AS cosine FROM (SELECT consumer_id, list(DISTINCT value) AS v FROM buys JOIN attrs USING (product_id) WHERE rating > 50 GROUP BY 1) a
          JOIN (SELECT consumer_id, list(DISTINCT value) AS v FROM buys JOIN attrs USING (product_id) WHERE rating <= 50 GROUP BY 1) b USING (consumer_id)""")
def set_similarities(s, d):
    v = T.buys(s, d).join(T.product_attrs(s, d, *ATTRS), "product_id").groupBy("consumer_id").agg(F.collect_set(F.when(F.col("rating") > 50, F.col("value"))).alias("a"), F.collect_set(F.when(F.col("rating") <= 50, F.col("value"))).alias("b"))
    return v.where((F.size("a") > 0) & (F.size("b") > 0)).select("consumer_id", r6(S.jaccard(F.col("a"), F.col("b")), "jaccard"), r6(S.cosine(F.col("a"), F.col("b")), "cosine"))


@query("SELECT p_partkey AS product_id, round(least(abs(p_size - 20) / 90, 1), 6) AS run_time, round(least(abs(2000 + p_size - 2020) * CASE WHEN 2050 - greatest(2000 + p_size, 2020) <= 1 THEN 5 WHEN 2050 - greatest(2000 + p_size, 2020) <= 5 THEN 2 WHEN 2050 - greatest(2000 + p_size, 2020) <= 10 THEN 1.5 ELSE 1 END / 50, 1), 6) AS year FROM part")
def attr_distance(s, d):
    p = T.products(s, d)
    return p.select("product_id", r6(S.run_time_distance(F.col("p_size"), F.lit(20)), "run_time"), r6(S.year_distance(2000 + F.col("p_size"), F.lit(2020), 2050), "year"))


@query("""SELECT p_partkey AS product_id, round(CASE WHEN x < 0 THEN 1 - u ELSE u END, 6) AS p FROM (SELECT *, 1 - exp(-x * x / 2) * 0.3989422804014327 * (0.319381530 * t - 0.356563782 * t ** 2 + 1.781477937 * t ** 3 - 1.821255978 * t ** 4 + 1.330274429 * t ** 5) AS u
          FROM (SELECT p_partkey, (p_size - 25) / 10 AS x, 1 / (1 + 0.2316419 * abs((p_size - 25) / 10)) AS t FROM part))""")
def cndf(s, d):
    return T.products(s, d).select("product_id", r6(S.normal_cdf((F.col("p_size") - 25) / 10), "p"))


@query("SELECT round(coalesce(avg(l_quantity), 0), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS std FROM lineitem")
def mean_std(s, d):
    return S.mean_and_std(T.table(s, d, "lineitem"), "l_quantity").select(r6("mean"), r6("std"))


@query("""SELECT doc_id, term, tf, round(score, 6) AS score FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY score DESC) AS r FROM (SELECT doc_id, term, tf, tf * ln((SELECT count(DISTINCT text) FROM documents) / df) AS score FROM tf JOIN (SELECT term, count(DISTINCT text) AS df FROM tf GROUP BY 1) USING (term) WHERE df >= 5) WHERE score > 0) WHERE r <= 5""",
    """pos AS (SELECT doc_id, text, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, text, string_split_regex(text, '[^a-zA-Z]+') AS t FROM documents)),
ok AS (SELECT doc_id, text, i, CASE WHEN regexp_full_match(w, '[A-Z].{3,}') THEN lower(w) END AS w FROM pos),
tf AS (SELECT doc_id, text, term, count(*) AS tf FROM (SELECT doc_id, text, w AS term FROM ok UNION ALL SELECT a.doc_id, a.text, coalesce(a.w, '') || b.w FROM ok a JOIN ok b ON a.doc_id = b.doc_id AND b.i = a.i + 1) WHERE term IS NOT NULL GROUP BY 1, 2, 3),
""")  # fmt: skip
def tfidf_terms(s, d):
    return S.tfidf_terms(T.table(s, d, "documents").select("doc_id", "text")).select("doc_id", "term", "tf", r6("score"))


# Evaluation: what an order's customer bought, as ranked by popularity, against what was rated well.


def lists(s, d):
    x = popularity(s, d).join(T.buys(s, d).groupBy(F.col("l_orderkey").alias("request_id"), "product_id").agg(F.max("rating").alias("rating")), ["request_id", "product_id"])
    top = D.select_best(x, F.col("prediction"), 3)
    rec = top.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda r: r["product_id"]).alias("recommended"))
    return x.groupBy("request_id").agg(F.collect_list(F.when(F.col("rating") >= 60, F.col("product_id"))).alias("relevant")).join(rec, "request_id")


LISTS = POPULARITY + f"""q AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY prediction DESC, pos) AS rank FROM scored JOIN (SELECT l_orderkey AS request_id, product_id, max(rating) >= 60 AS hit FROM buys GROUP BY 1, 2) USING (request_id, product_id)),
m AS (SELECT request_id, count(*) FILTER (hit) AS relevant, count(*) FILTER (hit AND rank <= 3) AS hits, least(3, count(*)) AS recommended FROM q GROUP BY 1),
"""  # fmt: skip


@query("SELECT round(avg(hits / recommended), 6) AS precision FROM m", LISTS)
def eval_precision(s, d):
    return E.precision(lists(s, d)).select(r6("precision"))


@query("SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f FROM (SELECT avg(hits / recommended) AS p, avg(hits / relevant) AS r FROM m WHERE relevant > 0)", LISTS)
def eval_recall_f(s, d):
    return E.recall_precision_f(lists(s, d)).select(r6("precision"), r6("recall"), r6("f"))


@query("""SELECT round(avg(coalesce(ap, 0)), 6) AS map FROM m LEFT JOIN (SELECT request_id, sum(CASE WHEN hit THEN so_far / rank ELSE 0 END) / max(rank) AS ap FROM (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY request_id ORDER BY rank) AS so_far FROM q WHERE rank <= 3) GROUP BY 1) USING (request_id) WHERE relevant > 0""", LISTS)
def eval_map(s, d):
    return E.mean_average_precision(lists(s, d)).select(r6("map"))


@query("SELECT round(sqrt(avg((b.rating - p) ** 2)), 6) AS rmse FROM buys b JOIN (SELECT product_id, avg(rating) AS p FROM buys GROUP BY 1) USING (product_id)")
def eval_rmse(s, d):
    b = T.buys(s, d)
    return E.root_mean_squared_error(b.join(b.groupBy("product_id").agg(F.avg("rating").alias("prediction")), "product_id")).select(r6("rmse"))


@query("""SELECT CAST(c.i AS INT) AS consumer_bucket, CAST(p.i AS INT) AS product_bucket, count(*) AS n FROM (SELECT consumer_id, count(*) AS nc FROM buys GROUP BY 1) JOIN buys USING (consumer_id) JOIN counts USING (product_id)
          JOIN (VALUES (0, 0, 20), (1, 20, 50), (2, 50, 10000)) c(i, a, b) ON nc BETWEEN c.a AND c.b JOIN (VALUES (0, 0, 20), (1, 20, 50), (2, 50, 10000)) p(i, a, b) ON n BETWEEN p.a AND p.b GROUP BY 1, 2""", COUNTS)
def eval_focus_buckets(s, d):
    b = T.buys(s, d)
    x = b.join(b.groupBy("consumer_id").agg(F.count("*").alias("nc")), "consumer_id").join(counts(s, d), "product_id")
    return E.focus_buckets(x.select("nc", "n"), "nc", "n").groupBy("consumer_bucket", "product_bucket").agg(F.count("*").alias("n"))



@query(f"""SELECT round(avg(hits / 10), 6) AS precision, round(avg(hits / relevant), 6) AS recall, round(2 * avg(hits / 10) * avg(hits / relevant) / (avg(hits / 10) + avg(hits / relevant)), 6) AS f FROM (
             SELECT consumer_id, count(*) AS relevant, count(r.product_id) AS hits FROM (SELECT DISTINCT consumer_id, product_id FROM test) t JOIN (SELECT DISTINCT consumer_id FROM train) USING (consumer_id) LEFT JOIN rec r USING (consumer_id, product_id) GROUP BY 1)""",
    f"""train AS (SELECT * FROM buys, last WHERE ts_sec <= ts - {365 * DAY}), test AS (SELECT * FROM buys, last WHERE ts_sec > ts - {365 * DAY}),
rec AS (SELECT * FROM (SELECT consumer_id, product_id, row_number() OVER (PARTITION BY consumer_id ORDER BY n DESC, product_id) AS rank FROM (SELECT DISTINCT consumer_id FROM train) CROSS JOIN (SELECT product_id, count(*) AS n FROM train GROUP BY 1)
        WHERE (consumer_id, product_id) NOT IN (SELECT (consumer_id, product_id) FROM train)) WHERE rank <= 10),
""")  # fmt: skip
def eval_by_date(s, d):
    """Fitted on what lies before the last year, measured on that year."""
    b = T.buys(s, d)
    train, test = E.split_by_date(b, b.agg(F.max("ts_sec")).first()[0] - 365 * DAY)
    rec = POP.most_bought_unseen(train, 10).groupBy("consumer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda r: r["product_id"]).alias("recommended"))
    both = test.groupBy("consumer_id").agg(F.collect_set("product_id").alias("relevant")).join(rec, "consumer_id")
    return E.recall_precision_f(both).select(r6("precision"), r6("recall"), r6("f"))


# Streaming: the same tables as streams, run until they have caught up.


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_view_counts(s, d):
    return ST.view_counts(s, ST.event_stream(s, d))


@query(f"""SELECT user_id, k, expiry FROM (SELECT user_id, json_extract_string(props, '$.k') AS k, max(CAST(floor(epoch(ts)) AS BIGINT) + CASE event_type WHEN 'purchase' THEN {20 * DAY} ELSE {5 * DAY} END) AS expiry FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1, 2)
           WHERE expiry >= (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM events)""")
def stream_ttl_filter(s, d):
    """What blocks products of each consumer at the end of the stream."""
    now = T.table(s, d, "events").agg(F.floor(F.max(F.unix_timestamp(F.col("ts").cast("timestamp")))).alias("now")).first()[0]
    return ST.blocked_values(s, ST.event_stream(s, d), {"purchase": 20 * DAY, "click": 5 * DAY}).where(F.col("expiry") >= now)


# Settings: the operators above by name.

SETTINGS = {
    "PREDICTOR": "steps", "DECISION": "best", "NOT_RECOMMEND_EVENTS": "",
    "steps_CLASS": "StickTogether", "steps_PREDICTORS": "rare;views;price;both",
    "rare_CLASS": "FilterByAttributeFrequency", "rare_THRESHOLD": "30",
    "views_CLASS": "CountViewsTimeWindow", "views_ID": "1", "views_TIME_WINDOW": "100000000000",
    "price_CLASS": "FloatAttribute", "price_ID": "2", "price_ATTRIBUTE": "p_retailprice",
    "both_CLASS": "HybridSum", "both_ID": "0", "both_PREDICTOR_IDS": "1;2", "both_PREDICTION_MULTIPLIERS": "2;1",
    "best_CLASS": "GetBestNProducts", "best_MIN_PREDICTION": "0",
}


@query(f"""SELECT * FROM (SELECT request_id, {TOP.format('prediction')}, product_id, prediction FROM (SELECT request_id, pos, product_id, 2.0 * (c + 2 - row_number() OVER (PARTITION BY request_id ORDER BY n DESC, pos)) + (c + 2 - row_number() OVER (PARTITION BY request_id ORDER BY p_retailprice DESC, pos)) AS prediction
           FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS c FROM cands JOIN counts USING (product_id) JOIN part ON product_id = p_partkey WHERE (request_id, product_id) NOT IN (SELECT (request_id, c.product_id) FROM cands c JOIN attrs a USING (product_id)
             JOIN (SELECT consumer_id, attr_idx, value, count(*) AS n FROM buys JOIN attrs USING (product_id) GROUP BY 1, 2, 3) k ON k.consumer_id = c.consumer_id AND k.attr_idx = a.attr_idx AND k.value = a.value GROUP BY request_id, c.product_id HAVING sum(k.n) > 30)))) WHERE rank <= 3""", COUNTS)
def settings_pipeline(s, d):
    """A tree of operators that settings describe, applied to all requests."""
    data = Data(T.buys(s, d), T.products(s, d), T.product_attrs(s, d, *ATTRS))
    return ranked(recommend(Settings(SETTINGS), data, T.candidates(s, d), 3), "prediction")


SIMILAR_SETTINGS = {
    "PREDICTOR": "steps", "DECISION": "best",
    "steps_CLASS": "StickTogether", "steps_PREDICTORS": "rare;lift",
    "rare_CLASS": "FilterByAttributeFrequency", "rare_THRESHOLD": "30",
    "lift_CLASS": "ItemBasedLift", "lift_ID": "1", "lift_THRESHOLD": "0", "lift_RELEVANT_TIME": str(NEAR),
    "best_CLASS": "GetBestNProducts", "best_MIN_PREDICTION": "0",
}


@query(f"""SELECT * REPLACE (round(prediction, 6) AS prediction) FROM (SELECT request_id, {TOP.format('prediction')}, product_id, prediction FROM (SELECT request_id, pos, product_id, coalesce(p, 0) AS prediction FROM (SELECT * FROM cands WHERE pos > 1)
          LEFT JOIN (SELECT c.request_id, c.product_id, sum(co / (j.n * sqrt(i.n))) AS p FROM cands c JOIN (SELECT request_id, product_id AS j FROM cands WHERE pos = 1) h USING (request_id)
          JOIN co ON co.a = c.product_id AND co.b = h.j JOIN counts i ON i.product_id = c.product_id JOIN counts j ON j.product_id = h.j GROUP BY 1, 2) USING (request_id, product_id))) WHERE rank <= 3""", PAIRS + COUNTS)
def settings_pipeline_similar(s, d):
    """A tree of operators over the products like each request's seeds."""
    data = Data(T.buys(s, d), T.products(s, d), T.product_attrs(s, d, *ATTRS))
    return ranked(similar(Settings(SIMILAR_SETTINGS), data, T.candidates(s, d), seeds(s, d), 3), r6("prediction"))


EVENT_SETTINGS = {
    "PREDICTOR": "steps", "DECISION": "mixed", "NOT_RECOMMEND_EVENTS": "R",
    "steps_CLASS": "StickTogether", "steps_PREDICTORS": "views;price;negative",
    "views_CLASS": "CountViewsTimeWindow", "views_ID": "1", "views_TIME_WINDOW": "100000000000",
    "price_CLASS": "FloatAttribute", "price_ID": "2", "price_ATTRIBUTE": "p_retailprice",
    "negative_CLASS": "NegativeRatingFilter", "negative_NEGATIVE_VALUE": "-1",
    "mixed_CLASS": "CombineByRanksDecision", "mixed_PREDICTOR_IDS": "1;2", "mixed_PREDICTOR_WEIGHTS": "2;1",
}


@query(f"""SELECT * FROM (SELECT request_id, {TOP.format('prediction')}, product_id, prediction FROM (SELECT request_id, pos, product_id, 2.0 * (rank() OVER (PARTITION BY request_id ORDER BY n) - 1 + (count(*) OVER (PARTITION BY request_id, n) - 1) / 2)
            + rank() OVER (PARTITION BY request_id ORDER BY p_retailprice) - 1 + (count(*) OVER (PARTITION BY request_id, p_retailprice) - 1) / 2 AS prediction
          FROM cands c JOIN counts USING (product_id) JOIN part ON product_id = p_partkey
          ANTI JOIN (SELECT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') e ON c.consumer_id = o_custkey AND c.product_id = l_partkey)) WHERE rank <= 3""", COUNTS)
def settings_by_event_type(s, d):
    """Events of one type keep products out, those of all types count; the last step is a filter, and scores are combined by the decision."""
    lines = T.table(s, d, "lineitem").join(T.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    events = lines.select(F.col("l_returnflag").alias("event_name"), F.col("o_custkey").alias("consumer_id"), F.col("l_partkey").alias("product_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts_sec"), F.lit(0).alias("rating"))
    data = Data(events, T.products(s, d), T.product_attrs(s, d, *ATTRS))
    return ranked(recommend(Settings(EVENT_SETTINGS), data, T.candidates(s, d), 3), "prediction")
