"""Sources: settings, products, attributes, consumers, events, look-ups, and the demonstration tables in these shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lodestar.functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A query over JDBC, in ranges of a key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return reader.option("query", query).load()
    return reader.option("dbtable", f"({query}) AS q").option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def settings(df: DataFrame, recommender_id: int) -> dict[str, str]:
    """recommender_id, setting_name, setting_value. A recommender's settings are few."""
    return {r.setting_name: r.setting_value for r in df.where(F.col("recommender_id") == recommender_id).collect()}


def known(df: DataFrame, products: DataFrame) -> DataFrame:
    """Rows whose product is known."""
    return df.join(products.select("product_id"), "product_id", "left_semi")


def attributes(raw: DataFrame, products: DataFrame, fields: list[str]) -> DataFrame:
    """raw: product_id, attributes and related (JSON), partner_product_code. Wide rows of known products; field specs are `name` or `related:name`."""
    one = known(raw, products)
    cols = [F.col("partner_product_code").alias(f) if f == "$partner_product_code" else S.json_field(F.col("related" if f.startswith("related:") else "attributes"), f.removeprefix("related:")).alias(f.removeprefix("related:")) for f in fields]
    return one.select("product_id", *cols)


def refreshed(old: DataFrame, new: DataFrame) -> DataFrame:
    """new rows, with the old row's value where a field is missing."""
    names = [c for c in new.columns if c != "product_id"]
    both = new.alias("n").join(old.alias("o"), "product_id", "left")
    return both.select("product_id", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in names])


def id_range(events: DataFrame, last_read: int, batch: int) -> DataFrame:
    """The next batch of events: ids in [last_read, last_read + batch)."""
    return events.where((F.col("event_id") >= last_read) & (F.col("event_id") < last_read + batch))


def max_event(events: DataFrame) -> DataFrame:
    return events.agg(F.max("event_id").alias("max_event"))


def recently_recommended(log: DataFrame, rows: DataFrame, since: Column, upto: Column) -> DataFrame:
    """(consumer_id, product_id) that requests of a time recommended. log: log_id, consumer_id, ts; rows: log_id, product_id."""
    return rows.join(log.where((F.col("ts") <= upto) & (F.col("ts") >= since)), "log_id").select("consumer_id", "product_id").distinct()


def languages(df: DataFrame) -> DataFrame:
    """channel, l1, l2: the channel's language, where a missing half reads `null`."""
    return df.select("channel", F.concat(F.coalesce("l1", F.lit("null")), F.coalesce("l2", F.lit("null"))).alias("language"))


def tombstones(new: DataFrame, old: DataFrame, events: DataFrame) -> DataFrame:
    """New products, and old ones that events still refer to."""
    left = old.join(events.select("product_id").distinct(), "product_id", "left_semi").join(new.select("product_id"), "product_id", "left_anti")
    return new.withColumn("tombstone", F.lit(False)).unionByName(left.select(*new.columns).withColumn("tombstone", F.lit(True)))


# The demonstration tables in the shapes above.


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), "p_brand", "p_type", "p_size", "p_retailprice")


def product_attrs(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Tall, in the order of the names."""
    p = products(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("attr_idx"), F.lit(n).alias("attr_name"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names)])).alias("a")
    return p.select("product_id", each).select("product_id", "a.*")


def buys(spark: SparkSession, d: str) -> DataFrame:
    """consumer_id, product_id, ts_sec, rating, and what orders the events."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("consumer_id"), F.col("l_partkey").alias("product_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts_sec"),
        F.least(F.lit(100), F.floor(F.col("l_quantity") * 2)).cast("int").alias("rating"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
    )


EVENT_ORDER = ["ts_sec", "l_orderkey", "l_linenumber", "product_id", "l_suppkey", "l_extendedprice"]


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """A request for each order: its customer, and its parts to choose from."""
    pairs = buys(spark, d).select(F.col("l_orderkey").alias("request_id"), "consumer_id", "product_id").distinct()
    return pairs.withColumn("pos", F.row_number().over(W.partitionBy("request_id").orderBy("product_id")))
