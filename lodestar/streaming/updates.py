"""Models kept current by streams. Offsets and state are in the checkpoint, results in versions of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.plans import snapshots


def event_stream(spark: SparkSession, sf_dir: str, files: int = 8) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events*.parquet")


def keep_current(stream: DataFrame, path: str, mode: str = "complete", every: str | None = None):
    """A query that saves each result of the stream as the table's next version: once caught up and over, or every so often."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/offsets").trigger(**trigger)
    return writer.foreachBatch(lambda df, _: snapshots.save(df, path)).start()


def caught_up(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    path = f"{snapshots.shared_dir(spark)}/lodestar-streams/{label}-{uuid.uuid4().hex}"
    keep_current(stream, path).awaitTermination()
    return snapshots.load(spark, path)


def view_counts(spark: SparkSession, events: DataFrame) -> DataFrame:
    return caught_up(spark, events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "views")


def blocked_values(spark: SparkSession, events: DataFrame, windows: dict[str, int]) -> DataFrame:
    """(user_id, k, expiry): until when each value that a consumer met stays blocked, the latest of its events' ends."""
    window = F.create_map(*[F.lit(x) for kv in windows.items() for x in kv])[F.col("event_type")]
    each = events.where(F.col("event_type").isin(*windows)).select("user_id", F.get_json_object("props", "$.k").alias("k"), (F.unix_timestamp(F.col("ts").cast("timestamp")) + window).alias("expiry"))
    return caught_up(spark, each.groupBy("user_id", "k").agg(F.max("expiry").alias("expiry")), "blocked")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts in event-time windows; state of windows that no event can reach any more is dropped."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
