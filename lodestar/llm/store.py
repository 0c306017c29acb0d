"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.plans.snapshots import shared_dir

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/lodestar/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """df written as Parquet, in so many parts if told, and read again. It stays until it is released or the session's process ends: results are lazy and may read it at any time."""
    spark = df.sparkSession
    df = df if parts is None else df.coalesce(parts)
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables (as `table` returned them) that no lazy result reads any more, and lets Spark remove the shuffle files of what has run."""
    for t in tables:
        drop(t.sparkSession, t._lodestar_path)
        _written.remove((t.sparkSession, t._lodestar_path))
    if tables:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what has run: they go when their plans are collected, else by spark.cleaner.periodicGC.interval."""
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores in front as many as no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row in the column `name`, written once: numbers that are made anew by each scan follow how it happens to split its files."""
    return table(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # the JVM may be gone by now
            return
