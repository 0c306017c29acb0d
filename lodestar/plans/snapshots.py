"""Versions of model tables: a version is written whole, then a pointer to it appears in one step.

Pointers are numbered files that are never overwritten, so a reader finds either the version before or the one after, and
a writer that dies leaves the last version in place. A pointer also keeps what its model has read so far (the last event's
id and time), so that reading goes on from there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir. A local one only where all runs in one process; on a cluster each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = of_context.get() if of_context.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, path) of the pointers there are, the latest last."""
    fs, at = _fs(spark, f"{path}/pointers")
    if not fs.exists(at):
        return []
    names = [f.getPath() for f in fs.listStatus(at)]
    return sorted((int(p.getName()), p.toString()) for p in names if p.getName().isdigit())


def _read(spark: SparkSession, pointer: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(pointer).collect()))


def save(df: DataFrame, path: str, read_up_to: dict | None = None, keep: int = 2) -> str:
    """Writes a new version and points to it; read_up_to goes with it. Versions before the last `keep` are removed."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    fs, draft = _fs(spark, f"{path}/draft-{version}")
    out = fs.create(draft, True)
    out.write(json.dumps({"version": version, "read_up_to": read_up_to or {}}).encode())
    out.close()
    fs.mkdirs(_fs(spark, f"{path}/pointers")[1])
    earlier = _pointers(spark, path)
    number, placed = earlier[-1][0] + 1 if earlier else 0, False
    while not placed:
        pointer = _fs(spark, f"{path}/pointers/{number:020d}")[1]
        taken = fs.exists(pointer)  # by another writer
        placed = not taken and fs.rename(draft, pointer)
        if not placed and not taken and not fs.exists(pointer):
            raise OSError(f"no pointer can be written in {path}")
        number += 1
    for _, pointer in earlier[: max(0, len(earlier) + 1 - keep)]:
        fs.delete(_fs(spark, f"{path}/{_read(spark, pointer)['version']}")[1], True)
        fs.delete(_fs(spark, pointer)[1], False)
    return version


def current(spark: SparkSession, path: str) -> dict:
    """The latest pointer: version and read_up_to."""
    pointers = _pointers(spark, path)
    if not pointers:
        raise FileNotFoundError(f"no version in {path}")
    return _read(spark, pointers[-1][1])


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{current(spark, path)['version']}")
