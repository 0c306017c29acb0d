"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestar.llm import store


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (a, b): a task's links as stars, each node with the least node it is connected to there."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    tops = [top(x) for x in nodes]
    keep = np.array([x != y for x, y in zip(nodes, tops, strict=True)], dtype=bool)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, dtype=np.int64)[keep]), pa.array(np.array(tops, dtype=np.int64)[keep])], names=["u", "v"])


def are_stars(e: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    each = ends.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return not each.where("as_u > 1 OR as_u = 1 AND as_v = 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """edges: a, b (long). (node, label) of every node in them; label is the least node of its component.

    Tasks reduce their own links to stars. Then large-star and small-star steps alternate: links of a node go to the least
    node next to it, until only stars are left. parts: how many files tables are written in.
    """
    e = store.table(edges.select("a", "b").mapInArrow(contract, "u long, v long"), "star", parts)
    while not are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each larger neighbour gets a link to the least node around
        e = store.table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star", parts)
        # small star: each node and its smaller neighbours get a link to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        e = store.table(moved.distinct(), "star", parts)
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
