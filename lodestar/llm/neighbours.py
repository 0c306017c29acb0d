"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes by rotations that are learned (iterative quantisation) on a bounded sample, `sample` rows by a hash
of their ids. Codes are split into bytes. By the pigeonhole principle a code within Hamming radius r of a query has a byte
within its own small radius of the query's (the radii of all bytes add up to r - bytes + 1), so probing the bytes retrieves
every code within r; those are reranked by their vectors. There are no lists of rows by byte value: each query tests the
bytes of all codes. Queries and rows meet in the cells of a grid, of bounded numbers of both. Queries that find too few rows search again, with everything in reach.

The radius is the one within which `reach` of the sample's true neighbours lie; among all rows neighbours are nearer.
Largest inner products become nearest neighbours by one more component, the same length for all rows.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part, nor does a null vec_id; rows with the same vec_id are rows of their own, each asks and is a candidate of the others;
ties go to the smaller vec_id; components of any type but float are read as doubles; a query without candidates has no row; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from lodestar.llm import store

BYTES = 32
ROWS, QUERIES = 8192, 1024  # of a cell


class Codes:
    def __init__(self, x: np.ndarray, longest: float, rounds: int = 15) -> None:
        self.longest = max(longest, 1e-30)
        x = self.lifted(x)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        rng, dims = np.random.default_rng(0), x.shape[1]
        turns = []
        while sum(t.shape[1] for t in turns) < 8 * BYTES:
            r = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
            for _ in range(rounds):  # iterative quantisation: the rotation that brings the vectors nearest to their own signs
                u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
                r = (u @ v).T
            turns.append(r)
        self.turn = np.concatenate(turns, axis=1)[:, : 8 * BYTES].astype(np.float64)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64) / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((self.lifted(x) - self.mean) @ self.turn > 0, axis=1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        """A query's length does not matter, and it has no part in the additional component."""
        x = x.astype(np.float64)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.packbits((np.concatenate([x, np.zeros((len(x), 1))], axis=1) - self.mean) @ self.turn > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=-1, dtype=np.int64)


def radius_for(codes: Codes, x: np.ndarray, reach: float, k: int) -> int:
    """The least radius that holds `reach` of the k nearest of some of the rows of x."""
    q = np.arange(0, len(x), max(1, len(x) // 300))
    s = x[q].astype(np.float64) @ x.T.astype(np.float64)
    s[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    rows, own = codes.rows(x), codes.queries(x[q])
    far = np.concatenate([hamming(rows[n], own[i : i + 1]) for i, n in enumerate(near)]) if near.size else np.array([8 * BYTES])
    return int(np.quantile(far, reach, method="higher"))


def encode(codes: Codes, dtype: type):
    """For mapInArrow over (vec_id, v): vec_id, v (as bytes of dtype), code, ask (as a query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten(), dtype=dtype).reshape(b.num_rows, -1)
                cols = [b.column(0), *(pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, codes.rows(x), codes.queries(x)))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "code", "ask"])

    return run


def stacked(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


FOUND = "query_row long, query_id long, vec_id long, score double"


def probe(radius: int, k: int, dtype: type):
    """For applyInArrow over the cells: FOUND, the k best within the radius of each query of a cell."""
    # bytes' radii add up to radius - BYTES + 1; those under 0 are never probed
    spare = max(radius - BYTES + 1, 0)
    own = [spare // BYTES + (j < spare % BYTES) for j in range(BYTES)] if radius >= BYTES else [0 if j <= radius else -1 for j in range(BYTES)]
    bits = np.bitwise_count(np.arange(256, dtype=np.uint8))
    tables = [bits <= r for r in own]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if rows.num_rows and queries.num_rows:
            row, ids, x, code = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), stacked(rows.column("v"), dtype).astype(np.float64), stacked(rows.column("code"), np.uint8)
            by_byte = np.ascontiguousarray(code.T)
            q, ask = stacked(queries.column("v"), dtype).astype(np.float64), stacked(queries.column("ask"), np.uint8)
            for i, (own_row, query) in enumerate(zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), strict=True)):
                hit = np.zeros(len(ids), dtype=bool)
                for j, table in enumerate(tables):
                    hit |= table[by_byte[j] ^ ask[i, j]]
                at = np.nonzero(hit)[0]
                at = at[(hamming(code[at], ask[i : i + 1]) <= radius) & (row[at] != own_row)]
                if len(at):
                    score = (x[at] * q[i]).sum(axis=1)
                    best = np.lexsort((ids[at], -score))[:k]
                    out[0] += [own_row] * len(best)
                    out[1] += [query] * len(best)
                    out[2] += ids[at][best].tolist()
                    out[3] += score[best].tolist()
        return pa.table([*(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.float64())], names=["query_row", "query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, n: int, queries: DataFrame, asked: int, radius: int, k: int, dtype: type) -> DataFrame:
    """index: row, vec_id, v, code; queries: row, vec_id, v, ask. FOUND with rank, the k best of all cells."""
    across, down = max(1, -(-n // ROWS)), max(1, -(-asked // QUERIES))
    place = lambda seed, cells: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(cells)).cast("int")
    rows = index.select("row", "vec_id", "v", "code", place(1, across).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"))
    asks = queries.select("row", "vec_id", "v", "ask", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), place(2, down).alias("y"))
    found = rows.groupBy("x", "y").cogroup(asks.groupBy("x", "y")).applyInArrow(probe(radius, k, dtype), FOUND)
    order = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, k: int = 20, sample: int = 8192, reach: float = 0.97) -> DataFrame:
    """vectors: vec_id, embedding; is_query: a condition on vec_id. query_id, rank, vec_id, score."""
    # vectors of floats are kept so, which is exact; of any other type as doubles
    float32 = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    dtype = np.float32 if float32 else np.float64
    v = F.transform("embedding", lambda x: x.cast("float" if float32 else "double"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    sizes = usable.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.sum(is_query.cast("long")).alias("asked"))
    most = sizes.orderBy(F.desc("n"), "dims").first()
    if most is None:
        return usable.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    usable = usable.where(F.size("v") == most.dims)
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    x = np.array([r.v for r in drawn], dtype=dtype)
    codes = Codes(x, most.longest)
    radius = radius_for(codes, x, reach, k)
    coded = usable.mapInArrow(encode(codes, dtype), "vec_id long, v binary, code binary, ask binary")
    index = store.table(coded.withColumn("row", F.monotonically_increasing_id()), "codes")
    queries = index.where(is_query)
    first = store.table(search(index, most.n, queries, most.asked or 0, radius, k, dtype), "nearest")
    # found fewer than there are: everything is within reach the second time
    short = store.table(queries.join(first.groupBy("query_row").count().where(F.col("count") >= min(k, most.n - 1)), F.col("row") == F.col("query_row"), "left_anti"), "short")
    if left := short.count():
        second = search(index, most.n, short, left, 8 * BYTES, k, dtype)
        first = first.join(short.select(F.col("row").alias("query_row")), "query_row", "left_anti").unionByName(second)
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
