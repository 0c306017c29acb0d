"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Each document draws an exponential key, scaled by its quality weight. A source first takes all its documents as many
whole times as its target holds; what remains is filled in the order of the keys. Where in that order the target ends is
found by sums over 2048 ranges of the key's logarithm, 2048 within one of them and 2048 within that, each level a small
table. The logarithm of any double lies in them, so whatever the weights are, a range at the end is about a millionth of an
octave of keys wide, and only its documents are sorted. What is then still missing is brought nearest to nothing by one more
document, if one helps.

Defined results: a quality that is null, not a number or not above 0 puts a document behind all others of its source (its key
is infinite); an infinite one puts it first; a null or blank text has size 0 and is never taken; a null source is a source of its own, the last; ties
of keys go by doc_id and the text's hash, and rows alike in both are alike in the result's rows; an empty table gives an
empty result. Sources (one row each) are few beside documents: their order and weights are found in one small sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestar.llm import store

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 2048
LEVELS = 3
OCTAVES = 1100  # of a key, on either side of 1: -ln(u) is 2^-55 to 2^6, a quality any double


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shape_quality(chars: Column, size: Column) -> Column:
    """0.1 to 1: how near the mean word is to six characters. Stands in where documents have no quality score."""
    mean = F.coalesce(chars, F.lit(0)) / F.greatest(size, F.lit(1)) - 1
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), mean / 6, F.lit(6.0) / F.greatest(mean, F.lit(0.1))))


def targets(per_source: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """per_source: source, source_size. Adds target: weights times one level, held at `most` times the source's size.

    The level is the one at which all targets sum to `share` of all sizes: sources reach their limit in the order of
    limit / weight, so it follows from running sums in that order.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    src = per_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source, in that order, that does not reach its limit sets the level
    src = src.withColumn("level", F.first(F.when(F.col("weight") * F.col("level") <= F.col("limit"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return src.select("source", "source_size", F.coalesce(F.least("limit", F.col("weight") * F.col("level")), F.col("limit")).alias("target"))


def _where_full(sums: DataFrame, at: str) -> DataFrame:
    """sums: source, rest, at, size. The first range whose running sum exceeds rest, and what is left of rest before it."""
    so_far = W.partitionBy("source").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return sums.withColumn("upto", F.sum("size").over(so_far)).where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct(F.col(at), (F.col("rest") - F.col("upto") + F.col("size")).alias("left")), at).alias("f")).select("source", F.col(f"f.{at}").alias(f"end_{at}"), F.col("f.left").alias(f"left_{at}"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, quality: Column | None = None, seed: int = 7, row: Column | None = None) -> DataFrame:
    """docs: doc_id, text, source. One row per row: row_id (row, where docs has lasting numbers), doc_id, size, source_size, target, taken, copies (taken / size)."""
    size = sizes(F.col("text"))
    base = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row_id"), "doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~")).alias("source"), size.alias("size"),
        (shape_quality(F.length("text"), size) if quality is None else quality).alias("quality"),
        F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.xxhash64("text").alias("tie"),
    )
    u = (F.shiftrightunsigned("h", 11) + F.lit(0.5)) / F.lit(float(2**53))
    weighs = F.coalesce((F.col("quality") > 0) & ~F.isnan("quality"), F.lit(False))
    base = base.withColumn("key", F.when(weighs, -F.log(u) / F.when(weighs, F.col("quality"))).otherwise(F.lit(float("inf"))))
    octave = F.coalesce(F.log2(F.when(F.col("key") > 0, F.col("key"))), F.lit(-float(OCTAVES)))
    share_of = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (octave + OCTAVES) / (2 * OCTAVES)))
    fine = F.least((share_of * float(RANGES**LEVELS)).cast("long"), F.lit(RANGES**LEVELS - 1))
    base = store.table(base.select("row_id", "doc_id", "source", "size", "key", "tie", fine.alias("fine")), "sizes")
    digit = lambda level: (F.shiftright("fine", 11 * (LEVELS - level)) % RANGES).cast("int").alias(f"r{level}")
    base = base.select("*", *[digit(level) for level in range(1, LEVELS + 1)])

    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = per_source.withColumn("source", F.when(F.col("source") != "~", F.col("source")))
    src = targets(named, weights, share, most).withColumn("source", F.coalesce("source", F.lit("~")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    src = src.withColumn("epochs", whole.cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    src = store.table(src, "targets")

    at = src.select("source", "rest")
    for level in range(1, LEVELS + 1):
        above, r = [f"r{i}" for i in range(1, level)], f"r{level}"
        sums = base.groupBy("source", *above, r).agg(F.sum("size").alias("size")).join(at, ["source", *above])
        src = store.table(src.join(_where_full(sums, r), "source", "left"), f"ends{level}")
        at = src.select("source", *[F.col(f"end_r{i}").alias(f"r{i}") for i in range(1, level + 1)], F.col(f"left_{r}").alias("rest"))
    last = base.join(at, ["source", *[f"r{i}" for i in range(1, LEVELS + 1)]]).withColumn("upto", F.sum("size").over(W.partitionBy("source").orderBy("key", "doc_id", "tie", "row_id")))
    end = last.where(F.col("upto") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("upto", "key", "doc_id", "tie", "row_id")).alias("end"))
    src = store.table(src.join(end, "source", "left"), "last")

    r, end_r = F.struct(*[f"r{i}" for i in range(1, LEVELS + 1)]), F.struct(*[F.col(f"end_r{i}").alias(f"r{i}") for i in range(1, LEVELS + 1)])
    here, at = F.struct("key", "doc_id", "tie", "row_id"), F.struct("end.key", "end.doc_id", "end.tie", "end.row_id")
    drawn = F.when(F.col("rest") <= 0, False).when(r < end_r, True).when(r > end_r, False).otherwise(F.coalesce(here <= at, F.lit(False)))
    placed = base.join(src, "source").withColumn("drawn", drawn)
    missing = F.col(f"left_r{LEVELS}") - F.coalesce("end.upto", F.lit(0))
    near = F.abs(F.col("size") - missing)
    more = placed.where(~F.col("drawn") & (F.col("rest") > 0) & (near < missing)).groupBy("source").agg(F.min(F.struct(near.alias("near"), F.col("key"), F.col("doc_id"), F.col("tie"), F.col("row_id"))).alias("m"))
    src = store.table(src.join(more.select("source", F.col("m.row_id").alias("more_id")), "source", "left"), "more")
    placed = base.join(src, "source").withColumn("copies", F.col("epochs") + (drawn | F.col("row_id").eqNullSafe(F.col("more_id"))).cast("long"))
    return placed.select("row_id", "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    columns, row = docs.columns, store.free_name(docs, "_row")
    docs = store.numbered(docs, row)
    copies = store.free_name(docs, "_copies")
    taken = mix(docs, row=F.col(row)).where("copies > 0").select(F.col("row_id").alias(row), F.col("copies").cast("int").alias(copies))
    copy = store.free_name(docs, "_copy")
    return docs.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*[f"`{c}`" for c in columns])


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
