"""Scalar functions: text, JSON, numbers, contexts, sets and distances."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_FORMULA = re.compile(r"[\d\s.+\-*/()%]|rating|abs|sqrt|floor|ceil|round|least|greatest|,|pow|exp|ln")


def title_prefix(title: Column, length: int = 7) -> Column:
    """The first characters, or all for a negative length; a missing title is empty."""
    return F.coalesce(title if length < 0 else F.substring(title, 1, length), F.lit(""))


def truncated(text: Column, length: int) -> Column:
    return text if length < 0 else F.substring(text, 1, length)


def multisplit(text: Column) -> Column:
    """Distinct tokens between runs of other than letters, without the first: at least 5 long, with an upper-case initial."""
    tokens = F.split(text, "[^a-zA-Z]+")
    return F.array_distinct(F.filter(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: t.rlike("^[A-Z].{4,}")))


def multi(values: Column) -> Column:
    """Distinct values, without those that stand for none."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & ~v.isin("null", "--", "__")))


def json_field(json: Column, name: str) -> Column:
    return F.get_json_object(json, f"$['{name}']")


def timestamp_field(json: Column, name: str) -> Column:
    """Milliseconds as whole seconds."""
    return F.floor(json_field(json, name).try_cast("bigint") / 1000).cast("bigint")


def id_in_text(text: Column) -> Column:
    """The number behind the first colon."""
    return F.get(F.split(text, ":"), F.lit(1)).try_cast("bigint")


def number_or(text: Column, kind: str, other: int | float | None) -> Column:
    return F.coalesce(F.trim(text).try_cast(kind), F.lit(other).cast(kind))


def rating_of(formula: str | None) -> Column:
    """An arithmetic formula over `rating`, cut to a whole number from 0 to 100; unparsable ratings are null."""
    if formula and _FORMULA.sub("", formula):
        raise ValueError(f"no arithmetic over rating: {formula}")
    value = F.expr(re.sub(r"\brating\b", "try_cast(rating AS double)", formula or "rating"))
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), value.cast("int"))))


def daytime(ts: Column, hours: list[int], first: int = 1) -> Column:
    """first + index of the first limit that the hour does not exceed."""
    out = F.when(F.hour(ts) <= hours[0], F.lit(first))
    for i, h in enumerate(hours[1:], 1):
        out = out.when(F.hour(ts) <= h, F.lit(first + i))
    return out


def dayweekhour(ts: Column) -> Column:
    """1 to 12: a sixth of the day, 6 more at week-ends."""
    return (F.floor(F.hour(ts) / 4) + F.when(F.dayofweek(ts).isin(1, 7), 6).otherwise(0) + 1).cast("int")


def contexts(*each: Column) -> Column:
    """Always with 0, which stands for no context."""
    return F.array_distinct(F.array_compact(F.array(F.lit(0), *each)))


def normal_cdf(x: Column) -> Column:
    """Cumulative normal by a polynomial of five terms."""
    # Coefficients of the approximation 26.2.17 in Abramowitz and Stegun.
    b, p = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 0.2316419
    t = 1 / (1 + p * F.abs(x))
    poly = sum((c * F.pow(t, i + 1) for i, c in enumerate(b[1:], 1)), b[0] * t)
    upper = 1 - F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(x < 0, 1 - upper).otherwise(upper)


def jaccard(a: Column, b: Column, blend: float = 0.0) -> Column:
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + blend)


def cosine(a: Column, b: Column, blend: float = 0.0) -> Column:
    return F.size(F.array_intersect(a, b)) / (F.sqrt(F.size(F.array_distinct(a)) * F.size(F.array_distinct(b))) + blend)


def jaccard_distance(a: Column, b: Column) -> Column:
    return 1 - jaccard(a, b)


def run_time_distance(a: Column, b: Column) -> Column:
    return F.least(F.abs(a - b) / 90, F.lit(1.0))


def year_distance(a: Column, b: Column, now: int) -> Column:
    """Years apart, that count more the more recent the later one is."""
    age = now - F.greatest(a, b)
    weight = F.when(age <= 1, 5.0).when(age <= 5, 2.0).when(age <= 10, 1.5).otherwise(1.0)
    return F.least(F.abs(a - b) * weight / 50, F.lit(1.0))


def tag_list(tags: Column) -> Column:
    return F.filter(F.split(tags, ";"), lambda t: t != "")


def mean_and_std(df: DataFrame, value: str) -> DataFrame:
    """0 where there is nothing to take them of."""
    return df.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def tfidf_terms(docs: DataFrame, ngrams: int = 2, features: int = 5, least_df: int = 5) -> DataFrame:
    """docs: doc_id, text. (doc_id, term, tf, score) of each document's best terms, ties kept.

    Terms are runs, glued together, of the accepted tokens among the next `ngrams` ones: at least 4 letters, with an
    upper-case initial. Terms of fewer than least_df different texts count nothing, as does what all texts have.
    """
    tokens = F.transform(F.split("text", "[^a-zA-Z]+"), lambda t: F.when(t.rlike("^[A-Z].{3,}"), F.lower(t)))
    at = docs.select("doc_id", F.xxhash64("text").alias("h"), tokens.alias("t"))

    def run(t: Column, i: Column, n: int) -> Column:
        taken = F.filter(F.slice(t, i, F.lit(n)), lambda x: x.isNotNull())
        return F.when(F.get(t, i + n - 2).isNotNull(), F.concat_ws("", taken))

    occurrences = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.array(*[run(F.col("t"), i, n) for n in range(1, ngrams + 1)]))), lambda x: x.isNotNull())
    terms = at.select("doc_id", "h", F.explode(occurrences).alias("term")).groupBy("doc_id", "h", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count_distinct("h").alias("df"))
    total = docs.agg(F.count_distinct(F.xxhash64("text")).alias("n"))
    idf = df.where(F.col("df") >= least_df).crossJoin(F.broadcast(total)).select("term", F.log(F.col("n") / F.col("df")).alias("idf"))
    scored = terms.join(idf, "term").select("doc_id", "term", "tf", (F.col("tf") * F.col("idf")).alias("score")).where("score > 0")
    return scored.withColumn("_r", F.rank().over(W.partitionBy("doc_id").orderBy(F.desc("score")))).where(F.col("_r") <= features).drop("_r")
