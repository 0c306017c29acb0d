"""Canonical tables and the attribute types that settings can name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PRODUCTS = "product_id BIGINT, public_product_id BIGINT, product_type INT"
PRODUCT_ATTRS = "product_id BIGINT, attr_idx INT, attr_name STRING, value STRING"
EVENTS = "event_name STRING, event_id BIGINT, consumer_id BIGINT, product_id BIGINT, ts_sec BIGINT, rating INT, product_id_2 BIGINT, cmp TINYINT"
CANDIDATES = "request_id BIGINT, pos INT, consumer_id BIGINT, product_id BIGINT"
SCORES = "request_id BIGINT, pos INT, product_id BIGINT, predictor_id INT, prediction DOUBLE, reliability DOUBLE"

#: Settings' type names and the types of the wide column.
ATTRIBUTE_TYPES = {
    "int": T.IntegerType(), "float": T.DoubleType(), "long": T.LongType(), "boolean": T.BooleanType(), "string": T.StringType(),
    "multi": T.ArrayType(T.StringType()), "multisplit": T.ArrayType(T.StringType()), "tfidf": T.ArrayType(T.StringType()),
}


def domain(types: str, names: str) -> T.StructType:
    """The schema that two `;` lists declare, such as `int;string:20` and `year;title`."""
    kinds, labels = types.split(";"), names.split(";")
    if len(kinds) != len(labels):
        raise ValueError("as many types as names are needed")
    return T.StructType([T.StructField(n, ATTRIBUTE_TYPES[k.split(":")[0]]) for k, n in zip(kinds, labels, strict=True)])


@dataclass(frozen=True)
class EventSpec:
    """An event type: its name, kind, rating formula and what of it is kept."""

    name: str
    kind: str = "buys"
    formula: str | None = None
    start_id: int = 0
    batch_size: int = 100_000
    keep_last: int | None = None
    keep_seconds: int | None = None
    meta: tuple[str, ...] = field(default=())
