"""Exact deduplication by content-defined chunk recipes, in DataFrame functions alone.

Texts are cut where their content says so, so equal texts get equal chunks. Each distinct chunk moves once, to have its
identifier verified; from then on documents are compared by their ordered lists of identifiers, however long they are.

Defined results: a null text counts as empty (a group like any other); a null doc_id is smaller than any other; of rows
with the same doc_id and text one stays; an empty table gives an empty result; other columns of the input are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower case for A-Z only; null is empty. Texts of ASCII alone go the shorter way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column, least: int = 512, most: int = 4096) -> Column:
    """From `least` characters on, a chunk ends at white space that follows one of a few characters, at `most` at the latest."""
    cut = rf"(?s).{{{least},{most - 2}}}?[bcdghkmpvy.!?;:][\x09-\x0D\x20]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def recipes(docs: DataFrame, row: Column) -> DataFrame:
    """row_id, doc_id, ids (of the chunks, in order), text_sha256."""
    text = normalised(F.col("text"))
    return docs.select(
        row.alias("row_id"), "doc_id", F.transform(chunks(text), identifier).alias("ids"), F.sha2(text, 256).alias("text_sha256")
    )


def ambiguous_ids(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk. The distinct chunks are compared in full; copies are merged before they move."""
    each = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    distinct = each.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    return distinct.groupBy("id").count().where("count > 1").select("id")


def exact_groups(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per row of docs: row_id (row, where docs has lasting numbers), doc_id, keep_id, group_size, kept, text_sha256."""
    told = store.table(recipes(docs, F.monotonically_increasing_id() if row is None else row), "recipes")
    doubtful = store.table(ambiguous_ids(docs), "ambiguous")
    affected = told.select("row_id", F.explode("ids").alias("id")).join(doubtful, "id", "left_semi").select("row_id").distinct().withColumn("doubt", F.lit(True))
    # A document with an ambiguous identifier is told apart by its whole text's digest as well.
    keyed = told.join(affected, "row_id", "left").select("row_id", "doc_id", "text_sha256", F.array_append("ids", F.when(F.col("doubt"), F.unhex("text_sha256")).otherwise(F.lit(b""))).alias("recipe"))
    best = F.max(F.struct("doc_id", "row_id"))
    groups = store.table(keyed.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1"), "copies")
    return keyed.join(groups, "recipe", "left").select(
        "row_id", "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row_id") == F.col("best.row_id"))).alias("kept"),
        "text_sha256",
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row = store.free_name(docs, "_row")
    docs = store.numbered(docs, row)
    dropped = exact_groups(docs, F.col(row)).where("NOT kept").select(F.col("row_id").alias(row))
    return docs.join(dropped, row, "left_anti").drop(row)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).drop("row_id")


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
