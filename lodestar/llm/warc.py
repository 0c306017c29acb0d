"""WARC archives: written by Spark's own text writer, read back by boundary-chain verification.

Writing (gzip files): a record is a header block, an empty line and the payload; the writer's line separator is the two empty lines
between records. So archives go to whatever store Spark writes to, and no task holds more than a record. Records with equal
payloads become one response and revisits of it.

Reading: tasks look for the magic line in each archive and emit, for each place it stands at, where the record would end if
one began there. Only the record at the file's start is known to be one; the others are those that the chain of ends from
there reaches. Pointers are doubled in each round, so a file of n records takes log2(n) rounds, and magic lines inside
payloads drop out, as nothing reachable ends just before them.

Defined results: null html is empty; repeated rows are records of their own; a null page_id is smaller than any other, and of
rows that tie on page_id one is the response; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestar.llm import store

MAGIC = b"WARC/1.0\r\n"
GAP = "\r\n\r\n"
RECORDS = 1000  # of a file, at most
HEX32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """160 bits are 8 groups of 5 hexadecimal digits, and each group is 4 digits to the base of 32."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), HEX32, RFC32)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """row_id, page_id, url, html, bytes, digest, refers_to (row_id of the response that a revisit stands for, else null)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = store.numbered(pages.select("page_id", "url", "html"), "row_id")
    told = pages.select("row_id", F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(html).cast("long").alias("bytes"), sha1_base32(html).alias("digest"))
    best = F.max(F.struct("page_id", "row_id")).alias("best")
    copies = told.where(F.col("bytes") >= least).groupBy("digest").agg(best, F.count("*").alias("n")).where("n > 1")
    copies = store.table(copies.select("digest", F.col("best.page_id").alias("best_page"), F.col("best.row_id").alias("best_row")), "responses")
    other = F.col("best_row").isNotNull() & (F.col("row_id") != F.col("best_row"))
    return told.join(copies, "digest", "left").select("row_id", "page_id", "url", "html", "bytes", "digest", F.when(other, F.col("best_row")).alias("refers_to"))


def _urn(row: Column) -> Column:
    return F.concat(F.lit("<urn:lodestar:"), row.cast("string"), F.lit(">"))


def as_text(recs: DataFrame) -> DataFrame:
    """value: each record up to the end of its payload. Revisits have no payload, but their response's digest."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    header = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("row_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    return recs.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    as_text(records(pages, least)).write.option("lineSep", GAP).option("maxRecordsPerFile", RECORDS).option("compression", "gzip").text(path)


HEADER = re.compile(rb"WARC/1\.0\r\n(?:[!-9;-~]+:[^\r\n]*\r\n)+\r\n")
CANDIDATE = "path string, at long, next long, head string, payload binary"


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (path, content): CANDIDATE for each magic line with a header that states a length, and one where the file ends, with -1 as its next."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            content = gzip.decompress(content)
            rows, at = [(path, len(content), -1, None, None)], content.find(MAGIC)
            while at >= 0:
                if m := HEADER.match(content, at):
                    head = m[0].decode("utf-8", "replace")
                    if length := re.search(r"(?im)^content-length: *(\d{1,18})\r$", head):
                        begin, end = m.end(), m.end() + int(length[1])
                        if content[end : end + 4] == GAP.encode():
                            rows.append((path, at, end + 4, head, content[begin:end]))
                at = content.find(MAGIC, at + 1)
            for i in range(0, len(rows), 100):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 100], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["path", "at", "next", "head", "payload"])


def reachable(found: DataFrame) -> DataFrame:
    """found: path, at, next. (path, at) of the records on each file's chain from its start, by pointer jumping."""
    jumps = found.select("path", "at", "next")
    reached = found.where("at = 0").select("path", "at")
    while True:
        # what is reached, and what one jump of the present length reaches from there
        further = reached.join(jumps, ["path", "at"]).select("path", F.col("next").alias("at"))
        onto = further.join(found.select("path", "at"), ["path", "at"], "left_semi")
        after = store.table(reached.unionByName(onto).distinct(), "reached")
        ahead = jumps.select("path", F.col("at").alias("from"), F.col("next").alias("at"))
        jumps = store.table(ahead.join(jumps, ["path", "at"]).select("path", F.col("from").alias("at"), "next"), "jumps")
        reached = after
        if not jumps.take(1):
            return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: path, at, type, id, page_id, refers_to, digest, payload. Fails where a file does not end with its chain's last record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    found = files.select("path", "content").mapInArrow(candidates, CANDIDATE)
    slim = store.table(found.select("path", "at", "next"), "candidates")
    chain = store.table(reachable(slim.where("next >= 0")), "chain")
    ends = slim.where("next >= 0").join(chain, ["path", "at"], "left_semi").groupBy("path").agg(F.max("next").alias("end"))
    whole = slim.where("next < 0 AND at > 0").join(ends, "path", "left")
    if broken := whole.where("end IS NULL OR end != at").select("path").take(1):
        raise ValueError(f"{broken[0].path} is no chain of whole records")
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)\r\n{name}: *([^\r\n]*)", 1), F.lit(""))
    row_of = lambda name: F.regexp_extract(field(name), r"lodestar:(\d+)", 1).try_cast("long")
    return found.where("next >= 0").join(chain, ["path", "at"], "left_semi").select("path", "at", field("WARC-Type").alias("type"), row_of("WARC-Record-ID").alias("id"), field("X-Page-ID").try_cast("long").alias("page_id"), row_of("WARC-Refers-To").alias("refers_to"), F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("digest"), "payload")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages and reads them back. Sizes and digests of responses are those of the payloads read; revisits have their response's."""
    path = store.new_path(spark, "warc")
    write(pages, path, least)
    back = store.table(read(spark, path).select("type", "id", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("bytes"), F.when(F.col("type") == "response", sha1_base32(F.col("payload"))).otherwise(F.col("digest")).alias("digest")), "records")
    stands = back.where("type = 'response'").select(F.col("id").alias("refers_to"), F.col("bytes").alias("r_bytes"), F.col("digest").alias("r_digest"), F.col("page_id").alias("r_page"))
    revisits = back.where("type = 'revisit'").join(stands.join(back.where("type = 'revisit'").select("refers_to").distinct(), "refers_to", "left_semi"), "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    one = back.where("type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    two = revisits.select("page_id", F.col("r_bytes").alias("payload_bytes"), F.col("r_digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("r_page").alias("refers_to"))
    return one.select(columns).unionByName(two.select(columns))


def op5(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
