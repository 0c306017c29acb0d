"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. Tasks hash each document's distinct n-grams and send them to the block (range of hashes) that owns them. A block counts
   each n-gram's documents and answers with the n-grams that more than one document holds: the others add to no overlap.
2. A document can only have a partner if enough of its n-grams are shared. Of these, ordered by rarity, the first few are
   its prefix: partners must have an n-gram of both prefixes in common. The entries of all prefixes are the candidate
   matrix, a column for each n-gram.
3. Documents with equal n-gram sets are one node. In each round nodes name the column leader with which they share most
   columns; named pairs are verified on the whole sets and linked ones join one component. Columns within one component
   need no more work. Then all pairs between components in the rest are taken, but those that cannot reach the overlap
   that their sizes ask for, and verified.

So no link between different components is lost, and a group of n near copies costs about n pairs.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; fewer than k words are one n-gram together; a null, empty
or blank text has no n-gram and no link; rows with the same doc_id are separate rows; an empty table gives an empty
result; columns other than doc_id and text are passed over. N-grams are 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm import blocks as B, store
from lodestar.llm.components import components

CHUNK = 1 << 20  # hashes
SENT = "block int, chunk long, meta binary, docs binary, hashes binary"
ANSWER = "chunk long, meta binary, docs binary, hashes binary, counts binary"
NODE = "row_id long, doc_id long, n int, digest binary, prefix int, tokens binary"


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    h, counts = B.word_hashes(texts)
    at, runs = 0, B.chain(h, k) if len(h) >= k else None
    for n in counts.tolist():
        if n >= k:
            yield np.unique(runs[at : at + n - k + 1])
        elif n:
            yield B.chain(h[at : at + n], n)
        else:
            yield h[:0]
        at += n


def send(k: int, blocks: int):
    """For mapInArrow over (doc_id, text): SENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk = TaskContext.get().partitionId(), 0
        doc_ids, sizes, digests, sets, seen, held = [], [], [], [], {}, 0

        def flush() -> pa.RecordBatch:
            name = task << 24 | chunk
            meta = pa.BufferOutputStream()
            with pa.ipc.new_stream(meta, pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.binary())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "n", "digest"]))
            h = np.concatenate([s for _, s in sets]) if sets else np.empty(0, np.uint64)
            d = np.repeat(np.array([i for i, _ in sets], dtype="<u2"), [len(s) for _, s in sets])
            b = B.block_of(h, blocks)
            order = np.argsort(b, kind="stable")
            h, d, b = h[order], d[order], b[order]
            home = name % blocks
            ids = np.unique(np.append(b, b.dtype.type(home)))
            lo, hi = np.searchsorted(b, ids, side="left"), np.searchsorted(b, ids, side="right")
            rows = [(int(i), name, meta.getvalue().to_pybytes() if i == home else None, d[x:y].tobytes(), B.pack7(h[x:y])) for i, x, y in zip(ids, lo, hi, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "chunk", "meta", "docs", "hashes"])

        for batch in batches:
            texts = batch.column(1)
            for at, rows in B.slices(texts):
                for doc, s in zip(batch.column(0).slice(at, rows).to_pylist(), shingle_sets(texts.slice(at, rows), k), strict=True):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    if digest and digest not in seen:  # equal sets in a chunk travel once
                        seen[digest] = True
                        sets.append((len(doc_ids), s))
                        held += len(s)
                    doc_ids.append(doc)
                    sizes.append(len(s))
                    digests.append(digest)
                    if held >= CHUNK or len(doc_ids) == 1 << 16:
                        yield flush()
                        chunk += 1
                        doc_ids, sizes, digests, sets, seen, held = [], [], [], [], {}, 0
        if doc_ids:
            yield flush()

    return B.tidy(run)


def by_key(batches: Iterator[pa.RecordBatch], key: int) -> dict[int, list[tuple]]:
    """Whole rows (as bytes and numbers) by the number in a column."""
    out = defaultdict(list)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out[row[key]].append(row)
    return out


@B.tidy
def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over SENT by block: ANSWER, with the n-grams that more than one document holds."""
    for rows in by_key(batches, 0).values():
        h = np.concatenate([B.unpack7(r[4]) for r in rows])
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        counts, at, out = counts[inverse], 0, []
        for r in rows:
            n = len(r[4]) // 7
            many = np.nonzero(counts[at : at + n] > 1)[0]
            if len(many) or r[2] is not None:
                full = h[at : at + n][many] | np.uint64(r[0] % 256 << 56)  # any byte of the block's number: equal n-grams have equal ones
                out.append((r[1], r[2], np.frombuffer(r[3], dtype="<u2")[many].tobytes(), full.tobytes(), counts[at : at + n][many].astype("<u4").tobytes()))
            at += n
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 256], strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "meta", "docs", "hashes", "counts"])


def gather(percent: int):
    """For mapInArrow over ANSWER by chunk: NODE. tokens (shared n-grams by rarity) is null where there can be no partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in by_key(batches, 0).items():
            meta = pa.ipc.open_stream(next(r[1] for r in rows if r[1] is not None)).read_all()
            n = meta.column("n").to_numpy()
            d, h, c = (np.concatenate([np.frombuffer(r[i], dtype=t) for r in rows]) for i, t in ((2, "<u2"), (3, "<u8"), (4, "<u4")))
            order = np.lexsort((h, c, d))
            d, h = d[order], h[order]
            lo, hi = np.searchsorted(d, np.arange(len(n)), side="left"), np.searchsorted(d, np.arange(len(n)), side="right")
            shared, need = hi - lo, (percent * n.astype(np.int64) + 99) // 100
            live = (shared >= need) & (n > 0) & (shared > 0)
            prefix = np.where(live, shared - need + 1, 0).astype(np.int32)
            tokens = [h[x:y].tobytes() if ok else None for x, y, ok in zip(lo, hi, live, strict=True)]
            row_id = (np.int64(chunk) << 16) + np.arange(len(n), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row_id), meta.column("doc_id").combine_chunks(), meta.column("n").combine_chunks(), meta.column("digest").combine_chunks(), pa.array(prefix), pa.array(tokens, pa.binary())], names=["row_id", "doc_id", "n", "digest", "prefix", "tokens"])

    return B.tidy(run)


@B.tidy
def prefix_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (row_id, n, prefix, tokens): (token, node, n, own, ahead). own: how many n-grams no other document has; ahead: how many shared ones there are from this one on."""
    for batch in batches:
        for node, n, prefix, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k = len(tokens) // 8
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens, dtype="<i8")[:prefix]), pa.array(np.full(prefix, node)), pa.array(np.full(prefix, n, dtype=np.int32)), pa.array(np.full(prefix, n - k, dtype=np.int32)), pa.array(np.arange(k, k - prefix, -1, dtype=np.int32))], names=["token", "node", "n", "own", "ahead"])


def verify(percent: int):
    """For mapInArrow over (a, b, n_a, n_b, tokens_a, tokens_b): the pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, n, m, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = len(np.intersect1d(np.frombuffer(s, dtype="<u8"), np.frombuffer(t, dtype="<u8"), assume_unique=True))
                if 100 * both >= percent * (n + m - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return B.tidy(run)


def linked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets are alike enough. b's set moves to a's, so a should be the one of many pairs."""
    side = lambda x: nodes.select(F.col("row_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")
    return both.mapInArrow(verify(percent), "a long, b long")


def links(nodes: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """nodes: row_id, n, prefix, tokens, all sets different. (node, label) of the nodes that link; label is the least node of the component."""
    entries = nodes.select("row_id", "n", "prefix", "tokens").mapInArrow(prefix_entries, "token long, node long, n int, own int, ahead int")
    shared = entries.groupBy("token").count().where("count > 1").select("token")
    entries = store.table(entries.join(shared, "token", "left_semi").withColumn("label", F.col("node")), "entries")
    total = entries.count()
    few, many = max(6, nodes.count() // 20_000), max(12, total // 200_000)  # parts of tables of nodes, of entries
    edges = None
    for i in range(rounds + 1):
        sizes = entries.groupBy("token", "label").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("own"))
        open_tokens = store.table(sizes.where("m * m > own"), "open", many)
        pairs_left = open_tokens.agg(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2)).first()[0] or 0
        if not pairs_left:
            break
        entries = entries.join(open_tokens.select("token"), "token", "left_semi")
        every = pairs_left <= max(total, 20_000) or i == rounds
        found = pairs_between(entries, percent) if every else pairs_to_leaders(entries, percent, i)
        found = store.table(linked(store.table(found, "pairs", few), nodes, percent), "links", few)
        edges = found if edges is None else edges.unionByName(found)
        labels = store.table(components(edges, few), "labels", few)
        if every:
            return labels
        entries = store.table(entries.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "entries", many)
    if edges is None:
        return nodes.select(F.col("row_id").alias("node"), F.col("row_id").alias("label")).limit(0)
    return labels


def reaches(percent: int, a: str, b: str) -> Column:
    """Whether the overlap that the sizes ask for can be had if this column is the first that both have: from here on, each must have as many shared n-grams."""
    n, ahead = lambda x: F.col(f"{x}.n"), lambda x: F.col(f"{x}.ahead")
    return F.least(ahead(a), ahead(b)) * (100 + percent) >= percent * (n(a) + n(b))


def pairs_to_leaders(entries: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each node with the leader that most of its columns have: at first the node with the fewest n-grams of its own, later any."""
    score = F.struct(-F.col("own").cast("double") / F.col("n"), "node") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "label").cast("double"), F.xxhash64(F.lit(turn), "node"))
    leaders = entries.groupBy("token").agg(F.max_by(F.struct("node", "label", "n", "ahead"), score).alias("lead")).select("token", "lead.*")
    named = entries.alias("b").join(leaders.alias("a"), (F.col("a.token") == F.col("b.token")) & (F.col("a.label") != F.col("b.label")) & reaches(percent, "a", "b"))
    named = named.groupBy(F.col("b.node").alias("b"), F.col("a.node").alias("a")).count()
    return named.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")


def pairs_between(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different components that have a column in common from which on the overlap that their sizes ask for can be had."""
    both = entries.alias("a").join(entries.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & reaches(percent, "a", "b"))
    return both.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_groups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs: doc_id, text. One row per row: row_id, doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    blocks = B.block_count(docs.select("text"))
    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(send(k, blocks), SENT)
    answers = sent.repartitionById(blocks, "block").mapInArrow(answer, ANSWER)
    nodes = store.table(answers.repartition(blocks, "chunk").mapInArrow(gather(percent), NODE), "nodes")
    # equal sets are one node, held by the least row that has its tokens
    live = nodes.where("tokens IS NOT NULL")
    first = live.groupBy("digest").agg(F.min("row_id").alias("row_id"))
    different = store.table(live.join(first.select("row_id"), "row_id", "left_semi").select("row_id", "digest", "n", "prefix", "tokens"), "different")
    labels = links(different, percent)
    classes = nodes.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    own = different.join(labels.withColumnRenamed("node", "row_id"), "row_id").select("digest", "label")
    classes = store.table(classes.join(own, "digest", "left").where("rows > 1 OR label IS NOT NULL"), "classes")
    least = classes.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("component_id"))
    classes = store.table(classes.join(least, "label", "left").select("digest", F.coalesce("component_id", "least").alias("component_id")), "classes")
    return nodes.select("row_id", "doc_id", "n", "digest").join(classes, "digest", "left").select("row_id", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def kept_rows(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs without all but the first row of each component."""
    row = store.free_name(docs, "_row")
    numbered = store.numbered(docs, row)
    told = near_groups(numbered.select(F.col(row).alias("doc_id"), "text"), k, percent)
    dropped = store.table(told.where("component_id != doc_id").select(F.col("doc_id").alias(row)), "dropped")
    return numbered.join(dropped, row, "left_anti").drop(row)


def op10(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")
