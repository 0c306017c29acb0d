"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents of more tokens than the capacity are cut so that all pieces but the first are full. Pieces then fill gaps in
bulk: a sweep goes through the piece lengths from the longest, and each length's pieces go, in the order of their ranks,
to the smallest gaps that hold them (the successor of the length among the gaps); the filled gaps shrink and take part
again. Pieces that find no gap open new sequences. Lengths and gaps are whole numbers up to the capacity, so pieces and
gaps, sorted, are runs of equals: a sweep is worked out on the runs (their number is bounded by the capacity, whatever
the input), and each task finds its own pieces' places from their ranks. Ranks come from counts by task and length, so no
task ever holds all pieces of a length.

Defined results: a null or empty text is its end token alone; repeated rows are packed each; an empty table gives an
empty result; columns other than doc_id and text are passed over; an added token of the tokenizer's file, written out in a
text, is that token.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestar.llm import blocks as B, store

END = 2


class ByteBpe:
    """Ids of a byte-level BPE in the JSON format of the `tokenizers` library.

    The file's vocabulary lists tokens in the order of their merges, so it can drive tiktoken's encoder, which gives the
    same ids (tests hold them against `tokenizers`) for a fifth of the CPU time. As in the library, the file's added tokens
    are found in texts unless encode_special_tokens says that they are text like any other.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocabulary, added = told["model"]["vocab"], {t["content"]: t["id"] for t in told["added_tokens"]}
        if strange := [t["content"] for t in told["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]:
            raise ValueError(f"added tokens that depend on what is around them: {strange}")
        # the format writes a byte as the character of that number if it is printable, else as one from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if t not in added}
        core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)._core_bpe
        self.encode = core.encode_ordinary if encode_special_tokens else lambda text: core.encode(text, set(added))

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit numbers."""
        return [np.array(self.encode(t), dtype="<u4").tobytes() for t in texts]


_tokens: dict[str, ByteBpe] = {}


def tokens_of(path: str) -> ByteBpe:
    if path not in _tokens:
        _tokens[path] = ByteBpe(path, encode_special_tokens=False)
    return _tokens[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def cut_into_pieces(path: str, capacity: int):
    """For mapInArrow over (doc_id, text): PIECES, where place counts the pieces of that length in that task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = tokens_of(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(docs), 256):
                rows = []
                part = [x or "" for x in texts.slice(at, 256).to_pylist()]
                for doc, ids in zip(docs[at : at + 256], tok.ids(part), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    start, size, piece = 0, first, 0
                    while start < n:
                        rows.append((doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), task, int(seen[size])))
                        seen[size] += 1
                        start, size, piece = start + size, capacity, piece + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return B.tidy(run)


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) of runs: pieces of successive ranks, in successive sequences, at one offset."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    sizes: list[int] = []  # the gaps there are, sorted
    runs, made = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                gap = sizes[i]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(i)
            else:
                gap, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            # each of these sequences takes as many as it holds, one to each in turn
            offset, used = capacity - gap, n
            for _ in range(gap // length):
                if not left:
                    break
                k = min(left, n)
                runs.append((length, rank, k, first, offset))
                leave(gap, first + k, used - k)
                rank, left, offset, gap, used = rank + k, left - k, offset + length, gap - length, k
            leave(gap, first, used)
    return runs


def place(runs: list[tuple[int, int, int, int, int]]):
    """For mapInArrow over (doc_id, piece, start, length, ids_crc32, rank): sequence_id and offset in place of rank."""
    by_length: dict[int, np.ndarray] = {}
    for r in runs:
        by_length.setdefault(r[0], []).append(r[1:])
    by_length = {k: np.array(sorted(v), dtype=np.int64) for k, v in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for size in np.unique(length):
                at = np.nonzero(length == size)[0]
                table = by_length[int(size)]
                k = np.searchsorted(table[:, 0], rank[at], side="right") - 1
                seq[at], off[at] = table[k, 2] + rank[at] - table[k, 0], table[k, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return B.tidy(run)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """docs: doc_id, text. doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    pieces = store.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_into_pieces(tokenizer, capacity), PIECES), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    counts = store.table(counts.withColumn("before", F.coalesce(before, F.lit(0))), "ranks")
    # at most `capacity` rows, whatever the input
    runs = best_fit_runs({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    ranked = pieces.join(counts.drop("n"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
