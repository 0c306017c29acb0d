"""Language-model scoring with a weighted backoff automaton over the counts of the whole corpus.

Model: bigrams over a smoothed unigram. p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), where the last share is any unseen word's;
p2(w | h) = (c(h w) + M p1(w)) / (c(h) + M). As an automaton: a state for each word that was read last (and one for a
text's start), an arc for each seen pair with the weight log10 p2, and a failure arc with the weight log10(M / (c(h) + M))
to the state without history, which has an arc of weight log10 p1 for each word. A text is read once from left to right:
in its state each word either has an arc, or takes the failure arc and the arc of the state without history; the weights
add up, and the state reached is carried on to the next word. All texts of a chunk are read in step, a word of each at a
time. Long texts are read in pieces of `PIECE` tokens, as the state that a piece starts in is known from the word before.

Tasks hash their chunk's words and pairs and send each distinct one with its training count to the block that owns its
hash; blocks add up and answer with the counts of the whole corpus. So a chunk's automaton holds exactly the arcs that its
own texts can take, with the weights of the corpus' model, and no task holds the model or all rows of a frequent word.

Defined results: a null, empty or blank text is its end token alone; rows whose doc_id is null are scored but not learned
from (held_out); repeated rows count each; with no training row every count is 0; an empty table gives an empty result;
columns other than doc_id and text are passed over. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestar.llm import blocks as B, store
from lodestar.llm.near_join import by_key

CHUNK = 3 << 20  # tokens
START, END = B.mix(np.array([1, 2], dtype=np.uint64))
SENT = "block int, chunk long, level int, hashes binary, counts binary"
CHUNKS = "chunk long, docs binary, stream binary, words binary"
ANSWER = "chunk long, block int, level int, counts binary, tokens long, types long"
ADD = 0.1
PIECE = 4096  # tokens


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of equal place side by side, compressed."""
    return np.array([len(a)], "<u8").tobytes() + pa.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), codec="zstd", asbytes=True)


def stretch(b: bytes, dtype: str) -> np.ndarray:
    n, wide = int(np.frombuffer(b[:8], "<u8")[0]), np.dtype(dtype).itemsize
    flat = pa.decompress(b[8:], n * wide, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(wide, n).T).view(dtype).ravel()


def is_held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == fold


def pair_hashes(words: np.ndarray, stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it in its text, or with the start."""
    h = words[stream]
    before = np.roll(h, 1)
    before[np.cumsum(sizes) - sizes] = START
    return B.mix(before * np.uint64(0x9FB21C651E98DF25) + h)


def read_chunks(folds: int):
    """For mapInArrow over (doc_id, text): CHUNKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chunk, ids, sizes, held, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, stream = np.unique(np.concatenate(held), return_inverse=True)
            docs = pa.BufferOutputStream()
            cols = [pa.array(ids, pa.int64()), pa.array(np.concatenate(sizes)), pa.array([is_held_out(i, folds, 0) for i in ids])]
            with pa.ipc.new_stream(docs, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("out", pa.bool_())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "out"]))
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | chunk]), pa.array([docs.getvalue().to_pybytes()]), pa.array([squeeze(stream.astype("<u4"))]), pa.array([words.astype("<u8").tobytes()])], names=["chunk", "docs", "stream", "words"])

        for batch in batches:
            texts = batch.column(1)
            for at, rows in B.slices(texts):
                h, counts = B.word_hashes(texts.slice(at, rows))
                ends = np.cumsum(counts)
                held.append(np.insert(h, ends, END))
                sizes.append(counts + 1)
                ids += batch.column(0).slice(at, rows).to_pylist()
                n += len(h) + rows
                if n >= CHUNK:
                    yield flush()
                    chunk, ids, sizes, held, n = chunk + 1, [], [], [], 0
        if ids:
            yield flush()

    return B.tidy(run)


def chunk_docs(b: bytes) -> pa.Table:
    return pa.ipc.open_stream(b).read_all()


def send(blocks: int):
    """For mapInArrow over CHUNKS: SENT. Level 1 are words, level 2 pairs; the counts are of training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs, stream, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, stream, words = chunk_docs(docs), stretch(stream, "<u4"), np.frombuffer(words, "<u8")
                sizes = docs.column("n").to_numpy()
                learn = np.repeat(~docs.column("out").to_numpy(zero_copy_only=False), sizes)
                pairs, index = np.unique(pair_hashes(words, stream, sizes), return_inverse=True)
                for level, keys, at in ((1, words, stream), (2, pairs, index)):
                    counts = np.bincount(at[learn], minlength=len(keys)).astype("<u4")
                    b = B.block_of(keys, blocks)  # sorted, as the keys are
                    ids = np.unique(b)
                    lo, hi = np.searchsorted(b, ids, side="left"), np.searchsorted(b, ids, side="right")
                    pack = B.pack7 if level == 1 else B.pack6
                    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), chunk)), pa.array(np.full(len(ids), level, dtype=np.int32)), pa.array([pack(keys[x:y]) for x, y in zip(lo, hi, strict=True)]), pa.array([counts[x:y].tobytes() for x, y in zip(lo, hi, strict=True)])], names=["block", "chunk", "level", "hashes", "counts"])

    return B.tidy(run)


@B.tidy
def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over SENT by block: ANSWER, the corpus' counts in the order in which the chunk sent its hashes."""
    for block, rows in by_key(batches, 0).items():
        for level, unpack in ((1, B.unpack7), (2, B.unpack6)):
            mine = [r for r in rows if r[2] == level]
            if not mine:
                continue
            hashes = [unpack(r[3]) for r in mine]
            keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            local = np.concatenate([np.frombuffer(r[4], "<u4") for r in mine])
            total = np.bincount(inverse, weights=local, minlength=len(keys)).astype("<u8")
            back, at = total[inverse], 0
            for i, (r, h) in enumerate(zip(mine, hashes, strict=True)):
                tokens, types = (int(total.sum()), int((total > 0).sum())) if level == 1 and i == 0 else (0, 0)
                yield pa.RecordBatch.from_arrays([pa.array([r[1]]), pa.array([block], pa.int32()), pa.array([level], pa.int32()), pa.array([squeeze(back[at : at + len(h)])]), pa.array([tokens]), pa.array([types])], names=["chunk", "block", "level", "counts", "tokens", "types"])
                at += len(h)


@dataclass
class Automaton:
    """States are numbers: 0 without history, i + 1 after the word i, and the last one for the start of a text."""

    arcs: np.ndarray  # state * number of words + word, sorted; a number that is no arc at the end
    arc_weights: np.ndarray
    failures: np.ndarray  # by state: the weight of the arc to state 0
    own: np.ndarray  # by word: the weight of its arc out of state 0
    after: np.ndarray  # by word: the state that its arcs lead to. Words never learned lead to state 0

    @classmethod
    def of_counts(cls, c1: np.ndarray, p1: np.ndarray, texts: float, state: np.ndarray, word: np.ndarray, c2: np.ndarray, strength: float) -> Automaton:
        """c1, p1 by word; texts: how many were learned from; (state, word, c2): the pairs, seen in training or not."""
        history = np.concatenate(([0.0], c1, [texts]))
        state, word, c2 = state[c2 > 0], word[c2 > 0], c2[c2 > 0]
        arcs = state * len(c1) + word
        order = np.argsort(arcs)
        weights = np.log10((c2 + strength * p1[word]) / (history[state] + strength))
        return cls(np.append(arcs[order], np.iinfo(np.int64).max), np.append(weights[order], 0.0), np.log10(strength / (history + strength)), np.log10(p1), np.where(c1 > 0, np.arange(1, len(c1) + 1), 0))

    def read(self, stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of weights of each text; stream holds all texts' words, one text after the other."""
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        place = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        length = np.minimum(sizes[text] - place, PIECE)
        begin = (np.cumsum(sizes) - sizes)[text] + place
        order = np.argsort(-length, kind="stable")
        text, length, begin, place = text[order], length[order], begin[order], place[order]
        state = np.where(place == 0, len(self.own) + 1, self.after[stream[begin - 1]])
        total = np.zeros(len(text))
        for step, live in enumerate(np.searchsorted(-length, -np.arange(length[0] if len(length) else 0))):
            word = stream[begin[:live] + step]
            arc = state[:live] * len(self.own) + word
            at = np.searchsorted(self.arcs, arc)
            total[:live] += np.where(self.arcs[at] == arc, self.arc_weights[at], self.failures[state[:live]] + self.own[word])
            state[:live] = self.after[word]
        return np.bincount(text, weights=total, minlength=len(sizes))


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def traverse(tokens: int, types: int, strength: float):
    """For mapInArrow over (chunk, block, level, counts, docs, stream, words) by chunk: SCORE."""
    space = tokens + ADD * (types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, 0).values():
            own = next(r for r in rows if r[4] is not None)
            docs, stream, words = chunk_docs(own[4]), stretch(own[5], "<u4"), np.frombuffer(own[6], "<u8")
            sizes = docs.column("n").to_numpy()
            first = np.cumsum(sizes) - sizes
            c1, c2 = (np.concatenate([stretch(r[3], "<u8") for r in sorted((r for r in rows if r[2] == level), key=lambda r: r[1])]).astype(np.float64) for level in (1, 2))
            _, at = np.unique(pair_hashes(words, stream, sizes), return_index=True)
            stream = stream.astype(np.int64)
            p1 = (c1 + ADD) / space
            state = stream[at - 1] + 1
            state[np.isin(at, first)] = len(words) + 1
            automaton = Automaton.of_counts(c1, p1, c1[np.searchsorted(words, END)], state, stream[at], c2, strength)
            n = docs.num_rows
            yield pa.RecordBatch.from_arrays([
                docs.column("doc_id").combine_chunks(), docs.column("out").combine_chunks(), pa.array(sizes),
                pa.array(np.add.reduceat((c1 > 0)[stream].astype(np.int64), first)), pa.array(np.full(n, tokens)),
                pa.array(np.add.reduceat(automaton.own[stream], first)), pa.array(automaton.read(stream, sizes)),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return B.tidy(run)


def score(docs: DataFrame, folds: int = 10, strength: float = 20.0) -> DataFrame:
    """docs: doc_id, text. SCORE for each row, learned from the rows with crc32(doc_id) mod folds other than 0."""
    blocks = B.block_count(docs.select("text"))
    chunks = store.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read_chunks(folds), CHUNKS), "chunks")
    answers = store.table(chunks.mapInArrow(send(blocks), SENT).repartitionById(blocks, "block").mapInArrow(answer, ANSWER), "counts")
    tokens, types = answers.agg(F.sum("tokens"), F.sum("types")).first()
    own = chunks.select("chunk", F.lit(-1).alias("block"), F.lit(0).alias("level"), F.lit(None).cast("binary").alias("counts"), "docs", "stream", "words")
    told = answers.select("chunk", "block", "level", "counts", *[F.lit(None).cast("binary").alias(c) for c in ("docs", "stream", "words")])
    return own.unionByName(told).repartition(blocks, "chunk").mapInArrow(traverse(tokens or 0, types or 0, strength), SCORE)


def op9(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
