"""Language identification: the family first, then one-versus-one linear support vector machines within it.

Features are the byte 2-, 3- and 4-grams of the whole text, lower-cased, with all but letters as one space, hashed to
2^15 places; a text's margin is the mean weight of its n-grams. Families of languages are fixed values below; a language
that is in none is a family of its own. The classifiers are fitted on a bounded sample, `per_language` rows of each
language by a hash of their ids (800 unless told otherwise); every row is predicted from its whole text.

Defined results: `und` and 0 for a null text or one without a letter, or where nothing could be learned; with one learned
language, that language and 1; rows whose doc_id is null are predicted but not learned from (held_out); rows without lang
are not learned from; repeated rows are predicted each; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestar.llm import blocks as B, store

# Languages by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy gd br",
    "turkic": "tr az kk uz ky tt",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn ur mr gu pa ne",
    "iranian": "fa ku ps tg",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

BITS = 15
ORDERS = (2, 3, 4)
SCALE = 30.0
_LOWER = np.full(256, 0x20, dtype=np.uint8)
_LOWER[97:123] = _LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the places of the n-grams that begin at each byte, -1 where one would leave its text; and where each text begins (and the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.empty(0, np.uint8)
    off = off - off[0]
    b = _LOWER[data]
    space = b == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first space of each run
    keep[off[:-1][off[:-1] < off[1:]]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    b, off = b[keep].astype(np.uint32), kept[off]
    out = []
    for order in ORDERS:
        code = b.copy()
        for i in range(1, order):
            code[: len(b) - i] = code[: len(b) - i] * np.uint32(257) + b[i:] if i < len(b) else 0
        at = ((code * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)).astype(np.int32)
        for i in range(1, order):
            last = off[1:] - i
            at[last[last >= off[:-1]]] = -1
        out.append(at)
    return out, off


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, shares) of each text."""
    by_order, off = grams(texts)
    for lo, hi in zip(off[:-1], off[1:], strict=True):
        at = np.concatenate([a[lo:hi] for a in by_order])
        place, n = np.unique(at[at >= 0], return_counts=True)
        yield place.astype(np.int32), (n * (SCALE / max(1, n.sum()))).astype(np.float32)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """A linear SVM by dual coordinate descent: weights and bias."""
    w, bias, alpha = np.zeros(1 << BITS, dtype=np.float32), 0.0, np.zeros(len(rows))
    norm = np.array([float(x @ x) + 1.0 for _, x in rows])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            wrong = sign[i] * (float(w[at] @ x) + bias) - 1
            new = min(max(alpha[i] - wrong / norm[i], 0.0), cost)
            if step := (new - alpha[i]) * sign[i]:
                w[at] += np.float32(step) * x
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


class Model:
    """classes: for each level a list of names; pairs: (level, a, b) of each column of weights, which is above 0 for a."""

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        langs = sorted({s[0] for s in samples})
        self.family = {x: FAMILY.get(x, x) for x in langs}
        self.levels = {"": sorted(set(self.family.values()))}
        for f in self.levels[""]:
            self.levels[f"in {f}"] = [x for x in langs if self.family[x] == f]
        self.pairs, weights, biases = [], [], []
        for level, names in self.levels.items():
            name = self.family.get if level == "" else lambda x: x
            for a, b in combinations(names, 2):
                mine = [s for s in samples if name(s[0]) in (a, b)]
                w, bias = fit_svm([s[1:] for s in mine], np.array([1.0 if name(s[0]) == a else -1.0 for s in mine]))
                self.pairs.append((level, a, b))
                weights.append(w)
                biases.append(bias)
        # the last row takes the n-grams that would leave their text
        self.weights = np.concatenate([np.array(weights, dtype=np.float32).T * np.float32(SCALE), np.zeros((1, len(weights)), np.float32)]) if weights else np.zeros(((1 << BITS) + 1, 0), np.float32)
        self.biases = np.array(biases)

    def margins(self, texts: pa.Array) -> np.ndarray:
        by_order, off = grams(texts)
        out, n = np.zeros((len(texts), len(self.pairs))), np.zeros(len(texts))
        full = np.nonzero(off[1:] > off[:-1])[0]
        if len(full):
            for at in by_order:
                n[full] += np.add.reduceat((at >= 0).astype(np.int64), off[full])
                for k in range(len(self.pairs)):
                    out[full, k] += np.add.reduceat(self.weights[:, k][at], off[full], dtype=np.float64)
        return out / np.maximum(n, 1)[:, None] + self.biases

    def best(self, level: str, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and score of the class of most votes, ties to the larger sum of margins."""
        names = self.levels[level]
        votes, least = np.zeros((len(margins), len(names))), np.ones((len(margins), len(names)))
        for k, (where, a, b) in enumerate(self.pairs):
            if where == level:
                m, i, j = margins[:, k], names.index(a), names.index(b)
                p = 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
                votes[:, i] += (m > 0) + 1e-3 * np.tanh(m)
                votes[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
                least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
        top = votes.argmax(axis=1)
        return top, least[np.arange(len(top)), top]

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
        if not self.levels[""] or not letters.any():
            return lang, score
        margins = self.margins(texts)
        top, sure = self.best("", margins)
        for i, family in enumerate(self.levels[""]):
            own = np.nonzero(letters & (top == i))[0]
            if len(own):
                within, sure_of = self.best(f"in {family}", margins[own])
                lang[own] = np.array(self.levels[f"in {family}"], dtype=object)[within]
                score[own] = sure[own] * sure_of
        return lang, score


@B.tidy
def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (lang, order, text): (lang, order, places, shares)."""
    for batch in batches:
        texts = batch.column(2)
        for at, rows in B.slices(texts):
            got = list(features(texts.slice(at, rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), pa.array([p.tobytes() for p, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=["lang", "order", "places", "shares"])


def out_of_training(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, per_language: int = 800, folds: int = 4, fold: int = 2) -> Model:
    """docs: doc_id, text, lang. Learns from rows out of the held-out fold; languages are few, their counts go to the driver."""
    usable = docs.where(~out_of_training(F.col("doc_id"), folds, fold) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in docs.where(~out_of_training(F.col("doc_id"), folds, fold) & F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([])
    # rows whose hash is under a limit that is met by somewhat more than the sample; the first of them are the sample
    span = float(1 << 62)
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.3 * per_language / n + 20 / n) * span)])
    order = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 2)
    drawn = usable.select("lang", order.alias("order"), "text").where(F.col("order") <= limits[F.col("lang")])
    rows = drawn.mapInArrow(extract, "lang string, order long, places binary, shares binary").collect()
    samples, had = [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r.lang, r.order, zlib.crc32(r.places))):
        if had[r.lang] < per_language:
            had[r.lang] += 1
            samples.append((r.lang, np.frombuffer(r.places, np.int32), np.frombuffer(r.shares, np.float32)))
    return Model(samples)


def predictor(model: Model, text: int, kept: list[int], names: list[str]):
    """For mapInArrow: the columns `kept`, then language and score of the column `text`; names are those of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in B.slices(batch.column(text)):
                part = batch.slice(at, rows)
                lang, score = model.predict(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(lang, pa.string()), pa.array(score)], names=names)

    return B.tidy(run)


def identify(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """docs: doc_id, text, lang. doc_id, held_out, lang_pred, score of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs, per_language)
    told = docs.select("doc_id", out_of_training(F.col("doc_id"), 4, 2).alias("held_out"), "text")
    return told.mapInArrow(predictor(model, 2, [0, 1], ["doc_id", "held_out", "lang_pred", "score"]), "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """The rows of docs, with all their columns, whose language can be told. Where no row teaches a language, those with a letter."""
    model = fit(docs.select("doc_id", "text", "lang"), per_language)
    if not model.levels[""]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    pred, score = store.free_name(docs, "_lang_pred"), store.free_name(docs, "_lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    told = docs.mapInArrow(predictor(model, docs.columns.index("text"), list(range(len(docs.columns))), schema.names), schema)
    return told.where(F.col(pred) != "und").drop(pred, score)


def op6(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
