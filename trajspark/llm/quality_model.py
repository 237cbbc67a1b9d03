"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A text's features are its words, the character n-grams of its words, and its pairs of adjacent words, hashed into one table of
vectors. Their mean goes through a linear layer and a softmax. As both steps are linear before the softmax, a trained
model needs one number a bucket to score: what its vector adds to the difference of the two outputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 1 << 17
DIM, EPOCHS, RATE = 10, 6, 0.5
#: The model is fitted on at most so many labelled rows of each class, those with the least hash of their id.
TRAIN_ROWS = 1_500
GRAMS = (3, 4)
#: Pairs of one word with itself share a bucket: no table of hashed words could know repetition of a new word otherwise.
SAME_PAIR = BUCKETS - 1
MEMO = 300_000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; and for each character n-gram of ``<word>``, its word's place and its bucket."""
    data = [f"<{w}>" for w in words]
    sizes = np.array([len(d) for d in data], np.int64)
    buf = np.frombuffer("".join(data).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(data)), sizes)
    owners, buckets = [], []
    for n in GRAMS:
        if len(buf) < n:
            continue
        h = np.full(len(buf) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h + buf[k : len(buf) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        owners.append(owner[: len(h)][inside])
        buckets.append((h[inside] >> np.uint64(20)) % np.uint64(BUCKETS - 1))
    whole = np.array([zlib.crc32(d.encode("utf-8", "surrogatepass")) for d in data], np.uint64)
    return whole, np.concatenate(owners or [np.empty(0, np.int64)]), np.concatenate(buckets or [np.empty(0, np.uint64)]).astype(np.int64)


def word_bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24)).astype(np.int64) % (BUCKETS - 1)


def pair_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.where(a == b, SAME_PAIR, ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)).astype(np.int64) % (BUCKETS - 1))


def text_features(text: str) -> np.ndarray:
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    known = list(dict.fromkeys(words))
    place = {w: i for i, w in enumerate(known)}
    ids = np.array([place[w] for w in words])
    whole, owner, grams = subwords(known)
    times = np.bincount(ids, minlength=len(known))
    h = whole[ids]
    return np.concatenate([word_bucket(h), np.repeat(grams, times[owner]), pair_bucket(h[:-1], h[1:])])


def train(texts: list[str], labels: list[int], *, seed: int = 5) -> np.ndarray:
    """One float32 for each bucket, and the bias last: a text's logit is the mean over its features, plus the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    sparse = []
    for t in texts:
        f, n = np.unique(text_features(t), return_counts=True)
        sparse.append((f, (n / max(n.sum(), 1)).astype(np.float32)))
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    weight = 0.5 / np.maximum(share, 1e-9)
    steps, step = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            f, part = sparse[i]
            rate = np.float32(RATE * (1 - step / steps) * weight[labels[i]])
            step += 1
            mean = part @ vectors[f]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            g = -p / p.sum()
            g[labels[i]] += 1
            grad = g @ out
            out += rate * np.outer(g, mean)
            bias += np.float32(0.1) * rate * g
            if len(f):
                # A mean over hundreds of features moves each by little; the rate makes up for it.
                vectors[f] += (20 * rate) * part[:, None] * grad
    return np.append(vectors @ (out[1] - out[0]), bias[1] - bias[0]).astype(np.float32)


class Scorer:
    """Scores texts; keeps what it knows of words up to a bound."""

    def __init__(self, model: np.ndarray):
        self.table, self.bias, self.place = model[:-1].astype(np.float64), float(model[-1]), {}
        self.arrays = [np.empty(0), np.empty(0), np.empty(0, np.uint64)]  # score, features and hash of each known word

    def __call__(self, texts: list[str]) -> np.ndarray:
        words = [t.split() for t in texts]
        if len(self.place) > MEMO:
            self.place, self.arrays = {}, [a[:0] for a in self.arrays]
        new = list(set().union(*words).difference(self.place))
        if new:
            whole, owner, grams = subwords(new)
            n = np.bincount(owner, minlength=len(new))
            s = np.bincount(owner, self.table[grams], minlength=len(new)) + self.table[word_bucket(whole)]
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.arrays = [np.concatenate(x) for x in zip(self.arrays, (s, n + 1.0, whole), strict=True)]
        score, count, whole = self.arrays
        get, out = self.place.__getitem__, np.zeros(len(texts))
        for i, w in enumerate(words):
            if w:
                ids = np.fromiter(map(get, w), np.int64, len(w))
                h = whole[ids]
                out[i] = (score[ids].sum() + self.table[pair_bucket(h[:-1], h[1:])].sum()) / (count[ids].sum() + len(w) - 1)
        return 1 / (1 + np.exp(-(out + self.bias)))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Train on labelled rows that are not held out, at most ``rows`` of each class. One executor trains; the driver gets the numbers.

    Rows with a null id or label count for nothing; of an id with several labels, the greatest counts; of one with several
    texts, the least. With no labelled row, or one class only, every text scores alike.
    """
    known = labels.where(~held_out(id_col)).where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    sample = known.where("_label = 0").orderBy(*order).limit(rows).unionByName(known.where("_label = 1").orderBy(*order).limit(rows))
    # The limits prove the bound of what is broadcast.
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"))

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((r["_id"], r["_text"], r["_label"]) for b in batches for r in b.to_pylist()), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), r[1]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([train([t for _, t, _ in found], [y for _, _, y in found]).tobytes()], pa.binary())], names=["model"])

    got = texts.repartition(1).mapInArrow(learn, "model binary").collect()
    return np.frombuffer(got[0].model, np.float32) if got else np.zeros(BUCKETS + 1, np.float32)


def score_documents(docs: DataFrame, model: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for each row, from the whole text, without a shuffle.

    Empty and null texts score by the bias alone. Repeated rows and null ids give a row each (a null id is not held out);
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model.tobytes())  # half a megabyte, whatever the data
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(np.frombuffer(held.value, np.float32))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score([t or "" for t in batch.column(1).to_pylist()]), pa.float64())], names=[batch.schema.names[0], "score"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
