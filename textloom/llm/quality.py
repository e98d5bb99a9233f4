"""Operator 9: a quality classifier with supervised subword embeddings.

Each text becomes the bag of its words and of the character n-grams (on bytes) within the running text, hashed into
BUCKETS rows of an embedding table; the document vector is their average, a linear layer and softmax give the class.
Embeddings and output layer are learned together by numpy stochastic gradient descent on the driver, over at most
SAMPLE labelled documents (a documented bound; the documents with the smallest hashes of their id, of each class), whose
features the executors count and pack, at about a byte for a feature on the way to the driver. As the output is linear in the average, a trained model is one score per bucket, and
scoring every whole text is a gather and a sum per document.

Defined results: null and empty texts have no features and score by the bias alone; labels that are null or belong to no
document are ignored; repeated rows are scored as given; without labels of both classes every score is the share of
label 1 among the labels there are (0.5 if none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import joined, load, mix64, release, slices, text_bytes, with_arrow_columns, word_hashes

BUCKETS, DIM, EPOCHS, RATE, SAMPLE, THRESHOLD = 1 << 16, 8, 8, 0.05, 3_000, 0.3
GRAMS = (2, 3, 4)
U64 = np.uint64
_GRAM = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0xC2B2AE3D27D4EB4F))


def features(texts: list[bytes], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words, word pairs and character n-grams, kind by kind, each with the offset at which each text begins."""
    shift = U64(64 - (buckets - 1).bit_length())
    words, offsets = word_hashes(texts)
    counts = np.diff(offsets)
    yield (words >> shift).astype(np.int32), offsets
    first = np.ones(len(words) + 1, bool)
    first[offsets] = False  # a pair needs a word before it in the same text
    pairs = mix64(words[:-1] * U64(3) + words[1:])[first[1:-1]] if len(words) > 1 else words[:0]
    yield (pairs >> shift).astype(np.int32), np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])
    buf, starts = joined(texts)
    codes, sizes = _GRAM[buf], np.diff(starts) - 1
    ends = np.zeros(len(buf), bool)
    ends[starts[1:] - 1] = True  # the newline after each text
    h = np.zeros(len(buf), np.uint64)
    crossing = np.zeros(len(buf), bool)
    for n in range(1, max(GRAMS) + 1):
        if len(buf) < n:
            return
        h = h[: len(buf) - n + 1] * U64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        crossing = crossing[: len(h)] | ends[n - 1 :]
        if n in GRAMS:
            yield ((h[~crossing] * U64(0xD6E8FEB86659FD93 + 2 * n)) >> shift).astype(np.int32), np.concatenate([[0], np.cumsum(np.maximum(sizes - n + 1, 0))])


def feature_counts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and how often each occurs."""
    for a, b in slices(texts):
        kinds = list(features(texts[a:b]))
        for i in range(b - a):
            yield np.unique(np.concatenate([bucket[at[i] : at[i + 1]] for bucket, at in kinds]), return_counts=True)


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """The features of a text as steps from bucket to bucket and counts, compressed byte plane by byte plane."""
    both = np.stack([np.diff(buckets, prepend=0), counts]).astype("<i4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of packed(), as integers of the fewest bytes that hold them."""
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    steps, counts = np.ascontiguousarray(planes.T).view("<i4").reshape(2, -1)
    small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return small(np.cumsum(steps)), small(counts)


class Model:
    """bucket_scores: what each feature adds to the logit of label 1; the bias beside it."""

    def __init__(self, bucket_scores: np.ndarray, bias: float):
        self.bucket_scores, self.bias = bucket_scores.astype(np.float64), float(bias)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The softmax share of label 1 for each text."""
        out = np.full(len(texts), self.bias)
        for a, b in slices(texts):
            total, n = np.zeros(b - a), np.zeros(b - a)
            for bucket, at in features(texts[a:b]):
                upto = np.concatenate([[0.0], np.cumsum(self.bucket_scores[bucket])])
                total += upto[at[1:]] - upto[at[:-1]]
                n += np.diff(at)
            out[a:b] += total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], prior: float | None = None, seed: int = 7) -> Model:
    """samples: (buckets, counts, label). Softmax over two classes, averaged embeddings, one document a step.

    prior: the share of label 1 where the model is used; that of the samples if not given."""
    labels = np.array([y for _, _, y in samples])
    prior = float(labels.mean()) if prior is None and len(labels) else prior
    if len(set(labels.tolist())) < 2:
        share = min(max(labels.mean() if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out = np.zeros((2, DIM))
    bias = np.zeros(2)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps, done = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            buckets, counts, y = samples[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = counts / float(max(counts.sum(), 1))
            mean = share @ table[buckets]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= weight[y] * rate
            into = p @ out
            out -= np.outer(p, mean)
            bias -= 0.1 * p
            table[buckets] -= np.minimum(share * len(buckets), 4.0)[:, None] * into
    # the classes were weighted alike; the prior goes back into the bias
    return Model(table @ (out[1] - out[0]), bias[1] - bias[0] + np.log(prior / (1 - prior)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold; the prior is that of all of them."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    known = known.filter(F.crc32(F.col("_id").cast("string")) % 5 != 0).distinct()
    prior = known.agg(F.avg("_y")).first()[0]
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_y", "_text")  # at most sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [packed(*m) for m in feature_counts(text_bytes(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "y", "features"])

    kind = labels.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, y int, features binary").orderBy("id", "y").limit(2 * sample).collect()
    model = train([(*unpacked(r.features), r.y) for r in got], prior)
    del got
    release()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (of label 1) and predicted; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        p = shared.value.scores(text_bytes(batch.column(text_col)))
        return [pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return with_arrow_columns(docs, make, {"score": "double", "predicted": "int"})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
