"""Toxicity scores: logistic regression on hashed word n-grams and skip-grams, trained by FTRL-proximal.

Every coordinate has its own learning rate, and the L1 term keeps most weights at zero, so what is sent to the tasks is a
short list of weights. Training takes a bounded sample of labelled documents in one task; scoring is a narrow pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.llm import grams
from quillprint.session import ship_package

BITS = 18
#: Labelled documents to learn from, at most, for each of the two labels; those of smallest hash.
SAMPLE = 4000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 1.0
#: Weights that a task is sent at most: all coordinates.
BIAS = 1 << BITS


def _features(texts):
    """Runs of rows: ``first row, rows, row of each feature, bucket of each feature``: words, pairs and skip pairs."""
    for first, last, data, offsets in grams.pieces(texts):
        hashes, bounds = grams.words(data, offsets, grams.LETTERS)
        owner = np.repeat(np.arange(last - first), np.diff(bounds))
        rows, found = [owner], [grams.mix(hashes)]
        for width, made in ((2, grams.ngrams(hashes, 2)), (3, grams.skipgrams(hashes))):
            same = owner[:len(made)] == owner[width - 1:]
            rows.append(owner[:len(made)][same])
            found.append(made[same])
        yield first, last - first, np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for features that are present or absent."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        used = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -used / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = _sigmoid(w.sum()) - label
        root = np.sqrt(self.n[at])
        self.n[at] += slope * slope
        self.z[at] += slope - (np.sqrt(self.n[at]) - root) / self.alpha * w


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out(key: Column) -> Column:
    """Whether 5 divides crc32 of the key as text; a null key is the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights other than zero.

    A document labelled more than once counts once, with the larger label; null keys and labels other than 0 and 1 are
    left out. Without labels there are no weights, and every score is one half.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(
        F.max(label).alias("label"))
    # bounded: every task passes on its own first ones only
    first = [known.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(sample) for value in (0, 1)]
    chosen = first[0].union(first[1])
    met = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    rows = met.select(F.xxhash64("key").alias("h"), F.col("label").cast("int").alias("label"), "text")

    def describe(batches):
        for batch in batches:
            found = []
            for _, count, owner, buckets in _features(batch.column(2)):
                pairs = np.unique(owner * np.int64(1 << BITS) + buckets)
                ends = np.searchsorted(pairs, np.arange(1, count) << BITS)
                found.extend((x & ((1 << BITS) - 1)).astype(np.int32) for x in np.split(pairs, ends))
            ends = np.cumsum([0] + [len(x) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *found])))],
                ["h", "label", "buckets"])

    def fit(rows: pa.Table) -> pa.Table:
        model = Ftrl((1 << BITS) + 1)
        order = np.argsort(rows.column("h").to_numpy(), kind="stable")
        examples = [np.append(x.values.to_numpy(), BIAS) for x in rows.column("buckets")]
        answers = rows.column("label").to_pylist()
        for _ in range(epochs):
            for i in order:
                model.learn(examples[i], answers[i])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pa.table({"bucket": pa.array(at, pa.int64()), "weight": w[at]})

    described = rows.mapInArrow(describe, "h bigint, label int, buckets array<int>")
    fitted = described.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "bucket bigint, weight double").toArrow()
    return fitted.column("bucket").to_numpy(), fitted.column("weight").to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted``; input columns of these names go.

    A null text scores as an empty one: what the constant term says.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)
    names = [*docs.columns, "score", "predicted"]
    sent = spark.sparkContext.broadcast(model)

    def judge(batches):
        buckets, values = sent.value
        weights = np.zeros((1 << BITS) + 1, np.float64)
        weights[buckets] = values
        used = weights[:-1] != 0
        for batch in batches:
            total = np.full(batch.num_rows, weights[BIAS])
            for first, count, owner, found in _features(batch.column(at)):
                hit = used[found]
                pairs = np.unique(owner[hit] * np.int64(1 << BITS) + found[hit])
                total[first:first + count] += np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], count)
            p = _sigmoid(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names)

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(judge, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learned from the labels that are not held out."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
