"""Pairs of signatures without copies of signatures: every block is one row, and pairs of blocks meet as a product.

Tasks of a product read the partitions of both sides as they lie, so nothing is written but the blocks themselves, whatever
the number of pairs. A task holds one partition of bounded size and a few pairs of blocks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of signatures in one partition of a product, and how many tasks a core gets at least.
PART_BYTES = 32 << 20
TASKS_PER_CORE = 8
#: Numbers that a task holds at once when it measures pairs, and relative slack for rounding in products.
MEASURED = 1 << 21
SLACK = 1e-9
#: Squared distances below this share of the vectors' size are measured again entry by entry.
NEAR = 1e-2
RAGGED = "Signatures must have the same dimension"


def pack(points: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row per ``block`` of ``ord, name, signature, block``: ``block, ords, names, matrix, width`` in order of ``ord``,
    and what ``facts`` has of the block; dealt out for a product."""
    spark = points.sparkSession
    size = points.agg(F.sum(F.size("signature").cast("bigint"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    parts = max(math.ceil(math.sqrt(TASKS_PER_CORE * cores)), math.ceil(8 * size / PART_BYTES))
    rows = F.sort_array(F.collect_list(F.struct("ord", "name", "signature"))).alias("rows")
    widths = [F.min(F.size("signature")).alias("width"), F.max(F.size("signature")).alias("widest")]
    blocks = points.groupBy("block").agg(rows, *widths)
    width = F.when(F.col("width") == F.col("widest"), F.col("width")).otherwise(F.raise_error(F.concat(
        F.lit(f"{RAGGED}: "), F.col("width"), F.lit(", "), F.col("widest"))).cast("int"))
    packed = blocks.select("block", F.col("rows.ord").alias("ords"), F.col("rows.name").alias("names"),
                           F.flatten("rows.signature").alias("matrix"), width.alias("width"))
    return (packed if facts is None else packed.join(facts, "block")).repartition(parts)


def meet(blocks: DataFrame, condition: Column | None = None) -> DataFrame:
    """Pairs of packed blocks as structs ``low`` and ``high``; ``condition`` is on both. A product, never a broadcast, so
    that its tasks are many and hold one partition each."""
    low, high = (blocks.select(F.struct(*blocks.columns).alias(side)) for side in ("low", "high"))
    return low.join(high.hint("shuffle_replicate_nl"), F.lit(True) if condition is None else condition)


def matrices(values: pa.ListArray, widths: pa.Array) -> Iterator[np.ndarray]:
    """The signatures of every block of a batch, one row each."""
    flat, ends = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    for row, width in enumerate(widths.to_numpy(zero_copy_only=False)):
        yield flat[ends[row]:ends[row + 1]].reshape(-1 if width else 0, max(width, 1))


def same_width(a: np.ndarray, b: np.ndarray) -> None:
    if a.shape[1] != b.shape[1]:
        raise ValueError(f"{RAGGED}: {sorted({a.shape[1], b.shape[1]})}")


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared euclidean distances of all rows of ``a`` and ``b`` by a matrix product, and the size that rounding goes by."""
    size = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    return size - 2 * (a @ b.T), size


def measure(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean or manhattan distances of rows ``i`` of ``a`` from rows ``j`` of ``b``, entry by entry."""
    d, step = np.empty(len(i)), max(1, MEASURED // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        apart = a[i[s:s + step]] - b[j[s:s + step]]
        d[s:s + step] = np.abs(apart).sum(axis=1) if metric == "manhattan" else np.linalg.norm(apart, axis=1)
    return d


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d, size = squares(a, b)
    # also what overflows or is no number
    i, j = np.nonzero(~((d > NEAR * size) & np.isfinite(d)))
    d = np.sqrt(np.maximum(d, 0))
    d[i, j] = measure(a, b, i, j, "euclidean")
    return d


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.where(norms == 0, 1.0, 1 - a @ b.T / np.where(norms == 0, 1.0, norms))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([np.abs(b - v).sum(axis=1) for v in a])


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entry by entry for all pairs at once; what differs is counted in bytes, which hold 255 entries."""
    threshold = (a.mean(axis=1)[:, None] + b.mean(axis=1)) / 2
    apart, part = np.zeros(threshold.shape), np.zeros(threshold.shape, np.uint8)
    first, second = np.empty(threshold.shape, bool), np.empty(threshold.shape, bool)
    for k, (x, y) in enumerate(zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)), 1):
        np.not_equal(np.greater(x[:, None], threshold, out=first), np.greater(y, threshold, out=second), out=first)
        part += first.view(np.uint8)
        if k % 255 == 0 or k == a.shape[1]:
            apart += part
            part[:] = 0
    return apart / a.shape[1]


#: Distances of all rows of two matrices.
MEASURES = {"euclidean": _euclidean, "cosine": _cosine, "manhattan": _manhattan, "hamming": _hamming}


def measured(batches: Iterator[tuple[pa.Array, ...]], measure: Callable) -> Iterator[pa.ListArray]:
    """Of every pair of blocks an array of all distances, made when it is asked for: a batch of some hundred pairs becomes
    several times its own bytes."""
    for low, low_width, high, high_width in batches:
        for x, y in zip(matrices(low, low_width), matrices(high, high_width)):
            same_width(x, y)
            found = measure(x, y).ravel()
            yield pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))


SIDE = ("block", "ords", "names", "matrix", "width")


def _sides(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``row, low, high, x, y, i, j`` of every pair of blocks in a batch: both ids, matrices and lists of positions."""
    low, high = batch.column("low"), batch.column("high")
    names = low.field("block").to_pylist(), high.field("block").to_pylist()
    given = zip(matrices(low.field("matrix"), low.field("width")), matrices(high.field("matrix"), high.field("width")))
    for row, (x, y) in enumerate(given):
        same_width(x, y)
        i, j = (side.field("ords")[row].values.to_numpy() for side in (low, high))
        yield row, names[0][row], names[1][row], x, y, i, j


def _sent(met: DataFrame, *columns: str) -> DataFrame:
    return met.select(*[F.struct(*[F.col(f"{side}.{c}") for c in columns]).alias(side) for side in ("low", "high")])


def within(met: DataFrame, metric: str, limit: float) -> DataFrame:
    """``i, j, name_i, name_j, distance`` with ``i < j``: pairs up to ``limit``. Euclidean and manhattan ones are looked for
    by matrix products and measured again entry by entry, so rounding of the products never decides."""

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if metric not in ("euclidean", "manhattan"):
            d = MEASURES[metric](x, y)
            a, b = np.nonzero(d <= limit)
            return a, b, d[a, b]
        # a manhattan distance is at least the euclidean one
        d, size = squares(x, y)
        a, b = np.nonzero(~(d > limit * limit * (1 + SLACK) + SLACK * size))
        return a, b, measure(x, y, a, b, metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("low").field("names"), batch.column("high").field("names")
            for row, low, high, x, y, i, j in _sides(batch):
                a, b, d = near(x, y)
                keep = (d <= limit) & ((i[a] < j[b]) | (low != high))
                a, b, d = a[keep], b[keep], d[keep]
                first, second, turned = i[a], j[b], i[a] > j[b]
                left, right = names[0][row].values.take(pa.array(a)), names[1][row].values.take(pa.array(b))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(first, second)), pa.array(np.maximum(first, second)),
                     pc.if_else(pa.array(turned), right, left), pc.if_else(pa.array(turned), left, right), pa.array(d)],
                    ["i", "j", "name_i", "name_j", "distance"])

    return _sent(met, *SIDE).mapInArrow(run, "i bigint, j bigint, name_i string, name_j string, distance double")


class _Nearest:
    """The ``count`` nearest others of a block's members so far, ties to the smaller position."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, ords: np.ndarray, count: int):
        self.ords, self.count = ords.copy(), count
        self.distance = np.full((len(ords), count), np.inf)
        self.other = np.full((len(ords), count), self.NONE)

    def update(self, x: np.ndarray, y: np.ndarray, others: np.ndarray, d: np.ndarray, slack, metric: str) -> None:
        """``d``: distances, or squared ones off by ``slack``; infinite for a member itself."""
        exact = slack is None
        slack = 0.0 if exact else slack
        limit = self.distance[:, -1] if exact else self.distance[:, -1] ** 2 * (1 + SLACK)
        open_ = np.flatnonzero(np.isinf(limit))
        if len(open_) and d.shape[1] > self.count:
            limit = limit.copy()
            limit[open_] = np.partition((d + slack)[open_], self.count - 1, axis=1)[:, self.count - 1]
        a, b = np.nonzero(~(d - slack > limit[:, None]) & (d != np.inf))
        if len(a) == 0:
            return
        found = d[a, b] if exact else measure(x, y, a, b, metric)
        rows = np.unique(a)
        side = np.concatenate([np.repeat(rows, self.count), a])
        other = np.concatenate([self.other[rows].ravel(), others[b]])
        distance = np.concatenate([self.distance[rows].ravel(), found])
        order = np.lexsort((other, distance, side))
        ranked = side[order]
        begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        first = (begins[:, None] + np.arange(self.count)).ravel()
        self.other[rows] = other[order][first].reshape(-1, self.count)
        self.distance[rows] = distance[order][first].reshape(-1, self.count)


def nearest(met: DataFrame, metric: str, count: int) -> DataFrame:
    """``i, j, distance``: of every signature the ``count`` nearest others of those it meets in a task, ties to the smaller
    position; every pair of blocks is given once. A task keeps them for the members of its two partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for _, low, high, x, y, i, j in _sides(batch):
                if metric == "euclidean":
                    d, size = squares(x, y)
                    slack = size * SLACK
                else:
                    d, slack = MEASURES[metric](x, y), None
                if low == high:
                    np.fill_diagonal(d, np.inf)
                for block, ords in ((low, i), (high, j)):
                    if block not in best:
                        best[block] = _Nearest(ords, count)
                best[low].update(x, y, j, d, slack, metric)
                if low != high:
                    best[high].update(y, x, i, d.T, None if slack is None else slack.T, metric)
        for kept in best.values():
            row, place = np.nonzero(kept.other != kept.NONE)
            yield pa.RecordBatch.from_arrays([pa.array(kept.ords[row]), pa.array(kept.other[row, place]),
                                              pa.array(kept.distance[row, place])], ["i", "j", "distance"])

    return _sent(met, "block", "ords", "matrix", "width").mapInArrow(run, "i bigint, j bigint, distance double")
