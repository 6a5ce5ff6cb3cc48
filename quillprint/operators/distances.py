"""Pairwise distances and similarities of signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillprint.functions import vectors
from quillprint.operators import blocks, pivots
from quillprint.operators.ordering import number_blocks
from quillprint.session import ship_package

BLOCK_ROWS = 256
#: Positions of one stretch, within which a task ranks them.
RANK_ROWS = 65_536


def compare_pairs(pairs: DataFrame, left: str, right: str, distances: list[str] | None = None,
                  similarities: list[str] | None = None) -> DataFrame:
    """Distances and similarities of two signature columns, row by row."""
    a, b = F.col(left), F.col(right)
    columns = [vectors.distance(a, b, m).alias(f"{m}_distance") for m in distances or []]
    columns += [vectors.similarity(a, b, m).alias(f"{m}_similarity") for m in similarities or []]
    return pairs.select("*", *columns)


def all_pairs(signatures: DataFrame, metric: str = "euclidean", block_rows: int = BLOCK_ROWS,
              key: str = "model_name", order: str = "ord", within: float | None = None) -> DataFrame:
    """Distance of every pair with ``i < j``: ``i, j, name_i, name_j, distance``.

    Positions may have gaps; they are ranked first. Signatures go into blocks of ``block_rows`` neighbouring ranks, one row
    each, and pairs of blocks meet as a product (:mod:`quillprint.operators.blocks`): no signature is copied through the
    disk, whatever n is. All pairs are n(n-1)/2 rows; ``within`` keeps only those up to a distance, before they leave the
    task.
    """
    met = blocks.meet(_ranked_blocks(signatures, metric, block_rows, key, order), F.col("low.block") <= F.col("high.block"))
    if within is not None:
        return blocks.within(met, metric, within)
    pairs = _measured(met, metric).where((F.col("low.block") < F.col("high.block")) | (F.col("a") < F.col("b")))
    return pairs.select(F.col("low.ords")[F.col("a")].alias("i"), F.col("high.ords")[F.col("b")].alias("j"),
                        F.col("low.names")[F.col("a")].alias("name_i"), F.col("high.names")[F.col("b")].alias("name_j"),
                        "distance")


def _ranked_blocks(signatures: DataFrame, metric: str, block_rows: int, key: str, order: str) -> DataFrame:
    """Packed blocks of neighbouring ranks."""
    if metric not in blocks.MEASURES:
        raise ValueError(f"Unknown distance metric: {metric}. Known: {', '.join(blocks.MEASURES)}")
    ship_package(signatures.sparkSession)
    stretch = _given(signatures, key, order).withColumn("_stretch", F.floor(F.col("ord") / RANK_ROWS))
    ranked = number_blocks(stretch, ["_stretch"], ["ord"], "_place")
    return blocks.pack(ranked.select("ord", "name", "signature", F.floor(F.col("_place") / block_rows).alias("block")))


def _measured(met: DataFrame, metric: str) -> DataFrame:
    """``low, high, a, b, distance``: every pair of places within pairs of blocks. Distances come from the worker as one
    array per pair of blocks, and each array leaves it before the next is made; rows are made from it where they are used."""
    measure = blocks.MEASURES[metric]

    @F.arrow_udf("array<double>")
    def distances(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from blocks.measured(batches, measure)

    values = distances("low.matrix", "low.width", "high.matrix", "high.width")
    flat = met.select("low", "high", F.posexplode(values).alias("place", "distance"))
    across = F.size("high.ords")
    return flat.select("low", "high", F.floor(F.col("place") / across).cast("int").alias("a"),
                       (F.col("place") % across).alias("b"), "distance")


def _given(signatures: DataFrame, key: str = "model_name", order: str = "ord", **_) -> DataFrame:
    return signatures.select(F.col(order).cast("bigint").alias("ord"), F.col(key).cast("string").alias("name"),
                             F.col("signature").cast("array<double>").alias("signature"))


def pairs_within(signatures: DataFrame, limit: float, metric: str = "euclidean", **options) -> DataFrame:
    """Pairs at most ``limit`` apart: ``i, j, name_i, name_j, distance`` with ``i < j``.

    For metrics with a triangle inequality pairs of blocks that are too far apart are ruled out before signatures are copied
    (:mod:`quillprint.operators.pivots`); for the others all pairs of blocks are compared.
    """
    if metric in pivots.METRICS:
        return pivots.pairs_within(_given(signatures, **options), limit, metric, options.get("block_rows", BLOCK_ROWS))
    return all_pairs(signatures, metric, within=limit, **options)


def nearest_models(signatures: DataFrame, count: int, metric: str = "euclidean", block_rows: int = BLOCK_ROWS,
                   key: str = "model_name", order: str = "ord") -> DataFrame:
    """The ``count`` nearest other signatures of each: ``i, name_i, rank, j, name_j, distance``, ties to the smaller
    position. Every task passes on ``count`` rows per signature at most, and blocks that cannot hold a nearest one are ruled
    out as in :func:`pairs_within`."""
    given = _given(signatures, key, order)
    if metric in pivots.METRICS:
        found = pivots.nearest_pairs(given, count, metric, block_rows)
    else:
        packed = _ranked_blocks(signatures, metric, block_rows, key, order)
        found = blocks.nearest(blocks.meet(packed, F.col("low.block") <= F.col("high.block")), metric, count)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("distance", "j"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= count)
    for side in ("i", "j"):
        ranked = ranked.join(given.select(F.col("ord").alias(side), F.col("name").alias(f"name_{side}")), side)
    return ranked.select("i", "name_i", "rank", "j", "name_j", "distance")


def distance_matrix(signatures: DataFrame, metric: str = "euclidean", block_rows: int = BLOCK_ROWS,
                    key: str = "model_name", order: str = "ord") -> DataFrame:
    """The full symmetric matrix in long form, ``i, j, distance``, zero diagonal included. Both directions of a pair are
    measured, so that rows of one signature come one after the other."""
    pairs = _measured(blocks.meet(_ranked_blocks(signatures, metric, block_rows, key, order)), metric)
    own = (F.col("low.block") == F.col("high.block")) & (F.col("a") == F.col("b"))
    return pairs.select(F.col("low.ords")[F.col("a")].alias("i"), F.col("high.ords")[F.col("b")].alias("j"),
                        F.when(own, 0.0).otherwise(F.col("distance")).alias("distance"))


def row_statistics(signatures: DataFrame, metric: str = "euclidean", block_rows: int = BLOCK_ROWS,
                   key: str = "model_name", order: str = "ord") -> DataFrame:
    """``i, entries, row_sum, farthest`` of every row of the matrix that :func:`distance_matrix` has in long form. Pairs of
    blocks are measured whole and leave their task as one row per signature."""
    measure = blocks.MEASURES.get(metric)

    @F.arrow_udf("array<struct<place:int,entries:bigint,total:double,farthest:double>>")
    def rows(low: pa.Array, low_width: pa.Array, high: pa.Array, high_width: pa.Array, own: pa.Array) -> pa.Array:
        parts, ends = [], [0]
        for x, y, same in zip(blocks.matrices(low, low_width), blocks.matrices(high, high_width), own.to_pylist()):
            blocks.same_width(x, y)
            d = measure(x, y)
            if same:
                np.fill_diagonal(d, 0.0)
            parts.append((np.arange(len(d), dtype=np.int32), np.full(len(d), d.shape[1]), d.sum(axis=1), d.max(axis=1)))
            ends.append(ends[-1] + len(d))
        values = [pa.array(np.concatenate(column)) for column in zip(*parts)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            values, ["place", "entries", "total", "farthest"]))

    met = blocks.meet(_ranked_blocks(signatures, metric, block_rows, key, order))
    own = F.col("low.block") == F.col("high.block")
    part = met.select("low.ords", F.explode(rows("low.matrix", "low.width", "high.matrix", "high.width", own)).alias("r"))
    return part.groupBy(F.col("ords")[F.col("r.place")].alias("i")).agg(
        F.sum("r.entries").alias("entries"), F.sum("r.total").alias("row_sum"), F.max("r.farthest").alias("farthest"))
