"""Near pairs of signatures without copying every signature to every block of others.

Signatures go to the nearest of a bounded number of pivots, and each cell is cut by distance from its pivot into shells and
blocks of bounded size. A block knows the least and the largest distance of its members from their pivot; by the triangle
inequality that and the distance of two pivots bound the distance of any two members from below. Pairs of blocks that are
too far apart fall away within the product of blocks (:mod:`quillprint.operators.blocks`), which copies no signature. What is
left is compared block by block with matrix products; pairs that pass are measured again entry by entry, so rounding of the
products never decides.

The result does not depend on pivots or blocks. Only metrics with a triangle inequality qualify.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.operators import blocks as products
from quillprint.operators.blocks import MEASURED, SLACK
from quillprint.session import settle, ship_package

METRICS = ("euclidean", "manhattan")
#: Pivots at most, and the bytes they may have; both keep what the driver and every task hold at a constant.
PIVOTS = 1024
PIVOT_BYTES = 64 << 20


def _measure(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of equally many rows, entry by entry."""
    return np.abs(a - b).sum(axis=1) if metric == "manhattan" else np.linalg.norm(a - b, axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = set(np.diff(array.offsets.to_numpy()).tolist())
    if len(widths) > 1:
        raise ValueError(f"Signatures must have the same dimension: {sorted(widths)}")
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


@dataclass(frozen=True)
class Blocks:
    """``points``: ``ord, name, signature, block``. ``table``: ``block, cell, n, least, most``. ``between``: distances of
    the cells' pivots."""

    points: DataFrame
    table: DataFrame
    between: np.ndarray
    metric: str


def make_blocks(given: DataFrame, metric: str, block_rows: int) -> Blocks:
    """Signatures (``ord, name, signature``) in blocks of about ``block_rows``, never many more: shells that hold more are
    dealt out by a hash, so that equal signatures, however many, are many blocks."""
    ship_package(given.sparkSession)
    spark = given.sparkSession
    facts = given.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("signature")).alias("width")).first()
    width = max(1, facts.width or 1)
    count = max(1, min(PIVOTS, PIVOT_BYTES // (8 * width), math.ceil(facts.n / (4 * block_rows))))
    chosen = given.select(F.xxhash64("ord").alias("h"), "ord", "signature").orderBy("h", "ord").limit(count).collect()
    if len({len(r.signature) for r in chosen}) > 1:
        raise ValueError("Signatures must have the same dimension")
    pivots = np.array([r.signature for r in chosen], np.float64) if chosen else np.zeros((1, width))
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = _matrix(batch.column(2))
            if x.shape[1] != sent.value.shape[1]:
                raise ValueError(f"Signatures must have the same dimension: {sorted({x.shape[1], sent.value.shape[1]})}")
            cell = products.squares(x, sent.value)[0].argmin(axis=1)
            far = _measure(x, sent.value[cell], metric)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(far)],
                                             ["ord", "name", "signature", "cell", "far"])

    placed = settle(given.mapInArrow(assign, "ord bigint, name string, signature array<double>, cell bigint, far double"),
                    "pivot-cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("edge"))
    # as many shells as blocks; at most as many rows as pivots
    shells = F.ceil(F.col("n") / block_rows)
    shell = F.least(F.when(F.col("edge") > 0, F.floor(F.col("far") / F.col("edge") * shells)).otherwise(0), shells - 1)
    shelled = placed.join(F.broadcast(cells), "cell").withColumn("shell", shell.cast("bigint")).drop("n", "edge")
    sizes = shelled.groupBy("cell", "shell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    part = F.pmod(F.xxhash64("ord"), F.col("parts"))
    points = settle(shelled.join(sizes, ["cell", "shell"]).select(
        "ord", "name", "signature", "cell", "far",
        F.concat_ws("-", "cell", "shell", part.cast("string")).alias("block")), "pivot-blocks")
    table = points.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("least"),
                                                F.max("far").alias("most"))
    between = np.array([_measure(pivots, p[None, :], metric) for p in pivots]).reshape(len(pivots), len(pivots))
    return Blocks(points.select("ord", "name", "signature", "block"), settle(table, "pivot-table"), between, metric)


def _lower_bound(d: Column, low: str, high: str) -> Column:
    """The least distance that members of two blocks can have, a little less for rounding."""
    a0, a1, b0, b1 = (F.col(f"{side}.{name}") for side in (low, high) for name in ("least", "most"))
    bound = F.greatest(d - a1 - b1, a0 - d - b1, b0 - d - a1, F.lit(0.0))
    return bound - SLACK * (d + a1 + b1)


def block_pairs(blocks: Blocks, reach: DataFrame) -> DataFrame:
    """``low, high``: pairs of blocks, a block with itself too, whose members can be as near as either block's ``reach``.

    Cells are ruled out first, all pairs of a bounded number of them; then the blocks of what is left. For reports of how much
    the bounds rule out; the product of :func:`_meet` applies the same bound.
    """
    spark = blocks.table.sparkSession
    known = blocks.table.join(reach, "block")
    cells = known.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most"),
                                      F.max("reach").alias("reach")).toArrow()
    ids, least, most, far = (cells.column(c).to_numpy() for c in ("cell", "least", "most", "reach"))
    d = blocks.between[np.ix_(ids, ids)] if len(ids) else np.zeros((0, 0))
    bound = np.maximum.reduce([d - most[:, None] - most[None, :], least[:, None] - d - most[None, :],
                               least[None, :] - d - most[:, None], np.zeros_like(d)])
    bound = bound - SLACK * (d + most[:, None] + most[None, :])
    i, j = np.nonzero(np.triu(bound <= np.maximum(far[:, None], far[None, :])))
    near = spark.createDataFrame(pa.table({"low_cell": pa.array(ids[i], pa.int64()), "high_cell": pa.array(ids[j], pa.int64()),
                                           "d": pa.array(d[i, j], pa.float64())}))
    low, high = (known.select(F.col("cell").alias(f"{side}_cell"), F.struct("block", "least", "most", "reach").alias(side))
                 for side in ("low", "high"))
    met = near.join(low, "low_cell").join(high, "high_cell")
    once = (F.col("low_cell") != F.col("high_cell")) | (F.col("low.block") <= F.col("high.block"))
    close = _lower_bound(F.col("d"), "low", "high") <= F.greatest("low.reach", "high.reach")
    return met.where(once & close).select(F.col("low.block").alias("low"), F.col("high.block").alias("high"))


def copies_per_signature(blocks: Blocks, pairs: DataFrame) -> float:
    """How often a signature is copied on average; without bounds it would be the number of blocks."""
    sizes = blocks.table.select("block", "n")
    sides = pairs.select(F.explode(F.when(F.col("low") == F.col("high"), F.array("low"))
                                   .otherwise(F.array("low", "high"))).alias("block"))
    copied = sides.join(sizes, "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return copied / max(1, sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _meet(blocks: Blocks, reach: DataFrame) -> DataFrame:
    """Pairs of packed blocks, a block with itself too, whose members can be as near as either block's ``reach``. The bound
    is a condition of the product, so signatures are copied for no pair, ruled out or not."""
    spark = blocks.table.sparkSession
    ways = spark.createDataFrame(pa.table({"cell": pa.array(np.arange(len(blocks.between)), pa.int64()),
                                           "ways": pa.array(list(blocks.between), pa.list_(pa.float64()))}))
    facts = blocks.table.select("block", "cell", "least", "most").join(reach, "block").join(F.broadcast(ways), "cell")
    packed = products.pack(blocks.points, facts)
    d = F.get(F.col("low.ways"), F.col("high.cell").cast("int"))
    close = _lower_bound(d, "low", "high") <= F.greatest("low.reach", "high.reach")
    return products.meet(packed, (F.col("low.block") <= F.col("high.block")) & close)


def pairs_within(given: DataFrame, limit: float, metric: str, block_rows: int) -> DataFrame:
    """Pairs of ``given`` (``ord, name, signature``) at most ``limit`` apart."""
    blocks = make_blocks(given, metric, block_rows)
    reach = blocks.table.select("block", F.lit(float(limit)).alias("reach"))
    return products.within(_meet(blocks, reach), metric, limit)


def _nearest_reach(blocks: Blocks, count: int) -> DataFrame:
    """``block, reach``: no member of the block has its ``count`` nearest others farther away than ``reach``.

    From the block itself where it has enough members: the largest of their ``count``-th distances. Else from the nearest
    block that has: its members are no farther than the way over both pivots. Infinite if no block has enough.
    """
    metric = blocks.metric

    def measure(table: pa.Table) -> pa.Table:
        x = _matrix(table.column("signature"))
        worst = 0.0
        if len(x) <= count:
            worst = math.inf
        else:
            step = max(1, MEASURED // (len(x) * x.shape[1]))
            for s in range(0, len(x), step):
                some = np.arange(s, min(s + step, len(x)))
                d = _measure(np.repeat(x[some], len(x), axis=0), np.tile(x, (len(some), 1)), metric).reshape(len(some), -1)
                d[np.arange(len(some)), some] = math.inf
                worst = max(worst, float(np.partition(d, count - 1, axis=1)[:, count - 1].max()))
        return pa.table({"block": table.column("block").slice(0, 1), "own": pa.array([worst])})

    own = blocks.points.groupBy("block").applyInArrow(measure, "block string, own double")
    known = blocks.table.join(own, "block")
    full = known.where(F.col("n") > count).groupBy("cell").agg(F.min("most").alias("most")).toArrow()
    ids, most = full.column("cell").to_numpy(), full.column("most").to_numpy()
    cells = len(blocks.between)
    detour = (blocks.between[:, ids] + most[None, :]).min(axis=1) if len(ids) else np.full(cells, math.inf)
    ways = blocks.table.sparkSession.createDataFrame(pa.table({
        "cell": pa.array(np.arange(cells), pa.int64()), "detour": pa.array(detour, pa.float64())}))
    over = (F.col("most") + F.col("detour")) * (1 + SLACK)
    return settle(known.join(F.broadcast(ways), "cell").select(
        "block", F.least("own", over).alias("reach")), "pivot-reach")


def nearest_pairs(given: DataFrame, count: int, metric: str, block_rows: int) -> DataFrame:
    """``i, j, distance``: pairs among which every signature's ``count`` nearest others are, and few more."""
    blocks = make_blocks(given, metric, block_rows)
    return products.nearest(_meet(blocks, _nearest_reach(blocks, count)), metric, count)
