"""Positions. Order is explicit everywhere: these operators number rows without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_PREFIX = 4
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def seeded_hash(seed: int | Column, *parts: Column) -> Column:
    """md5 of seed and parts: the random key of a row, the same on any partitioning."""
    first = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws("|", first, *[p.cast("string") for p in parts]).cast("binary"))


def number_blocks(df: DataFrame, block: list[str], order: list, name: str, group: list[str] | None = None) -> DataFrame:
    """Dense numbers from 0 in the order of ``(block, order)``, per ``group``.

    Blocks are of bounded size. Their sizes are summed up first, so a task sorts one block and the only global step
    runs over one row per block.
    """
    group = group or []
    sizes = df.groupBy(*group, *block).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("bigint")))
    inside = Window.partitionBy(*group, *block).orderBy(*order)
    return (df.withColumn("_rank", F.row_number().over(inside))
            .join(offsets.drop("_size"), [*group, *block])
            .withColumn(name, F.col("_offset") + F.col("_rank") - 1)
            .drop("_rank", "_offset"))


def shuffle_positions(df: DataFrame, seed: int, ids: list[str], name: str = "position") -> DataFrame:
    """Seeded shuffle: a position for every row, decided by the hash of seed and ids."""
    hashed = df.withColumn("_hash", seeded_hash(seed, *[F.col(c) for c in ids]))
    hashed = hashed.withColumn("_block", F.substring("_hash", 1, HASH_PREFIX))
    return number_blocks(hashed, ["_block"], ["_hash", *ids], name).drop("_hash", "_block")


def first_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of every group. The rank has a constant bound, so tasks cut their own rows before the
    shuffle and a large group reaches the final task as n rows per task.

    Spark cuts early up to a number of rows that is a session setting; it is raised where n is larger, and left alone where
    it is off (-1). The cut streams over sorted rows, so its memory does not grow with n.
    """
    conf = df.sparkSession.conf
    if 0 <= int(conf.get(GROUP_LIMIT)) < n:
        conf.set(GROUP_LIMIT, str(n))
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def sample_per_group(df: DataFrame, group: list[str], ids: list[str], n: int, seed: int) -> DataFrame:
    """Seeded sample without replacement: n rows of every group."""
    key = seeded_hash(seed, *[F.col(c) for c in [*group, *ids]])
    return first_per_group(df.withColumn("_key", key), group, ["_key", *ids], n).drop("_key")


def running_offsets(df: DataFrame, order: str, amount: str, block_rows: int = 4096) -> DataFrame:
    """Start and end of each row's slice when ``amount`` is laid end to end in ``order``."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    totals = blocked.groupBy("_block").agg(F.sum(amount).alias("_total"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_offset") + F.sum(amount).over(inside)
    return (blocked.join(offsets, "_block").withColumn("slice_end", end)
            .withColumn("slice_start", F.col("slice_end") - F.col(amount)).drop("_block", "_offset"))
