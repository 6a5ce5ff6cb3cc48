"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillprint.session import discard, settle, ship_package

#: Links up to which one task finds the components in memory (some 100 bytes each); beyond, all tasks do so in rounds.
LOCAL_LINKS = 1 << 19


def components(links: DataFrame, a: str = "a", b: str = "b", local_links: int = LOCAL_LINKS) -> DataFrame:
    """``node, component``: for every node of a link the smallest node that it reaches.

    A table of few links is done by one task. In a larger one every node picks its smallest neighbour, which makes trees
    of two nodes or more whose smallest node is the root; each tree becomes one node, and the links between trees are the
    next round's table. So a component's nodes are halved at least every round, and a tree's depth every jump. Rounds go
    on until no link is left, or so few that one task can end it. Nodes with a great many links only take part in
    aggregations that combine before the shuffle, and in joins that AQE splits.
    """
    given = settle(links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other"), "links")
    if given.count() <= local_links:
        return settle(_in_one_task(given), "labels")
    both = settle(given.union(given.select("other", "node")).distinct(), "links")
    labels = settle(both.select("node", F.col("node").alias("component")).distinct(), "labels")
    discard(given)
    while left := both.count():
        roots = settle(_in_one_task(both), "roots") if left <= local_links else _roots(both)
        root = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
        stepped = settle(labels.join(root, "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")), "labels")
        ahead = both.join(roots.select("node", "component"), "node").select(F.col("component").alias("node"), "other")
        between = settle(ahead.join(
            roots.select(F.col("node").alias("other"), F.col("component").alias("to")), "other").select(
            "node", F.col("to").alias("other")).where("node <> other").distinct(), "links")
        discard(both, labels, roots)
        both, labels = between, stepped
    return labels


def _roots(both: DataFrame) -> DataFrame:
    """``node, component``: the root of every node's tree, where each node hangs below its smallest neighbour. Two nodes
    that pick each other are the only cycle there can be; the smaller is the root."""
    picked = settle(both.groupBy("node").agg(F.min("other").alias("component")), "roots")
    back = picked.select(F.col("node").alias("component"), F.col("component").alias("further"))
    trees = settle(picked.join(back, "component").select("node", F.when(
        (F.col("further") == F.col("node")) & (F.col("node") < F.col("component")), F.col("node")).otherwise(
        F.col("component")).alias("component")), "roots")
    discard(picked)
    while True:
        jump = trees.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = settle(trees.join(jump, "component").select(
            "node", F.col("component").alias("old"), F.col("further").alias("component")), "roots")
        discard(trees)
        if jumped.where("component <> old").isEmpty():
            return jumped
        trees = jumped


def _in_one_task(links: DataFrame) -> DataFrame:
    ship_package(links.sparkSession)
    kind = links.schema["node"].dataType.simpleString()
    arrow = to_arrow_type(links.schema["node"].dataType)

    def find(batches):
        top: dict = {}

        def root(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                top.setdefault(x, x)
                top.setdefault(y, y)
                low, high = sorted((root(x), root(y)))
                top[high] = low
        nodes = list(top)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([root(x) for x in nodes], arrow)],
                                         ["node", "component"])

    return links.coalesce(1).mapInArrow(find, f"node {kind}, component {kind}")
