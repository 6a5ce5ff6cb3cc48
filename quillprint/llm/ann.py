"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors are one node. Nodes are dealt to shards of bounded size by their hash. A shard's graph grows batch by batch:
greedy beam searches through the graph so far propose neighbours, relaxed distance pruning keeps those that no kept one
stands in front of, and edges are also laid back. Queries, in blocks, go through every shard's graph by beam search; what
they find is ranked by the inner product of the original vectors in double precision.

Largest inner product is nearest distance once every vector of a shard is lengthened by one component that gives all the
same norm; graphs are built in that space. A shard holds vectors whose largest components are of one power of ten, and
it and the queries are scaled to 1, so that single precision tells the distances apart whatever the other vectors' norms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillprint.session import settle, ship_package

SHARD_ROWS = 8192
QUERY_ROWS = 4096
DEGREE = 32
BUILD_BEAM = 64
BEAM = 128
#: Distances are relaxed by this factor when neighbours are pruned.
RELAX = 1.2
TOP = 20
_STEP = 256


def usable(vector: Column) -> Column:
    """Not null, not zero, and of finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _distances(x: np.ndarray, rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of ``points[b]`` to ``x[rows[b, :]]``."""
    near = x[rows]
    return np.einsum("bcd,bcd->bc", near, near) - 2 * np.einsum("bcd,bd->bc", near, points) + np.einsum(
        "bd,bd->b", points, points)[:, None]


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, points: np.ndarray, beam: int, wide: int = 4
                ) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for every point, and their squared distances (inf where there are fewer).

    All points go on together: each step opens the ``wide`` nearest unopened nodes of each beam.
    """
    count = len(points)
    nodes = np.full((count, beam), -1)
    dist = np.full((count, beam), np.inf)
    opened = np.ones((count, beam), bool)
    seen = np.zeros((count, len(x)), bool)
    nodes[:, 0], opened[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = _distances(x, np.full((count, 1), start), points)[:, 0]
    going = np.arange(count)
    while len(going):
        open_dist = np.where(opened[going], np.inf, dist[going])
        pick = np.argpartition(open_dist, min(wide, beam) - 1, axis=1)[:, :wide]
        good = np.isfinite(np.take_along_axis(open_dist, pick, 1))
        alive = good.any(axis=1)
        going, pick, good = going[alive], pick[alive], good[alive]
        if not len(going):
            break
        opened[going[:, None], pick] |= good
        ahead = np.where(good[:, :, None], edges[nodes[going[:, None], pick]], -1).reshape(len(going), -1)
        row = np.broadcast_to(going[:, None], ahead.shape)
        fresh = (ahead >= 0) & ~seen[row, ahead]
        # A node that two opened nodes point to is taken once.
        order = np.argsort(ahead, axis=1, kind="stable")
        ranked = np.take_along_axis(ahead, order, 1)
        twice = np.zeros(ahead.shape, bool)
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh &= ~twice
        seen[row[fresh], ahead[fresh]] = True
        new = np.where(fresh, _distances(x, np.maximum(ahead, 0), points[going]), np.inf)
        all_dist = np.concatenate([dist[going], new], axis=1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        dist[going] = np.take_along_axis(all_dist, best, 1)
        nodes[going] = np.take_along_axis(np.concatenate([nodes[going], ahead], axis=1), best, 1)
        opened[going] = np.take_along_axis(np.concatenate([opened[going], ~fresh], axis=1), best, 1)
    return nodes, dist


def robust_prune(x: np.ndarray, points: np.ndarray, nodes: np.ndarray, dist: np.ndarray, degree: int, relax: float
                 ) -> np.ndarray:
    """At most ``degree`` neighbours for every point out of its candidates (inf marks what is none).

    The nearest candidate left is kept, and all go to which it is nearer, by the relaxed distance, than the point is.
    """
    kept = np.full((len(points), degree), -1)
    left = dist.copy()
    rows = np.arange(len(points))
    near = x[np.maximum(nodes, 0)]
    norms = np.einsum("bcd,bcd->bc", near, near)
    for i in range(degree):
        best = left.argmin(axis=1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        kept[some, i] = nodes[rows, best][some]
        chosen = near[rows, best]
        between = norms - 2 * np.einsum("bcd,bd->bc", near, chosen) + norms[rows, best][:, None]
        left[relax * relax * np.maximum(between, 0) <= dist] = np.inf
        left[rows, best] = np.inf
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX
                ) -> tuple[np.ndarray, int]:
    """Neighbours of every row of ``x`` (-1 fills up), and the row from which searches start."""
    count = len(x)
    edges = np.full((count, degree), -1)
    start = int(_distances(x, np.arange(count)[None, :], x.mean(axis=0)[None, :]).argmin())
    order = np.random.RandomState(7).permutation(count)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < count:
        fresh = order[done:done + max(1, min(done, _STEP))]
        nodes, dist = beam_search(x, edges, start, x[fresh], beam)
        edges[fresh] = robust_prune(x, x[fresh], nodes, dist, degree, relax)
        source, target = np.repeat(fresh, degree), edges[fresh].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, incoming = np.unique(target, return_index=True, return_counts=True)
        rank = np.argsort(incoming, kind="stable")
        for part in np.array_split(rank, max(1, -(-len(rank) // 512))):
            width = int(incoming[part].max()) if len(part) else 0
            added = np.full((len(part), width), -1)
            for row, j in enumerate(part):
                added[row, :incoming[j]] = source[first[j]:first[j] + incoming[j]]
            own = heads[part]
            every = np.concatenate([edges[own], added], axis=1)
            away = np.where(every >= 0, _distances(x, np.maximum(every, 0), x[own]), np.inf)
            edges[own] = robust_prune(x, x[own], every, away, degree, relax)
        done += len(fresh)
    return edges, start


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lengthened(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max()
    norms = np.einsum("nd,nd->n", vectors, vectors)
    return np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float32)


def build_index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = TOP,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``dim, shard, node, vector, ids, edges, start``: every distinct usable vector, with the ``top + 1`` smallest keys
    that carry it (no search can list more of them), its neighbours and its shard's start node. Written to storage.

    Vectors of different lengths are in different shards. A null key is no key.
    """
    ship_package(rows.sparkSession)
    used = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & usable(F.col("vector")))
    used = used.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    nodes = settle(used.withColumn("place", place).where(F.col("place") <= top + 1).groupBy("vector").agg(
        F.sort_array(F.collect_list("id")).alias("ids")), "ann-nodes")
    nodes = nodes.withColumn("band", F.floor(F.log10(F.array_max(F.transform("vector", F.abs)))).cast("int"))
    bands, ends = {}, 0
    for band, count in sorted(tuple(x) for x in nodes.groupBy("band").count().collect()):
        bands[band] = (ends, -(-count // shard_rows))
        ends += bands[band][1]
    first, many = (F.create_map(*[F.lit(x) for band, at in bands.items() for x in (band, at[i])])[F.col("band")]
                   if bands else F.lit(1) for i in (0, 1))
    dealt = nodes.select(F.size("vector").alias("dim"),
                         (first + F.pmod(F.xxhash64("vector"), many)).cast("bigint").alias("shard"), "vector", "ids")

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        edges, start = build_graph(_lengthened(_matrix(shard.column("vector"))))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(edges) + 1) * edges.shape[1], pa.int32()),
                                         pa.array(edges.ravel().astype(np.int32)))
        return pa.table({"dim": shard.column("dim"), "shard": shard.column("shard"),
                         "node": pa.array(np.arange(len(edges))), "vector": shard.column("vector"),
                         "ids": shard.column("ids"), "edges": lists,
                         "start": pa.array(np.full(len(edges), start))})

    kind = rows.schema[key].dataType.simpleString()
    return settle(dealt.groupBy("dim", "shard").applyInArrow(
        build, f"dim int, shard bigint, node bigint, vector array<double>, ids array<{kind}>, edges array<int>, "
               "start bigint"), "ann-index")


def search(index: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM, key: str = "vec_id",
           vector: str = "embedding", query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found for every query, itself not counted.

    Nearness is the inner product, ties go to the smaller key. Queries whose vector is not usable are left out; repeated
    query rows are searched once.
    """
    ship_package(index.sparkSession)
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("query")).where(
        F.col("query_id").isNotNull() & usable(F.col("query"))).distinct()
    asked = settle(asked, "ann-queries")
    blocks = max(1, -(-asked.count() // query_rows))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    asked = asked.withColumn("dim", F.size("query")).withColumn(
        "block", F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    graph = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    kind = queries.schema[key].dataType
    arrow_kind = to_arrow_type(kind)
    schema = pa.schema([("query_id", arrow_kind), ("vec_id", arrow_kind), ("score", pa.float64())])

    def find(points: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(points) or not len(shard):
            return schema.empty_table()
        shard = shard.take(np.argsort(shard.column("node").to_numpy()))
        vectors, wanted = _matrix(shard.column("vector")), _matrix(points.column("query"))
        edges, start = _matrix(shard.column("edges")), shard.column("start")[0].as_py()
        ids, names = shard.column("ids").to_pylist(), points.column("query_id").to_pylist()
        space = _lengthened(vectors)
        width = min(beam, len(vectors))
        out = []
        for low in range(0, len(wanted), _STEP):
            part = wanted[low:low + _STEP]
            scaled = part / np.abs(part).max(axis=1, keepdims=True)
            lengthened = np.column_stack([scaled, np.zeros(len(scaled))]).astype(np.float32)
            nodes, dist = beam_search(space, edges, start, lengthened, width)
            score = np.zeros(nodes.shape)
            for j in range(part.shape[1]):  # one order of addition, so that equal vectors score equally
                score += part[:, j, None] * vectors[np.maximum(nodes, 0), j]
            for row, name in enumerate(names[low:low + _STEP]):
                found = [(-s, i) for s, n, d in zip(score[row], nodes[row], dist[row]) if np.isfinite(d)
                         for i in ids[n] if i != name]
                out.extend((name, i, -s) for s, i in sorted(found)[:top])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema) if out \
            else schema.empty_table()

    found = asked.groupBy("dim", "shard", "block").cogroup(graph.groupBy("dim", "shard", "block")).applyInArrow(
        find, f"query_id {kind.simpleString()}, vec_id {kind.simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, every: int = 20) -> DataFrame:
    """The nearest of every row whose ``vec_id`` is divisible by ``every``, against all rows."""
    index = build_index(embeddings)
    return search(index, embeddings.where(F.col("vec_id") % every == 0))
