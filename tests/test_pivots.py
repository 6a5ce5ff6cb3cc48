"""Near pairs through pivots: the same as all pairs, with fewer copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillprint.operators import distances, pivots

SCHEMA = "model_name string, ord bigint, signature array<double>"


def _frame(spark, x, step=1):
    return spark.createDataFrame([(f"m{i}", step * i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA).repartition(5)


def _clustered(n=1200, width=16, clusters=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width)) * 10
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, width)) * 0.3


def _distances(x, metric):
    a, b = x[:, None, :], x[None, :, :]
    return np.abs(a - b).sum(axis=2) if metric == "manhattan" else np.linalg.norm(a - b, axis=2)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["clustered", "gaussian", "equal", "far"])
def test_pairs_within_are_all_of_them(spark, metric, kind):
    rng = np.random.default_rng(9)
    x = {"clustered": _clustered(300), "gaussian": rng.normal(size=(300, 8)),
         "equal": np.repeat(rng.normal(size=(3, 6)), 70, axis=0),
         "far": np.vstack([rng.normal(size=(150, 5)), 1e9 + rng.normal(size=(20, 5)), np.zeros((10, 5))])}[kind]
    d = _distances(x, metric)
    limit = float(np.quantile(d[np.triu_indices(len(x), 1)], 0.05))
    want = {(i, j): d[i, j] for i, j in zip(*np.nonzero(np.triu(d <= limit, 1)))}
    found = {(r.i, r.j): r.distance for r in distances.pairs_within(_frame(spark, x), limit, metric, block_rows=32).collect()}
    assert set(found) == set(want)
    np.testing.assert_allclose([found[p] for p in want], list(want.values()), atol=1e-9)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("count,rows", [(1, 16), (5, 40), (30, 16), (500, 32)])
def test_nearest_are_the_nearest(spark, metric, count, rows):
    x = np.vstack([_clustered(120, 6, 5), np.repeat(_clustered(2, 6, 2), 20, axis=0), np.full((1, 6), 500.0)])
    d = _distances(x, metric)
    np.fill_diagonal(d, np.inf)
    found = distances.nearest_models(_frame(spark, x, 3), count, metric, block_rows=rows).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.i, r["rank"])):
        got.setdefault(r.i // 3, []).append((r.j // 3, r.distance))
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:min(count, len(x) - 1)]
        assert [round(v, 9) for _, v in got[i]] == [round(float(d[i, j]), 9) for j in order]


def test_clusters_are_copied_a_few_times_only(spark):
    x = _clustered(3000, 16, 30)
    given = _frame(spark, x).select("ord", F.col("model_name").alias("name"), "signature")
    blocks = pivots.make_blocks(given, "euclidean", 16)
    sizes = [r.n for r in blocks.table.collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 48
    pairs = pivots.block_pairs(blocks, blocks.table.select("block", F.lit(2.0).alias("reach")))
    assert pivots.copies_per_signature(blocks, pairs) < 0.25 * len(sizes)


def test_none_one_and_unequal_widths(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert distances.pairs_within(empty, 1.0).count() == 0 and distances.nearest_models(empty, 2).count() == 0
    assert distances.nearest_models(_frame(spark, np.ones((1, 3))), 2).count() == 0
    ragged = spark.createDataFrame([("a", 0, [1.0, 2.0]), ("b", 1, [1.0])], SCHEMA)
    with pytest.raises(Exception, match="same dimension"):
        distances.pairs_within(ragged, 1.0).collect()
