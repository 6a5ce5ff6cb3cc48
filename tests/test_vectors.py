import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillprint.functions import vectors as fn
from quillprint.operators import blocks, distances, filters
from quillprint.plans.registry.inputs import r6, r6_far_from_ties


def _one(spark, values, column):
    return spark.createDataFrame([(values,)], "v array<double>").select(column(F.col("v")).alias("o")).first().o


def test_unit_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    row = distances.compare_pairs(df, "a", "b", ["euclidean", "manhattan", "cosine", "hamming"],
                                  ["cosine", "correlation"]).first()
    assert row.euclidean_distance == pytest.approx(2 ** 0.5) and row.manhattan_distance == 2.0
    assert row.cosine_similarity == 0.0 and row.cosine_distance == 1.0
    assert row.correlation_similarity == pytest.approx(-0.5)


def test_zero_norms_and_constant_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    row = distances.compare_pairs(df, "a", "b", ["cosine"], ["cosine", "correlation"]).first()
    assert (row.cosine_distance, row.cosine_similarity, row.correlation_similarity) == (1.0, 0.0, 0.0)


def test_unequal_width_and_unknown_metric_are_errors(spark):
    df = spark.createDataFrame([([0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="same dimension"):
        distances.compare_pairs(df, "a", "b", ["euclidean"]).collect()
    with pytest.raises(ValueError, match="Unknown"):
        fn.distance(F.col("a"), F.col("b"), "minkowski")
    with pytest.raises(ValueError, match="Unknown"):
        fn.normalize(F.col("a"), "l3")


def test_cleaning_and_width(spark):
    dirty = [float("nan"), float("inf"), float("-inf"), 1.5, None]
    assert _one(spark, dirty, fn.clean_vector) == [0.0, 0.0, 0.0, 1.5, 0.0]
    assert _one(spark, [1.0, 2.0], lambda v: fn.fit_width(v, 4)) == [1.0, 2.0, 0.0, 0.0]
    assert _one(spark, [1.0, 2.0], lambda v: fn.fit_width(v, 1)) == [1.0]


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=64), rng.normal(size=33), np.zeros(5) + 2.0, np.array([0.0, 1.0])):
        got = _one(spark, values.tolist(), fn.statistics)
        counts = np.histogram(values, bins=50)[0] + 1e-10
        share = counts / counts.sum()
        want = {"mean": values.mean(), "std": values.std(), "min": values.min(), "max": values.max(),
                "median": np.median(values), "l1_norm": np.abs(values).sum(), "l2_norm": np.linalg.norm(values),
                "sparsity": (values == 0).mean(), "entropy": -(share * np.log2(share)).sum()}
        for name, value in want.items():
            assert got[name] == pytest.approx(value, abs=1e-9), name


def test_constant_vector_sits_in_bin_25(spark):
    assert set(_one(spark, [3.0] * 4, fn.histogram_bins)) == {25}


def test_signature_validity(spark):
    df = spark.createDataFrame([("a", [0.0, 1e-9]), ("b", []), ("c", [0.0, 1e-7]), ("d", None)],
                               "model_name string, signature array<double>")
    good, bad = filters.split_valid_signatures(df)
    assert [r.model_name for r in good.collect()] == ["c"]
    assert {r.model_name: r.error for r in bad.collect()} == {
        "a": "all-zero signature", "b": "empty signature", "d": "empty signature"}


@pytest.mark.parametrize("block", [1, 3, 7, 100])
@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "hamming"])
def test_all_pairs_in_blocks(spark, block, metric):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(10, 6))
    vectors[4] = 0.0
    df = spark.createDataFrame([(f"m{i}", i, v.tolist()) for i, v in enumerate(vectors)],
                               "model_name string, ord int, signature array<double>")
    got = {(r.i, r.j): r.distance for r in distances.all_pairs(df, metric, block_rows=block).collect()}
    pairs = df.alias("a").join(df.alias("b"), F.col("a.ord") < F.col("b.ord"))
    want = pairs.select("a.ord", F.col("b.ord").alias("o2"),
                        fn.distance(F.col("a.signature"), F.col("b.signature"), metric).alias("d")).collect()
    assert len(got) == 45
    for r in want:
        assert got[(r.ord, r.o2)] == pytest.approx(r.d, abs=1e-12)


def test_matrix_is_symmetric_with_zero_diagonal(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])],
                               "model_name string, ord int, signature array<double>")
    got = {(r.i, r.j): r.distance for r in distances.distance_matrix(df).collect()}
    assert got[(0, 0)] == got[(1, 1)] == 0.0 and got[(0, 1)] == got[(1, 0)] == pytest.approx(2 ** 0.5)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "hamming"])
def test_pairs_of_blocks_meet_without_copies(spark, metric):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(f"m{i}", i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))],
                               "model_name string, ord int, signature array<double>")
    small = distances.all_pairs(df, metric, block_rows=8)
    assert small.count() == 300 * 299 // 2
    for pairs in (small, distances.pairs_within(df, 0.5, metric, block_rows=8), distances.distance_matrix(df, metric)):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        # signatures are dealt out below the product only, and never once per pair of blocks
        assert "CartesianProduct" in plan and "Exchange" not in plan.split("CartesianProduct")[0]
        assert "Generate explode(sequence" not in plan


@pytest.mark.parametrize("metric", ["cosine", "hamming"])
def test_nearest_of_metrics_without_bounds(spark, metric):
    x = np.random.default_rng(8).normal(size=(60, 5))
    df = spark.createDataFrame([(f"m{i}", 7 * i, v.tolist()) for i, v in enumerate(x)],
                               "model_name string, ord int, signature array<double>")
    every = {(r.i, r.j): r.distance for r in distances.distance_matrix(df, metric, block_rows=9).collect()}
    got = {(r.i, r["rank"]): (r.j, r.name_j) for r in distances.nearest_models(df, 4, metric, block_rows=9).collect()}
    assert len(got) == 240
    for i in range(0, 420, 7):
        near = sorted((d, j) for (a, j), d in every.items() if a == i and j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [(j, f"m{j // 7}") for _, j in near]


def test_row_statistics_are_those_of_the_matrix(spark):
    x = np.random.default_rng(9).normal(size=(50, 5))
    df = spark.createDataFrame([(f"m{i}", 3 * i, v.tolist()) for i, v in enumerate(x)],
                               "model_name string, ord int, signature array<double>")
    d = np.linalg.norm(x[:, None, :] - x[None, :, :], axis=2)
    got = distances.row_statistics(df, block_rows=8).collect()
    assert len(got) == 50
    for r in got:
        assert (r.entries, r.row_sum, r.farthest) == (50, pytest.approx(d[r.i // 3].sum()), pytest.approx(d[r.i // 3].max()))


def test_distances_leave_the_worker_by_pairs_of_blocks():
    """A batch of pairs is not turned into all its distances at once."""
    rows = np.random.default_rng(10).normal(size=(6, 4, 3))
    side = lambda part: (pa.array([m.ravel().tolist() for m in part]), pa.array([3] * len(part), pa.int32()))
    asked = []

    def measure(x, y):
        asked.append(len(x))
        return blocks.MEASURES["euclidean"](x, y)

    found = blocks.measured(iter([(*side(rows[:3]), *side(rows[3:]))]), measure)
    first = next(found)
    assert len(asked) == len(first) == 1 and len(first[0]) == 16
    assert [len(x) for x in found] == [1, 1]
    assert first[0].as_py() == pytest.approx(
        np.linalg.norm(rows[0][:, None] - rows[3][None], axis=2).ravel().tolist(), abs=1e-12)


def test_rounding_without_decimals_is_rounding(spark):
    x = [0.0, -0.0, 1e-9, -1e-9, 0.5e-6, -0.5e-6, 1.5e-6, 0.1234565, 0.12345649999999, 2.0000005, -1.0000015, 999.9999995,
         1000.0000005, 123456.7890125, 1e300, float("nan"), float("inf"), None]
    x += np.random.default_rng(11).normal(size=300).tolist()
    frame = spark.createDataFrame([(v,) for v in x], "x double").select(
        r6("x").alias("want"), r6_far_from_ties("x").alias("got"))
    for r in frame.collect():
        assert repr(r.got) == repr(r.want)


@pytest.mark.parametrize("width", [1, 6, 255, 256, 600])
def test_hamming_of_blocks_is_that_of_rows(width):
    rng = np.random.default_rng(width)
    a, b = rng.normal(size=(9, width)), rng.normal(size=(7, width))
    a[2], b[3], a[4, 0], b[5, 0], b[6, -1] = b[2], 0.0, np.nan, np.inf, -np.inf
    with np.errstate(invalid="ignore"):
        got = blocks.MEASURES["hamming"](a, b)
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                threshold = (v.mean() + w.mean()) / 2
                assert got[i, j] == ((v > threshold) != (w > threshold)).mean()


def test_hamming_has_no_pass_per_signature():
    def calls(rows):
        seen, x = [], np.random.default_rng(12).normal(size=(rows, 8))
        sys.setprofile(lambda frame, event, arg: seen.append(event))
        blocks.MEASURES["hamming"](x, x)
        sys.setprofile(None)
        return len(seen)

    calls(4)
    assert calls(200) <= calls(20) + 10


def test_signatures_of_other_widths_fail(spark):
    df = spark.createDataFrame([("a", 0, [1.0]), ("b", 1, [0.0, 1.0])], "model_name string, ord int, signature array<double>")
    for rows in (1, 2):
        with pytest.raises(Exception, match="same dimension"):
            distances.all_pairs(df, block_rows=rows).collect()
