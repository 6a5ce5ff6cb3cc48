"""Embeddings of many probes to one signature per model.

Input rows are ``(keys..., probe_idx, embedding)``, unique per probe. The steps:

1. moments: one partial aggregate per task and model, so a model with a third of all rows costs nothing extra. They
   are written to the shared folder once, because every later step needs some of them;
2. for ``concat`` only the first ``ceil(dim / k)`` probes of a model can reach the signature, so only those are
   projected; for ``max`` every task reduces its own rows to one vector per model before the shuffle;
3. ``sum`` and ``mean`` of centred linear projections are zero by construction and are reported as such.

Random projection uses one fixed matrix. Principal components come from a per-model basis, by a tree of QR factors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.config import MERGES, REDUCTIONS
from quillprint.functions import vectors
from quillprint.session import settle, ship_package

PRINCIPAL = ("pca", "svd", "umap")
DEGENERATE = ("sum", "mean")
PART_ROWS = 20_000
#: Bytes of R factors that a task holds, and R factors that one group merges.
TRIANGLE_BYTES = 256 * 1024 * 1024
MERGED = 16
BROADCAST_MODELS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
OK, TOO_FEW, NO_WIDTH, DEGENERATE_MERGE = "ok", "too_few_probes", "zero_width", "degenerate_merge"
NULL_VECTOR, RAGGED_WIDTH = "null_vector", "ragged_width"


def moments(embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """Per model: probe count, first and last position, width, column means and scales.

    The scale is the population standard deviation, 1 for a column that is constant up to rounding. Vectors are summed up
    by model and width, so that one of another width, or null, spoils its own model only: ``min_width`` (-1 for a null)
    then differs from ``width``.
    """
    # a vector without entries stands in as one zero; the width tells
    filled = F.when(F.size("embedding") > 0, vectors.clean_vector("embedding")).otherwise(F.array(F.lit(0.0)))
    clean = embeddings.select(*keys, "probe_idx", _width().alias("w"), filled.alias("v"))
    summary = Summarizer.metrics("mean", "variance").summary(array_to_vector("v"))
    by_width = clean.groupBy(*keys, "w").agg(
        F.count(F.lit(1)).alias("n"), F.min("probe_idx").alias("first_idx"), F.max("probe_idx").alias("last_idx"),
        summary.alias("s"))
    grouped = by_width.groupBy(*keys).agg(
        F.sum("n").alias("probe_count"), F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"),
        F.greatest(F.max("w"), F.lit(0)).alias("width"), F.min("w").alias("min_width"), F.max_by("s", "w").alias("s"))
    n = F.col("probe_count")
    population = F.transform(vector_to_array("s.variance"), lambda x: x * (n - 1) / n)

    def scale(variance: Column, mean: Column) -> Column:
        eps = float(np.finfo(np.float64).eps)
        rounding = n * eps * variance + (n * mean * eps) * (n * mean * eps)
        return F.when(variance <= rounding, F.lit(1.0)).otherwise(F.sqrt(variance))

    return (grouped
            .withColumn("mean", vector_to_array("s.mean"))
            .withColumn("scale", F.zip_with(population, F.col("mean"), scale))
            .select(*keys, "probe_count", "first_idx", "last_idx", "width", "min_width", "mean", "scale"))


def _width() -> Column:
    return F.coalesce(F.size("embedding"), F.lit(-1))


def _with_shape(sized: DataFrame, dim: int) -> DataFrame:
    """Adds how many components each model gets and whether it can be reduced at all."""
    k = F.least(F.col("probe_count") - 1, F.col("width").cast("bigint"), F.lit(dim).cast("bigint"))
    status = (F.when(F.col("width") <= 0, NO_WIDTH).when(F.col("min_width") < 0, NULL_VECTOR)
              .when(F.col("min_width") < F.col("width"), RAGGED_WIDTH)
              .when(F.col("probe_count") < 2, TOO_FEW).otherwise(OK))
    return (sized.withColumn("status", status)
            .withColumn("components", F.when(F.col("status") == OK, k).otherwise(F.lit(0).cast("bigint"))))


def shapes(embeddings: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Per model: probe count, width, number of components, and whether it can be reduced at all."""
    sized = embeddings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("probe_count"), F.greatest(F.max(_width()), F.lit(0)).alias("width"),
        F.min(_width()).alias("min_width"))
    return _with_shape(sized, dim)


@dataclass(frozen=True)
class ModelTable:
    """Moments of all models, settled. The slim columns and the vectors are joined separately: the slim ones are
    broadcast up to a checked number of models, the vectors up to a checked size; beyond that Spark shuffles."""

    table: DataFrame
    keys: list[str]
    models: int
    width: int
    components: int
    dense: bool
    dim: int
    bound: int | None

    @classmethod
    def of(cls, embeddings: DataFrame, keys: list[str], dim: int) -> ModelTable:
        ship_package(embeddings.sparkSession)
        table = settle(_with_shape(moments(embeddings, keys), dim), "moments")
        size = table.agg(F.count(F.lit(1)).alias("models"), F.coalesce(F.max("width"), F.lit(0)).alias("width"),
                         F.coalesce(F.max("components"), F.lit(0)).alias("components"),
                         F.bool_and(F.col("last_idx") - F.col("first_idx") + 1 == F.col("probe_count"))
                         .alias("dense"),
                         F.max(F.when(F.col("status") == OK, F.col("first_idx") + F.ceil(F.lit(dim) / F.col("components")) - 1))
                         .alias("bound")).first()
        return cls(table, keys, size.models, size.width, size.components, bool(size.dense), dim, size.bound)

    def basis_bytes(self) -> int:
        """The most that the bases of all models take, moments included."""
        return self.models * self.width * (self.components + 2) * 8

    def hint(self, slim: DataFrame) -> DataFrame:
        """Broadcast a table of a few numbers per model, up to a number of models."""
        return F.broadcast(slim) if self.models <= BROADCAST_MODELS else slim

    def slim(self, *columns: str) -> DataFrame:
        return self.hint(self.table.where(F.col("status") == OK).select(*self.keys, *columns))

    def vectors(self, *columns: str) -> DataFrame:
        chosen = self.table.where(F.col("status") == OK).select(*self.keys, *columns, "mean", "scale")
        small = self.models * max(self.width, 1) * 16 <= BROADCAST_BYTES
        return F.broadcast(chosen) if small else chosen


@lru_cache(maxsize=8)
def gaussian_rows(rows: int, width: int, seed: int) -> np.ndarray:
    """Standard normal matrix of the legacy generator. The first k rows are the same whatever ``rows`` is."""
    return np.random.RandomState(seed).normal(0.0, 1.0, size=(rows, width))


def projection_matrix(components: int, width: int, seed: int) -> np.ndarray:
    """Gaussian random projection, entries N(0, 1/components)."""
    return gaussian_rows(components, width, seed) / math.sqrt(components)


def standardize(embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows centred and divided by their model's scale, column by column."""
    stats = moments(embeddings, keys).select(*keys, "mean", "scale")
    joined = embeddings.join(stats, keys)
    centred = F.zip_with(vectors.clean_vector("embedding"), F.col("mean"), lambda x, m: x - m)
    return joined.select(*keys, "probe_idx",
                         F.zip_with(centred, F.col("scale"), lambda x, s: x / s).alias("standardized"))


def _last_needed(embeddings: DataFrame, models: ModelTable, dim: int, needs: DataFrame | None) -> DataFrame:
    """Per model: the position of the last of the ``needed`` first probes, at most ``dim``: as many as a ``concat`` signature
    of ``dim`` values takes, or what ``needs`` (``keys, needed``) says. Without gaps that is
    arithmetic. With gaps positions are ranked, without their vectors, and the constant bound
    on the rank lets every task drop all but its own first ``dim`` positions of a model before the shuffle."""
    keys = models.keys
    dense = F.col("last_idx") - F.col("first_idx") + 1 == F.col("probe_count")
    good = models.table.where(F.col("status") == OK)
    needed = F.ceil(F.lit(dim) / F.col("components"))
    shaped = (good.withColumn("needed", needed) if needs is None else good.join(needs, keys)).withColumn("dense", dense)
    direct = shaped.where("dense").select(*keys, "components", (F.col("first_idx") + F.col("needed") - 1)
                                          .alias("last_needed"))
    if models.dense:
        return direct
    gapped = shaped.where("NOT dense").select(*keys, "components", "needed")
    order = Window.partitionBy(*keys).orderBy("probe_idx")
    ranked = (embeddings.select(*keys, "probe_idx").join(models.hint(gapped), keys)
              .withColumn("rank", F.row_number().over(order))
              .where((F.col("rank") <= dim) & (F.col("rank") <= F.col("needed"))))
    return direct.unionByName(ranked.groupBy(*keys, "components").agg(F.max("probe_idx").alias("last_needed")))


def _first_probes(embeddings: DataFrame, models: ModelTable, dim: int, needs: DataFrame | None = None) -> DataFrame:
    """Rows of the probes that can reach the signature, numbered from 0. Only these rows are shuffled."""
    keys = models.keys
    last = _last_needed(embeddings, models, dim, needs)
    # no model needs a later position, and a constant bound prunes the scan; without gaps the moments tell it
    known = needs is None and models.dense and models.dim == dim
    bound = models.bound if known else last.agg(F.max("last_needed")).first()[0]
    early = embeddings.where(F.col("probe_idx") <= F.lit(bound)) if bound is not None else embeddings.limit(0)
    rows = (early.join(models.hint(last), keys).where(F.col("probe_idx") <= F.col("last_needed")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("probe_idx")) - 1
    return rows.select(*keys, rank.alias("rank"), "embedding", "components")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _finite(matrix: np.ndarray) -> np.ndarray:
    return np.nan_to_num(matrix, nan=0.0, posinf=0.0, neginf=0.0)


def _group_codes(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First row of each model in a batch, and the number of the model of every row."""
    codes = np.zeros(table.num_rows, dtype=np.int64)
    for key in keys:
        column = table.column(key).combine_chunks().dictionary_encode()
        codes = codes * (len(column.dictionary) + 1) + column.indices.fill_null(len(column.dictionary)).to_numpy()
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return first, inverse


def _projected_parts(table: pa.Table, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and projected rows of one batch, one part for each (width, components, seed) that occurs. A column
    ``seed`` goes before the argument."""
    components = table.column("components").to_numpy()
    widths = np.diff(table.column("embedding").combine_chunks().offsets.to_numpy())
    has_basis, own_seed = "basis" in table.schema.names, "seed" in table.schema.names
    seeds = table.column("seed").to_numpy() if own_seed else np.full(len(widths), seed)
    for width, k, seed in sorted(set(zip(widths.tolist(), components.tolist(), seeds.tolist()))):
        rows = np.flatnonzero((widths == width) & (components == k) & (seeds == seed))
        part = table if len(rows) == table.num_rows else table.take(pa.array(rows))
        z = (_finite(_matrix(part.column("embedding"))) - _matrix(part.column("mean"))) / _matrix(part.column("scale"))
        if has_basis:
            basis = _matrix(part.column("basis")).reshape(len(rows), k, width)
            yield rows, np.einsum("nkd,nd->nk", basis, z)
        else:
            yield rows, z @ projection_matrix(k, width, seed).T


def _list_array(rows: list[np.ndarray] | np.ndarray) -> pa.Array:
    """Rows of any length as a list column."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(list(rows)) if len(rows) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _matrix_array(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _schema(df: DataFrame, columns: list[str], **extra: T.DataType) -> T.StructType:
    fields = [df.schema[c] for c in columns]
    return T.StructType(fields + [T.StructField(name, kind) for name, kind in extra.items()])


def project(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``(keys, rank, embedding, components, mean, scale[, basis])`` to ``(keys, rank, projected)``. Narrow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for place, values in _projected_parts(table, seed):
                kept = table.select([*keys, "rank"]).take(pa.array(place))
                yield from kept.append_column("projected", _matrix_array(values)).to_batches()

    schema = _schema(rows, [*keys, "rank"], projected=T.ArrayType(T.DoubleType()))
    return rows.mapInArrow(run, schema)


def _project_max(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Like :func:`project`, but every batch yields one component-wise maximum per model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for place, values in _projected_parts(table, seed):
                part = table.select(keys).take(pa.array(place))
                first, codes = _group_codes(part, keys)
                order = np.argsort(codes, kind="stable")
                starts = np.searchsorted(codes[order], np.arange(len(first)))
                best = np.maximum.reduceat(values[order], starts, axis=0)
                yield from part.take(pa.array(first)).append_column("projected", _matrix_array(best)).to_batches()

    return rows.mapInArrow(run, _schema(rows, keys, projected=T.ArrayType(T.DoubleType())))


def _signed(basis: np.ndarray) -> np.ndarray:
    """Each component with its largest loading positive; of loadings that differ by rounding only, the first counts."""
    size = np.abs(basis)
    top = (size >= size.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)
    signs = np.sign(basis[np.arange(len(basis)), top])
    signs[signs == 0] = 1.0
    return basis * signs[:, None]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The R factor of rows, or the rows themselves where they are no more than columns."""
    return rows if rows.shape[0] <= rows.shape[1] else np.linalg.qr(rows, mode="r")


def _task_triangles(embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, part, width, triangle``: per task and model the R factor of the task's rows, each with a leading 1.

    A task holds at most TRIANGLE_BYTES of factors; more models than that are handed on and begun anew. Vectors of
    another width than their model's first in the batch make a factor of their own, which the merge leaves out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        names: dict[tuple, pa.Table] = {}
        part = TaskContext.get().partitionId()

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (_, width), triangle in held.items():
                name = names[(_, width)]
                out = name.append_column("part", pa.array([part], pa.int64())).append_column(
                    "width", pa.array([width], pa.int32())).append_column("triangle", _list_array([triangle.ravel()]))
                yield from out.to_batches()
            held.clear()
            names.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pa.compute.greater(pa.compute.list_value_length(table.column("embedding")), 0))
            if table.num_rows == 0:
                continue
            widths = pa.compute.list_value_length(table.column("embedding")).to_numpy()
            first, codes = _group_codes(table, keys)
            for code in range(len(first)):
                for width in np.unique(widths[codes == code]).tolist():
                    rows = table.take(pa.array(np.flatnonzero((codes == code) & (widths == width))))
                    x = _finite(_matrix(rows.column("embedding")))
                    x = np.hstack([np.ones((len(x), 1)), x])
                    name = (tuple(rows.column(k)[0].as_py() for k in keys), width)
                    names.setdefault(name, rows.select(keys).slice(0, 1))
                    held[name] = _triangle(np.vstack([held[name], x]) if name in held else x)
            if sum(t.nbytes for t in held.values()) > TRIANGLE_BYTES:
                yield from hand_on()
        yield from hand_on()

    return embeddings.select(*keys, "embedding").mapInArrow(run, _schema(
        embeddings, keys, part=T.LongType(), width=T.IntegerType(), triangle=T.ArrayType(T.DoubleType())))


def _merged_triangles(triangles: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """One R factor per model and width, by a tree: every round merges up to MERGED neighbours in one group."""
    def merge(table: pa.Table) -> pa.Table:
        width = table.column("width")[0].as_py() + 1
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        merged = None
        for row in order.tolist():
            triangle = table.column("triangle")[row].values.to_numpy().reshape(-1, width)
            merged = _triangle(triangle if merged is None else np.vstack([merged, triangle]))
        kept = table.select([*keys, "part", "width"]).slice(0, 1)
        return kept.append_column("triangle", _list_array([merged.ravel()]))

    while tasks > 1:
        tasks = -(-tasks // MERGED)
        up = F.floor(F.col("part") / MERGED).cast("bigint")
        triangles = (triangles.withColumn("part", up).groupBy(*keys, "width", "part")
                     .applyInArrow(merge, triangles.schema))
    return triangles


def principal_basis(embeddings: DataFrame, models: ModelTable) -> DataFrame:
    """``(keys, basis)``: the top components of every model, flattened row by row, largest first, signed.

    By a tree of QR factors: one scan of the vectors, in which every task keeps a triangle per model; triangles, which are
    no larger than the square of the width however many rows stand behind them, are merged in groups of bounded size; the
    last triangle holds the model's sums of squares, so that centring, scaling and a small singular value decomposition
    give its components. No row is shuffled, and condition numbers are not squared as they are in a Gram matrix.
    """
    keys = models.keys
    triangles = settle(_task_triangles(embeddings, keys), "triangles")
    tasks = (triangles.agg(F.max("part")).first()[0] or 0) + 1
    shape = models.table.where(F.col("status") == OK).select(
        *keys, F.col("width").cast("int").alias("width"), "components", "scale")
    merged = _merged_triangles(triangles, keys, tasks).select(*keys, "width", "triangle")

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            bases = []
            for triangle, scale, k in zip(*(table.column(c) for c in ("triangle", "scale", "components"))):
                scale = scale.values.to_numpy()
                whole = triangle.values.to_numpy().reshape(-1, len(scale) + 1)
                # below its first row, the triangle is that of the centred columns
                centred = np.linalg.qr(whole, mode="r")[1:, 1:] / scale
                bases.append(_signed(np.linalg.svd(centred, full_matrices=False)[2][:k.as_py()]).ravel())
            yield from table.select(keys).append_column("basis", _list_array(bases)).to_batches()

    joined = merged.join(shape, [*keys, "width"])
    return joined.mapInArrow(decompose, _schema(joined, keys, basis=T.ArrayType(T.DoubleType())))


def _with_moments(rows: DataFrame, embeddings: DataFrame, models: ModelTable, reduction: str) -> DataFrame:
    """A few rows per model with everything needed to project them."""
    joined = rows.join(models.vectors(), models.keys)
    if reduction in PRINCIPAL:
        joined = joined.join(principal_basis(embeddings, models), models.keys)
    return joined


def _all_projected(embeddings: DataFrame, models: ModelTable, reduction: str, seed: int, merge_max: bool,
                   part_rows: int = PART_ROWS) -> DataFrame:
    """Every row projected, or one maximum per batch and model.

    A per-model basis is far wider than a row, so it is not copied onto rows. Where all bases together are below
    BROADCAST_BYTES every task is sent them and rows stay where they are; beyond, rows meet their basis in groups of a
    model's rows, and a model with many rows is cut into several groups of about ``part_rows`` each.
    """
    keys = models.keys
    if reduction not in PRINCIPAL:
        rows = embeddings.join(models.vectors("components"), keys).select(
            *keys, F.col("probe_idx").alias("rank"), "embedding", "components", "mean", "scale")
        return _project_max(rows.drop("rank"), keys, seed) if merge_max else project(rows, keys, seed)

    kept = keys if merge_max else [*keys, "rank"]
    numbered = embeddings.select(*keys, F.col("probe_idx").alias("rank"), "embedding")
    schema = _schema(numbered, kept, projected=T.ArrayType(T.DoubleType()))
    bases = models.vectors("components", "probe_count").join(principal_basis(embeddings, models), keys)
    if models.basis_bytes() <= BROADCAST_BYTES:
        sent = embeddings.sparkSession.sparkContext.broadcast({
            tuple(row[k] for k in keys): [np.array(row[c]) for c in ("mean", "scale", "basis")]
            for row in bases.select(*keys, "mean", "scale", "basis").collect()})

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                table = pa.Table.from_batches([batch])
                first, codes = _group_codes(table, keys)
                for code, row in enumerate(first.tolist()):
                    mine = known.get(tuple(table.column(k)[row].as_py() for k in keys))
                    if mine is None:
                        continue
                    part = table.take(pa.array(np.flatnonzero(codes == code)))
                    mean, scale, basis = mine
                    values = ((_finite(_matrix(part.column("embedding"))) - mean) / scale) @ basis.reshape(-1, len(mean)).T
                    if merge_max:
                        part, values = part.slice(0, 1), values.max(axis=0, keepdims=True)
                    yield from part.select(kept).append_column("projected", _matrix_array(values)).to_batches()

        return numbered.mapInArrow(narrow, schema)

    parts = F.ceil(F.col("probe_count") / part_rows)
    part = F.pmod(F.xxhash64("rank"), parts)
    rows = (numbered.join(models.slim("probe_count"), keys).withColumn("part", part)
            .select(*keys, "part", "rank", "embedding"))
    bases = (bases.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
             .select(*keys, "part", "components", "mean", "scale", "basis"))

    def run(table: pa.Table) -> pa.Table:
        is_row = pa.compute.is_null(table.column("basis"))
        left, right = table.filter(is_row), table.filter(pa.compute.invert(is_row))
        if left.num_rows == 0:
            return left.select(kept).append_column("projected", _list_array([]))
        mean, scale = _matrix(right.column("mean"))[0], _matrix(right.column("scale"))[0]
        basis = _matrix(right.column("basis")).reshape(right.column("components")[0].as_py(), -1)
        values = ((_finite(_matrix(left.column("embedding"))) - mean) / scale) @ basis.T
        if merge_max:
            return left.select(kept).slice(0, 1).append_column("projected", _list_array([values.max(axis=0)]))
        return left.select(kept).append_column("projected", _matrix_array(values))

    grouped = rows.unionByName(bases, allowMissingColumns=True).groupBy(*keys, "part")
    return grouped.applyInArrow(run, schema)


def projected_rows(embeddings: DataFrame, dim: int, reduction: str = "random_projection", seed: int = 42,
                   keys: list[str] | None = None) -> DataFrame:
    """Reduced row of every probe: ``(keys, probe_idx, projected)``."""
    keys = keys or ["model_name"]
    _check(reduction, "concat")
    models = ModelTable.of(embeddings, keys, dim)
    return (_all_projected(embeddings, models, reduction, seed, merge_max=False)
            .withColumnRenamed("rank", "probe_idx"))


def _check(reduction: str, merge: str) -> None:
    if reduction not in REDUCTIONS:
        raise ValueError(f"Unsupported reduction method: {reduction}")
    if merge not in MERGES:
        raise ValueError(f"Unsupported merge method: {merge}")


def signatures(embeddings: DataFrame, dim: int, reduction: str = "random_projection", merge: str = "concat",
               seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """One row per model: ``keys, probe_count, width, components, status, signature``.

    ``status`` is ``ok``, or says why there is no signature (null): too few probes, no width, or a degenerate merge.
    ``umap`` means its fallback, principal components. The moments, and the triangles of principal components, are
    computed at once, the rest when asked for.
    """
    keys = keys or ["model_name"]
    _check(reduction, merge)
    head = [*keys, "probe_count", "width", "components", "status"]
    if merge in DEGENERATE:
        status = F.when(F.col("status") == OK, F.lit(DEGENERATE_MERGE)).otherwise(F.col("status"))
        return (shapes(embeddings, keys, dim).withColumn("status", status).select(*head)
                .withColumn("signature", F.lit(None).cast("array<double>")))

    models = ModelTable.of(embeddings, keys, dim)
    if merge == "concat":
        rows = _with_moments(_first_probes(embeddings, models, dim), embeddings, models, reduction)
        ordered = F.array_sort(F.collect_list(F.struct("rank", "projected")))
        merged = (project(rows, keys, seed).groupBy(*keys)
                  .agg(F.flatten(F.transform(ordered, lambda r: r["projected"])).alias("merged")))
    else:
        merged = (_all_projected(embeddings, models, reduction, seed, merge_max=True).groupBy(*keys)
                  .agg(vector_to_array(Summarizer.max(array_to_vector("projected"))).alias("merged")))

    final = F.when(F.col("status") == OK, vectors.fit_width(vectors.clean_vector("merged"), dim))
    return (models.table.select(*head).join(merged, keys, "left").withColumn("signature", final)
            .select(*head, "signature"))


def signatures_by_setting(embeddings: DataFrame, wanted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per model and setting: ``keys, setting, probe_count, width, components, status, signature``.

    ``wanted`` has ``keys, setting, dim, reduction, merge, seed``: settings are data, and the number of jobs does not grow
    with them. Moments are computed once a model. A signature of k components is the head of one with more: the first k
    rows of the Gaussian matrix are the same for every k, and so are the first k principal components. So a model is
    projected once a seed, with the most components that any of its settings asks for, and every setting cuts its own.
    """
    keys = keys or ["model_name"]
    facts = wanted.agg(F.coalesce(F.max("dim"), F.lit(1)).alias("dim"), F.collect_set("reduction").alias("reductions"),
                       F.collect_set("merge").alias("merges")).first()
    for reduction in facts.reductions or ["random_projection"]:
        for merge in facts.merges:
            _check(reduction, merge)
    dim = int(facts.dim)
    rows = embeddings.join(wanted.select(*keys).distinct(), keys, "left_semi")
    models = ModelTable.of(rows, keys, dim)
    known = models.table.select(*keys, "probe_count", "width", F.col("components").alias("most"), "status")
    principal = F.col("reduction").isin(*PRINCIPAL)
    status = F.when((F.col("status") == OK) & F.col("merge").isin(*DEGENERATE), DEGENERATE_MERGE).otherwise(F.col("status"))
    # principal components have no seed: one family of their own
    asked = settle(wanted.join(models.hint(known), keys).select(
        *keys, "setting", F.col("dim").cast("int").alias("dim"), "merge", principal.alias("principal"),
        F.when(principal, F.lit(0)).otherwise(F.col("seed")).cast("bigint").alias("seed"), "probe_count", "width", "most",
        status.alias("status"), F.least("most", F.col("dim").cast("bigint")).alias("components")), "settings")
    good = asked.where(F.col("status") == OK)
    family = [*keys, "principal", "seed"]

    def families(merge: str, principal: bool) -> DataFrame:
        return good.where((F.col("merge") == merge) & (F.col("principal") == principal)).select(*keys, "seed").distinct()

    has_principal, has_random = (any((r in PRINCIPAL) == p for r in facts.reductions) for p in (True, False))
    made = []
    if "concat" in facts.merges:
        needs = good.where("merge = 'concat'").groupBy(*keys).agg(
            F.max(F.ceil(F.col("dim") / F.col("components"))).alias("needed"))
        early = _first_probes(rows, models, dim, needs)
        parts = []
        if has_random:
            drawn = early.join(families("concat", False), keys).join(models.vectors(), keys)
            parts.append(project(drawn, [*keys, "seed"], 0).withColumn("principal", F.lit(False)))
        if has_principal:
            turned = early.join(families("concat", True), keys)
            turned = _with_moments(turned.drop("seed"), rows, models, "pca")
            parts.append(project(turned, keys, 0).select(*keys, F.lit(0).cast("bigint").alias("seed"), "rank", "projected",
                                                         F.lit(True).alias("principal")))
        whole = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
        made.append(whole.groupBy(*family).agg(F.array_sort(F.collect_list(F.struct("rank", "projected"))).alias("rows"))
                    .withColumn("merge", F.lit("concat")))
    if "max" in facts.merges:
        parts = []
        if has_random:
            drawn = rows.join(families("max", False), keys).join(models.vectors("components"), keys).select(
                *keys, "seed", "embedding", "components", "mean", "scale")
            parts.append(_project_max(drawn, [*keys, "seed"], 0).withColumn("principal", F.lit(False)))
        if has_principal:
            chosen = rows.join(families("max", True).drop("seed"), keys, "left_semi")
            parts.append(_all_projected(chosen, models, "pca", 0, merge_max=True).select(
                *keys, F.lit(0).cast("bigint").alias("seed"), "projected", F.lit(True).alias("principal")))
        whole = parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]
        best = vector_to_array(Summarizer.max(array_to_vector("projected")))
        one = F.array(F.struct(F.lit(0).alias("rank"), best.alias("projected")))
        made.append(whole.groupBy(*family).agg(one.alias("rows")).withColumn("merge", F.lit("max")))

    head = [*keys, "setting", "probe_count", "width", "components", "status"]
    if not made:
        return asked.select(*head, F.lit(None).cast("array<double>").alias("signature"))
    found = made[0].unionByName(made[1]) if len(made) == 2 else made[0]
    # rows are projected with the deviation of the most components
    k = F.col("components").cast("int")
    factor = F.when(F.col("principal"), F.lit(1.0)).otherwise(F.sqrt(F.col("most") / F.col("components")))
    needed = F.ceil(F.col("dim") / F.col("components"))
    cut = F.flatten(F.transform(F.filter("rows", lambda r: r["rank"] < needed), lambda r: F.transform(
        F.slice(r["projected"], F.lit(1), k), lambda x: x * factor)))
    final = F.when(F.col("status") == OK, vectors.fit_width(vectors.clean_vector(cut), F.col("dim")))
    return asked.join(found, [*family, "merge"], "left").withColumn("signature", final).select(*head, "signature")
