"""Vector functions on ``array<double>`` columns: all JVM-side, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions.binding import let


def _zero() -> Column:
    return F.lit(0.0)


def _sum(vector: Column) -> Column:
    return F.aggregate(vector, _zero(), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def as_doubles(vector: Column | str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return column.cast("array<double>")


def finite_or_zero(x: Column) -> Column:
    infinite = (x == float("inf")) | (x == float("-inf"))
    return F.when(x.isNull() | F.isnan(x) | infinite, _zero()).otherwise(x)


def clean_vector(vector: Column | str) -> Column:
    """NaN, infinities and nulls become zero."""
    return F.transform(as_doubles(vector), finite_or_zero)


def fit_width(vector: Column, width: int) -> Column:
    """Cut or zero-pad to ``width``."""
    return F.slice(F.concat(vector, F.array_repeat(_zero(), width)), 1, width)


def l1_norm(vector: Column) -> Column:
    return F.aggregate(vector, _zero(), lambda acc, x: acc + F.abs(x))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, _zero(), lambda acc, x: acc + x * x))


def mean(vector: Column) -> Column:
    return _sum(vector) / F.size(vector)


def population_std(vector: Column, center: Column | None = None) -> Column:
    def around(c: Column) -> Column:
        return F.sqrt(F.aggregate(vector, _zero(), lambda acc, x: acc + (x - c) * (x - c)) / F.size(vector))

    return let(mean(vector), around) if center is None else around(center)


def _divide(vector: Column, divisor: Column, center: Column | None = None) -> Column:
    both = F.struct(divisor.alias("divisor"), (_zero() if center is None else center).alias("center"))
    return let(both, lambda b: F.when(b["divisor"] > 0, F.transform(
        vector, lambda x: (x - b["center"]) / b["divisor"])).otherwise(vector))


NORMALIZATIONS = {
    "l2": lambda v: _divide(v, l2_norm(v)),
    "l1": lambda v: _divide(v, l1_norm(v)),
    "max": lambda v: _divide(v, F.array_max(F.transform(v, F.abs))),
    "zscore": lambda v: _divide(v, population_std(v), mean(v)),
}


def _euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def _cosine(a: Column, b: Column, when_zero: float, of: callable) -> Column:
    return let(l2_norm(a) * l2_norm(b), lambda norms: F.when(norms == 0, F.lit(when_zero))
               .otherwise(of(_dot(a, b) / norms)))


def _hamming(a: Column, b: Column) -> Column:
    def differing(threshold: Column) -> Column:
        return _sum(F.zip_with(a, b, lambda x, y: F.when((x > threshold) != (y > threshold), 1.0).otherwise(0.0)))

    return let((mean(a) + mean(b)) / 2, differing) / F.size(a)


def _correlation(a: Column, b: Column) -> Column:
    def over_spread(means: Column) -> Column:
        covariance = _sum(F.zip_with(a, b, lambda x, y: (x - means["a"]) * (y - means["b"]))) / F.size(a)
        spread = population_std(a, means["a"]) * population_std(b, means["b"])
        return let(spread, lambda s: F.when(s == 0, _zero()).otherwise(covariance / s))

    return let(F.struct(mean(a).alias("a"), mean(b).alias("b")), over_spread)


DISTANCES = {
    "euclidean": _euclidean,
    "cosine": lambda a, b: _cosine(a, b, 1.0, lambda c: 1 - c),
    "manhattan": lambda a, b: _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))),
    "hamming": _hamming,
}
SIMILARITIES = {
    "cosine": lambda a, b: _cosine(a, b, 0.0, lambda c: c),
    "correlation": _correlation,
}


def _chosen(table: dict, kind: str, name: str):
    if name not in table:
        raise ValueError(f"Unknown {kind}: {name}. Known: {', '.join(table)}")
    return table[name]


def _same_width(a: Column, b: Column, value: Column) -> Column:
    message = F.concat(F.lit("Signatures must have the same dimension: "), F.size(a).cast("string"), F.lit(" vs "),
                       F.size(b).cast("string"))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(message).cast("double"))


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    return _same_width(a, b, _chosen(DISTANCES, "distance metric", metric)(a, b))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    return _same_width(a, b, _chosen(SIMILARITIES, "similarity metric", metric)(a, b))


def normalize(vector: Column, method: str = "l2") -> Column:
    """Normalized copy; a vector whose divisor is zero stays as it is."""
    return _chosen(NORMALIZATIONS, "normalization method", method)(vector)


def median(vector: Column) -> Column:
    n = F.size(vector)

    def middle(ordered: Column) -> Column:
        lower = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
        upper = F.element_at(ordered, F.floor(n / 2).cast("int") + 1)
        return (lower + upper) / 2

    return let(F.array_sort(vector), middle)


def histogram_bins(vector: Column) -> Column:
    """Bin number 0..49 of every value between the smallest and the largest; a constant vector sits in bin 25."""
    bins = fixed.ENTROPY_BINS

    def place(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        spread = F.transform(vector, lambda x: F.least(F.floor(bins * (x - low) / (high - low)), F.lit(bins - 1)))
        constant = F.transform(vector, lambda x: F.lit(bins // 2).cast("bigint"))
        return F.when(high > low, spread).otherwise(constant)

    return let(F.struct(F.array_min(vector).alias("low"), F.array_max(vector).alias("high")), place)


def entropy(vector: Column) -> Column:
    """Base-2 entropy over the 50 bins with a small floor in each; empty bins enter in closed form."""
    total = F.size(vector) + fixed.ENTROPY_BINS * fixed.ENTROPY_FLOOR

    def term(count: Column) -> Column:
        share = (count + fixed.ENTROPY_FLOOR) / total
        return share * F.log2(share)

    def over(bins: Column) -> Column:
        used = F.array_distinct(bins)
        filled = F.aggregate(used, _zero(), lambda acc, b: acc + term(F.size(F.filter(bins, lambda x: x == b))))
        return -(filled + (fixed.ENTROPY_BINS - F.size(used)) * term(F.lit(0)))

    return let(histogram_bins(vector), over)


def statistics(vector: Column) -> Column:
    """The nine summary figures of one signature."""
    zeros = F.size(F.filter(vector, lambda x: x == 0))
    return F.struct(
        mean(vector).alias("mean"), population_std(vector).alias("std"), F.array_min(vector).alias("min"),
        F.array_max(vector).alias("max"), median(vector).alias("median"), l1_norm(vector).alias("l1_norm"),
        l2_norm(vector).alias("l2_norm"), (zeros / F.size(vector)).alias("sparsity"),
        entropy(vector).alias("entropy"))


def is_valid_signature(vector: Column) -> Column:
    """Not empty and not all within tolerance of zero."""
    return F.coalesce(F.exists(vector, lambda x: F.abs(x) > fixed.ZERO_TOLERANCE), F.lit(False))


def valid_tokens(ids: Column, vocabulary_size: int, padding_id: int | None = None) -> Column:
    """Token ids that exist in the vocabulary and are not padding, order kept."""
    def keep(i: Column) -> Column:
        inside = i.isNotNull() & (i >= 0) & (i < vocabulary_size)
        return inside if padding_id is None else inside & (i != padding_id)
    return F.filter(ids, keep)
