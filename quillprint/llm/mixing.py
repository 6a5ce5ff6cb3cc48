"""Mixing sources to target weights by Poisson replication.

A source with share ``w`` of the wanted mixture and ``n`` of ``N`` documents gets the mean repetition rate
``w * N * size / n``. Every document draws its number of copies from a Poisson distribution with that mean, by inverting
the distribution at a number hashed from seed and document, and the copies are shuffled over all partitions by a second
hash. No document is looked at twice, no source is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.functions.binding import let
from quillprint.llm.common import free_name, unit_interval
from quillprint.session import settle

#: Largest mean of one draw; a larger mean is the sum of several draws. 80 terms of the distribution leave 1e-29.
DRAW_MEAN = 16.0
TERMS = 80
#: Sources up to which the rates are sent to every task (about 700 bytes each); beyond, documents meet them in a salted
#: join.
BROADCAST_SOURCES = 10_000
SALTS = 64


def source_rates(docs: DataFrame, weights: DataFrame | None = None, by: str = "source", alpha: float = 0.5,
                 size: float = 1.0) -> DataFrame:
    """``by, n_docs, rate``: the mean number of copies of a document of each source.

    ``weights`` has ``by, weight`` (not negative; they are divided by their sum over the sources present; a source
    without a weight gets 0). Without it, a source of n documents weighs ``n ** alpha``. ``size`` is the wanted number
    of documents over the present one. Null is a source of its own.
    """
    counts = docs.groupBy(F.col(by).alias(by)).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
    else:
        given = weights.groupBy(F.col(by).alias("_by")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = counts.join(given, F.col(by).eqNullSafe(F.col("_by")), "left").select(
            by, "n_docs", F.when(F.col("weight") < 0, F.raise_error(F.lit("a weight is negative")))
            .otherwise(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    total = weighed.agg(F.sum("n_docs").alias("_total"), F.sum("weight").alias("_sum"))
    return weighed.join(F.broadcast(total), F.lit(True)).select(
        by, "n_docs", F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum") * F.col("_total") * F.lit(float(size))
                             / F.col("n_docs")).otherwise(0.0).alias("rate"))


def _distribution(mean: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... copies."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("steps"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"),
                        F.concat(acc["steps"], F.array(acc["c"] + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["steps"]


def mix(docs: DataFrame, weights: DataFrame | None = None, by: str = "source", key: str = "doc_id",
        alpha: float = 0.5, size: float = 1.0, seed: int = 42) -> DataFrame:
    """The mixture: all columns of ``docs`` with ``copy_no`` (from 1) and ``shuffle_key``, in a global random order.

    Rows are dealt to partitions by ``shuffle_key`` and sorted by it within each. Rows with equal keys draw equally, so
    repeated rows are repeated alike; a null key draws as the empty string. An empty table gives an empty one. Input
    columns named ``copy_no`` or ``shuffle_key`` are replaced.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    rates = settle(source_rates(docs, weights, by, alpha, size), "mixing-rates").where("rate > 0")
    draws = F.ceil(F.col("rate") / DRAW_MEAN).cast("int")
    rates = rates.select(F.col(by).alias("_by"), draws.alias("_draws"),
                         let(F.col("rate") / draws, _distribution).alias("_steps"))
    source = free_name(docs, "_source")
    keyed = docs.withColumn(source, F.col(by))
    same = F.col(source).eqNullSafe(F.col("_by"))
    if rates.count() <= BROADCAST_SOURCES:
        met = keyed.join(F.broadcast(rates), same)
    else:
        salted = keyed.withColumn("_salt", F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int"))
        met = salted.join(rates.withColumn("_each", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))),
                          same & (F.col("_salt") == F.col("_each"))).drop("_salt", "_each")
    drawn = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda j: let(
        unit_interval(F.lit(seed), F.col(key), j),
        lambda u: F.size(F.filter(F.col("_steps"), lambda c: c <= u))))
    copies = F.aggregate(drawn, F.lit(0), lambda a, x: a + x)
    counted = met.withColumn("_copies", copies).drop(source, "_by", "_draws", "_steps").where("_copies > 0")
    exploded = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    order = unit_interval(F.lit(f"{seed}s"), F.col(key), F.col("copy_no")) * float(2**52)
    shuffled = exploded.withColumn("shuffle_key", order.cast("bigint"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shuffled.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(docs: str = "documents", alpha: float = 0.5, size: float = 1.0, seed: int = 42) -> str:
    """The same over a table with ``doc_id`` and ``source`` and default weights."""
    def unit(*parts):
        return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13)) AS BIGINT)"
    return f"""
    WITH RECURSIVE weighed AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {alpha}) AS w FROM {docs} GROUP BY 1),
    rates AS (SELECT source, w / (SELECT sum(w) FROM weighed) * (SELECT sum(n) FROM weighed) * {size}::DOUBLE / n AS rate
              FROM weighed),
    drawn AS (SELECT source, CAST(ceil(rate / {DRAW_MEAN}) AS INT) AS draws,
                     rate / CAST(ceil(rate / {DRAW_MEAN}) AS INT) AS mean FROM rates WHERE rate > 0),
    steps AS (SELECT source, draws, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM drawn
              UNION ALL SELECT source, draws, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps
              WHERE k < {TERMS}),
    lists AS (SELECT source, draws, list(c ORDER BY k) AS cs FROM steps GROUP BY 1, 2),
    counted AS (SELECT d.*, list_sum(list_transform(range(1, draws + 1), lambda j: len(list_filter(cs, lambda c:
                    c <= {unit(f"'{seed}'", "coalesce(doc_id::VARCHAR, '')", "j::VARCHAR")} / {2.0**52})))) AS copies
                FROM {docs} d JOIN lists ON d.source IS NOT DISTINCT FROM lists.source)
    SELECT c.* EXCLUDE (copies), CAST(i AS INT) AS copy_no,
           {unit(f"'{seed}s'", "coalesce(doc_id::VARCHAR, '')", "i::VARCHAR")} AS shuffle_key
    FROM counted c, unnest(range(1, CAST(copies AS BIGINT) + 1)) t(i)"""
