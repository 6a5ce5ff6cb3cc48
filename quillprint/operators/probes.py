"""Building probe sets: templates, standard sets, dataset samples, filler, and mixes of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions import text as fn
from quillprint.operators.ordering import first_per_group, sample_per_group, shuffle_positions

PROBE_COLUMNS = ["dataset", "probe_idx", "text"]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _pick(values: Column, place: Column) -> Column:
    return F.element_at(values, (F.pmod(place, F.size(values).cast("bigint")) + 1).cast("int"))


def fill_template(template: Column, first: Column, second: Column) -> Column:
    """Fill the first and second ``{}`` of a template."""
    parts = F.split(template, r"\{\}")
    filled = F.when(F.size(parts) == 1, parts[0]).when(F.size(parts) == 2, F.concat(parts[0], first, parts[1]))
    return filled.otherwise(F.concat(F.get(parts, F.lit(0)), first, F.get(parts, F.lit(1)), second,
                                     F.get(parts, F.lit(2))))


def domain_number(domain: str) -> int:
    """A fixed number per domain, so that template choice is the same in every process."""
    return zlib.crc32(domain.encode("utf-8"))


def template_probes(requests: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Template probes for each request ``(set_id, count, seed)``: an equal share of the count for each domain.

    Template and entity rotate with the position and the seed. Unknown domains get a share and yield nothing.
    """
    domains = domains or fixed.PROBE_DOMAINS
    known = [d for d in domains if d in fixed.PROBE_TEMPLATES]
    table = F.array(*[F.struct(
        F.lit(i).alias("domain_ord"), F.lit(d).alias("domain"), F.lit(domain_number(d)).cast("bigint").alias("number"),
        _texts(fixed.PROBE_TEMPLATES[d]).alias("templates")) for i, d in enumerate(known)])
    share = F.floor(F.col("count") / len(domains))
    places = F.when(share > 0, F.sequence(F.lit(0).cast("bigint"), share - 1)).otherwise(
        F.array().cast("array<bigint>"))
    rows = (requests.select("set_id", "seed", F.explode(places).alias("i"))
            .select("set_id", "seed", "i", F.explode(table).alias("d")).select("set_id", "seed", "i", "d.*"))
    template = _pick(F.col("templates"), F.col("i") + F.col("number") + F.col("seed"))
    entities = _texts(fixed.PROBE_ENTITIES)
    first = _pick(entities, F.col("i") + F.col("seed"))
    second = _pick(entities, F.col("i") + F.col("seed") + 1)
    return rows.select("set_id", "domain_ord", "domain", "i", fill_template(template, first, second).alias("text"))


def filler_probes(requests: DataFrame) -> DataFrame:
    """Filler questions for each request ``(set_id, count, seed)``, rotating with the position and the seed."""
    places = F.when(F.col("count") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("count").cast("bigint") - 1)) \
        .otherwise(F.array().cast("array<bigint>"))
    rows = requests.select("set_id", "seed", F.explode(places).alias("i"))
    return rows.select("set_id", "i", _pick(_texts(fixed.FILLER_PROBES), F.col("i") + F.col("seed")).alias("text"))


def standard_probes(spark: SparkSession, name: str | None = None) -> DataFrame:
    """A standard probe set (or all of them): ``probe_set, probe_idx, text``."""
    if name is not None and name not in fixed.STANDARD_PROBES:
        raise ValueError(f"Unknown standard probe set: {name}")
    chosen = [name] if name else list(fixed.STANDARD_PROBES)
    rows = [(s, i, text) for s in chosen for i, text in enumerate(fixed.STANDARD_PROBES[s])]
    return spark.createDataFrame(rows, "probe_set string, probe_idx int, text string")



def datasets_for(domains: list[str]) -> list[str]:
    return [dataset for wanted, dataset in fixed.DOMAIN_DATASETS if any(d in domains for d in wanted)]


def dataset_samples(sources: DataFrame, datasets: list[str], count: int, seed: int) -> DataFrame:
    """A seeded sample of each dataset, ``max(1, count // datasets)`` texts each, stripped, blanks dropped.

    ``sources`` has ``dataset, probe_idx, text``. A dataset with no rows yields its fallback texts instead.
    """
    if not datasets or count <= 0:
        return sources.select(*PROBE_COLUMNS).limit(0)
    each = max(1, count // len(datasets))
    wanted = sources.where(F.col("dataset").isin(*datasets)).select(*PROBE_COLUMNS)
    sampled = sample_per_group(wanted, ["dataset"], ["probe_idx"], each, seed)
    sampled = sampled.withColumn("text", fn.strip(F.col("text"))).where(F.col("text") != "")
    spare = [(d, i, t) for d in datasets
             for i, t in enumerate(fixed.FALLBACK_PROBES.get(d, fixed.DEFAULT_FALLBACK_PROBES)[:each])]
    fallback = sources.sparkSession.createDataFrame(spare, "dataset string, probe_idx bigint, text string")
    present = wanted.select("dataset").distinct()
    return sampled.unionByName(fallback.join(present, "dataset", "left_anti"))


def diverse_probes(sources: DataFrame, size: int, domains: list[str] | None = None, seed: int = 42,
                   templates: bool = True, samples: bool = True) -> DataFrame:
    """Templates for half the size, dataset samples for the rest, filler up to the size; shuffled and cut.

    The parts are sized by arithmetic except the samples, which are counted once (at most ``size`` rows).
    """
    spark = sources.sparkSession
    domains = domains or fixed.PROBE_DOMAINS
    known = [d for d in domains if d in fixed.PROBE_TEMPLATES]
    made = (size // 2 // len(domains)) * len(known) if templates else 0
    one = spark.createDataFrame([("diverse", size // 2 if templates else 0, seed)],
                                "set_id string, count int, seed int")
    parts = [template_probes(one, domains).select(
        F.lit("template").alias("origin"), (F.col("domain_ord") * size + F.col("i")).alias("place"), "text")]
    drawn = 0
    if samples:
        picked = dataset_samples(sources, datasets_for(domains), size - made, seed)
        picked = picked.select(F.lit("dataset").alias("origin"), F.concat_ws("/", "dataset", "probe_idx").alias("id"),
                               "text").orderBy("id").limit(max(0, size - made))
        drawn = picked.count()
        parts.append(picked.select("origin", F.xxhash64("id").alias("place"), "text"))
    rest = spark.createDataFrame([("diverse", max(0, size - made - drawn), seed)],
                                 "set_id string, count int, seed int")
    parts.append(filler_probes(rest).select(F.lit("filler").alias("origin"), F.col("i").alias("place"), "text"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    shuffled = shuffle_positions(union, seed, ["origin", "place", "text"], "probe_idx")
    set_id = f"diverse_{size}_{'-'.join(domains)}"
    return shuffled.where(F.col("probe_idx") < size).select(
        F.lit(set_id).alias("set_id"), "probe_idx", "origin", "text")


def mixed_probes(sources: DataFrame, n: int, seed: int = 42, mix: bool = True) -> DataFrame:
    """The first n texts of every dataset, in one seeded order (or dataset after dataset)."""
    first = first_per_group(sources.select(*PROBE_COLUMNS), ["dataset"], ["probe_idx"], n)
    if not mix:
        return first
    placed = shuffle_positions(first, seed, ["dataset", "probe_idx"])
    return placed.select("dataset", F.col("probe_idx").alias("source_idx"), "position", "text")


def probe_texts(sources: DataFrame, dataset: str, probe_set: str, n: int, seed: int = 42,
                cached: Callable[[], DataFrame | None] | None = None,
                save: Callable[[DataFrame], bool] | None = None) -> DataFrame:
    """Probes of a dataset spec: the cache first, ``syn`` for a standard set, a comma list (n texts of each dataset,
    mixed), or one dataset (its first n texts). ``cached`` returns the spec's cached set, or None. A miss is given to
    ``save``, and what the cache then holds is the result, whoever saved first."""
    def hit() -> DataFrame | None:
        found = cached() if cached else None
        return None if found is None else found.select(F.lit(dataset).alias("dataset"), "probe_idx", "text")

    found = hit()
    if found is not None:
        return found
    made = _made_probes(sources, dataset, probe_set, n, seed)
    if save is None:
        return made
    save(made)
    found = hit()
    return made if found is None else found


def _made_probes(sources: DataFrame, dataset: str, probe_set: str, n: int, seed: int) -> DataFrame:
    spec = dataset.strip()
    if spec == "syn":
        chosen = standard_probes(sources.sparkSession, probe_set).where(F.col("probe_idx") < n)
        return chosen.select(F.lit("syn").alias("dataset"), F.col("probe_idx").cast("bigint"), "text")
    names = [fixed.DATASET_ALIASES.get(part.strip(), part.strip()) for part in spec.split(",")]
    known = sources.where(F.col("dataset").isin(*names))
    if len(names) == 1:
        first = known.orderBy("probe_idx").limit(n)
        return first.select(F.lit(dataset).alias("dataset"), "probe_idx", "text")
    mixed = mixed_probes(known, n, seed)
    return mixed.select(F.lit(dataset).alias("dataset"), F.col("position").alias("probe_idx"), "text")
