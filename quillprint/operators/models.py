"""Lookups and positions around a list of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.functions import names
from quillprint.operators.ordering import running_offsets


def with_metadata(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog fields of each model; a model the catalog does not know counts as generative."""
    known = catalog.withColumn("in_catalog", F.lit(True))
    joined = models.join(known, "model_name", "left").withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))
    generative = F.when(F.col("in_catalog"), F.col("is_generative")).otherwise(F.lit(True))
    return joined.withColumn("is_generative", generative)


def split_cached(models: DataFrame, cached: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Models with a cached answer, and models that still need one."""
    keys = keys or ["model_name", "dataset"]
    return models.join(cached, keys, "left_semi"), models.join(cached, keys, "left_anti")


def add_new_entries(existing: DataFrame, fresh: DataFrame, key: str = "model_name") -> DataFrame:
    """Existing entries as they are, and fresh ones for models that had none."""
    return existing.unionByName(fresh.join(existing, key, "left_anti"), allowMissingColumns=True)


def in_list_order(results: DataFrame, models: DataFrame) -> DataFrame:
    """Results in the order of the model list. A name listed twice gets one result, at its first place."""
    places = models.groupBy("model_name").agg(F.min("ord").alias("ord"))
    return results.join(places, "model_name").orderBy("ord")


def assign_round_robin(models: DataFrame, workers: list[int], explicit: str = "worker",
                       order: str = "ord") -> DataFrame:
    """Worker of each model by list position; one that is given stays."""
    turn = F.element_at(F.array(*[F.lit(w) for w in workers]), (F.pmod(F.col(order), F.lit(len(workers))) + 1)
                        .cast("int"))
    return models.withColumn("worker", F.coalesce(F.col(explicit).cast("int"), turn))


def is_api_only(models: DataFrame, model_type: str = "auto") -> DataFrame:
    """One row: whether every model runs behind a provider interface. False for an empty list."""
    kind = names.provider(F.col("model_name")) if model_type == "auto" else F.lit(model_type)
    every = F.bool_and(names.is_api_provider(kind))
    return models.agg(F.coalesce(every, F.lit(model_type != "auto" and model_type in names.fixed.API_PROVIDERS))
                      .alias("api_only"))


def total_seconds(timings: DataFrame, encode_seconds: Column) -> DataFrame:
    """Time of each model: its generation and reduction, and the shared encoding."""
    return timings.withColumn(
        "total_seconds", F.col("generation_seconds") + encode_seconds + F.col("reduce_seconds"))


def response_slices(models: DataFrame) -> DataFrame:
    """Where each model's responses lie when all are laid end to end in list order."""
    return running_offsets(models, "ord", "responses")
