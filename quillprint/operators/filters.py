"""Row filters on probes, models and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions import names, text, vectors


def non_blank_probes(probes: DataFrame, column: str = "text") -> DataFrame:
    return probes.where(text.has_text(F.col(column)))



def generative_models(models: DataFrame, flag: str | Column = "is_generative") -> DataFrame:
    """Drops models that are marked as not generative; an unknown mark is kept."""
    column = F.col(flag) if isinstance(flag, str) else flag
    return models.where(~column.eqNullSafe(F.lit(False)))


def by_name_patterns(models: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None,
                     column: str = "model_name") -> DataFrame:
    """Any include pattern (when a list is given) and no exclude pattern, case-sensitive."""
    kept = models
    if include is not None:
        kept = kept.where(text.any_contained(F.col(column), include))
    if exclude:
        kept = kept.where(~text.any_contained(F.col(column), exclude))
    return kept


def by_method(signatures: DataFrame, method: str, column: str = "extraction_method") -> DataFrame:
    return signatures.where(F.col(column) == method)


def text_to_text_models(catalog: DataFrame) -> DataFrame:
    """Models that read and write text, with the modality written out."""
    both = (F.array_contains("input_modalities", "text")
            & F.array_contains("output_modalities", "text"))
    modality = F.concat(F.array_join("input_modalities", "|"), F.lit(" -> "), F.array_join("output_modalities", "|"))
    return catalog.where(both).withColumn("modality", modality)


def most_downloaded(catalog: DataFrame, n: int = fixed.CATALOG_TARGET, tasks: list[str] | None = None) -> DataFrame:
    """Text generation models by downloads, first n. Ties go by name, so the cut is the same on every run."""
    wanted = catalog.where(F.col("task").isin(tasks or fixed.CATALOG_TASKS))
    return wanted.orderBy(F.desc("downloads"), "model_name").limit(n)


def valid_probes(probes: DataFrame, column: str = "text") -> DataFrame:
    return probes.where(text.is_valid_probe(F.col(column)))


def first_by_position(probes: DataFrame, n: int, order: str = "probe_idx") -> DataFrame:
    """The first n rows in input order."""
    return probes.orderBy(order).limit(n)


def supported_models(models: DataFrame, column: str = "model_name") -> DataFrame:
    return models.where(~names.is_unsupported(F.col(column)))


def split_valid_signatures(signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signatures that can be used, and rejects with the reason."""
    good = vectors.is_valid_signature(F.col("signature"))
    empty = F.col("signature").isNull() | (F.size("signature") == 0)
    reason = F.when(empty, F.lit("empty signature")).otherwise(F.lit("all-zero signature"))
    return signatures.where(good), signatures.where(~good).withColumn("error", reason)
