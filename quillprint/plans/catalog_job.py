"""Catalog of all requested models: classify new ones, keep existing entries, roll up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillprint.operators import catalog
from quillprint.operators.models import add_new_entries


@dataclass(frozen=True)
class CatalogResult:
    entries: DataFrame
    statistics: DataFrame
    outcomes: DataFrame


def build_catalog(models: DataFrame, existing: DataFrame | None = None) -> CatalogResult:
    """``models`` as :func:`quillprint.operators.catalog.classify` takes them; with ``existing`` entries, only
    models without one are classified."""
    fresh = models if existing is None else models.join(existing, "model_name", "left_anti")
    classified = catalog.classify(fresh)
    kept = classified.limit(0) if existing is None else existing
    entries = classified if existing is None else add_new_entries(existing, classified)
    return CatalogResult(entries, catalog.rollup(entries), catalog.outcomes(models.select("model_name"), kept,
                                                                            classified))
