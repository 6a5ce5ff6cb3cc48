"""All registered queries: a Spark job on the given tables and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def load() -> dict[str, tuple[Query, str | None]]:
    from quillprint.plans.registry import (catalogs, files, probe_sets, reductions, responses, streams, texts, vectors)

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (vectors, reductions, texts, catalogs, responses, probe_sets, files, streams):
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"Query registered twice: {name}")
            found[name] = entry
    return found
