"""A folder of finished runs: tables are written aside and count only once the run's manifest stands.

``<root>/data/<run>/<table>`` holds what a run wrote, ``<root>/manifests/<run>.json`` says that it is whole. A manifest is
written under another name and renamed, which a file system does as one step; so a run that dies leaves files that nobody
reads, and readers see a run's tables all together or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.session import any_path, write_whole


def new_run() -> str:
    return uuid.uuid4().hex


def write_table(rows: DataFrame, root: str, run: str, table: str) -> None:
    """First phase: a table of a run that nobody reads yet."""
    rows.write.parquet(f"{root}/data/{run}/{table}")


def commit(spark: SparkSession, root: str, run: str, **facts: str | int) -> None:
    """Second phase: the manifest, put in place by a rename. A run that stands already cannot be committed again."""
    write_whole(spark, f"{root}/manifests/{run}.json", json.dumps({"run": run, **facts}))


def committed(spark: SparkSession, root: str) -> DataFrame:
    """``run, settings``: the runs that are whole, with the key of what they computed."""
    if not any_path(spark, f"{root}/manifests/*.json"):
        return spark.createDataFrame([], "run string, settings string")
    return spark.read.schema("run string, settings string").json(f"{root}/manifests/*.json")


def read_table(spark: SparkSession, root: str, table: str, schema: str, settings: str | None = None) -> DataFrame:
    """Rows of a table of all committed runs (of one key of settings), with their ``run``."""
    pattern = f"{root}/data/*/{table}"
    if not any_path(spark, pattern):
        return spark.createDataFrame([], f"{schema}, run string")
    runs = committed(spark, root)
    if settings is not None:
        runs = runs.where(F.col("settings") == settings)
    rows = spark.read.schema(schema).parquet(pattern).withColumn(
        "run", F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]+)/[^/]+/[^/]+$", 1))
    return rows.join(runs.select("run"), "run", "left_semi").select(*rows.columns)
