"""Text lines with their position in the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.functions.text import has_text, strip
from quillprint.operators.ordering import number_blocks


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value`` of text files, numbered through in file name order. A task numbers one file split, so
    a large file stays split."""
    return number_blocks(_raw_lines(spark, path), ["file", "_start"], ["_row"], "line_no").select(
        "file", "line_no", "value")


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"))


def read_model_list(spark: SparkSession, path: str, raw_comments: bool = False) -> DataFrame:
    """Model names of a list file, in order: ``ord, model_name``. Blank lines and comments drop out, and the names that
    are left are numbered from 0 without gaps.

    ``raw_comments`` looks for the comment sign before stripping, as the catalog job does.
    """
    lines = _raw_lines(spark, path)
    name = strip(F.col("value"))
    comment = F.startswith(F.col("value") if raw_comments else name, F.lit("#"))
    kept = lines.where(has_text(F.col("value")) & ~comment)
    return number_blocks(kept, ["file", "_start"], ["_row"], "ord").select("ord", name.alias("model_name"))


def require_models(models: DataFrame, path: str) -> DataFrame:
    if models.isEmpty():
        raise ValueError(f"No valid model names found in {path}")
    return models


def choose_models(spark: SparkSession, items: list[str] | None = None, models_file: str | None = None,
                  default_file: str | None = None, max_models: int | None = None) -> DataFrame:
    """Input of the catalog job: names given directly (each may hold several, comma-separated), else a file, else the
    default list; the first ``max_models`` of them."""
    if items:
        names = [name.strip() for item in items for name in item.split(",")]
        models = spark.createDataFrame(list(enumerate(n for n in names if n)), "ord bigint, model_name string")
    else:
        path = models_file or default_file
        if path is None:
            raise ValueError("No models given")
        models = read_model_list(spark, path, raw_comments=True)
    return models.orderBy("ord").limit(max_models) if max_models else models
