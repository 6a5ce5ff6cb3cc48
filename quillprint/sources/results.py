"""Generic result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("json", "parquet")


def _format(path: str, fmt: str) -> str:
    chosen = path.rsplit(".", 1)[-1].lower() if fmt == "auto" else fmt
    if chosen not in FORMATS:
        raise ValueError(f"Unsupported format: {chosen}. Use one of {', '.join(FORMATS)}")
    return chosen


def save_results(df: DataFrame, path: str, fmt: str = "auto") -> None:
    df.write.mode("overwrite").format(_format(path, fmt)).save(path)


def load_results(spark: SparkSession, path: str, schema=None, fmt: str = "auto") -> DataFrame:
    """A saved result; give the schema of a JSON result to spare the pass that infers it."""
    reader = spark.read.format(_format(path, fmt))
    return (reader.schema(schema) if schema is not None else reader).load(path)
