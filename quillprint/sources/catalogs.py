"""Reading and writing the model catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.operators.catalog import rollup
from quillprint.session import path_exists

CATALOG_SCHEMA = """
    models array<struct<
        model_name string, model_family string, organization string, error string,
        architecture struct<type string, model_type string, is_generative boolean>,
        size struct<parameter_count bigint, parameter_count_billions double, size_category string, source string>,
        chat_model struct<is_chat_model boolean, chat_indicators array<string>, confidence string>,
        precision struct<default_dtype string, supports_quantization boolean>,
        repository struct<is_gated boolean, model_id string, local_path string>>>
"""


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of catalog files with their position. A missing file is an empty catalog."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CATALOG_SCHEMA).select(F.posexplode("models").alias("pos", "m")) \
            .select("pos", "m.*")
    documents = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    return documents.select(F.posexplode("models").alias("pos", "m")).select("pos", "m.*")


def last_entries(entries: DataFrame) -> DataFrame:
    """One entry per model name, the last one."""
    rest = [c for c in entries.columns if c not in ("model_name", "pos")]
    picked = entries.groupBy("model_name").agg(F.max_by(F.struct(*rest), "pos").alias("_e"))
    return picked.select("model_name", "_e.*")


def chat_flags(models: DataFrame, entries: DataFrame) -> DataFrame:
    """Chat flag of each model: that of its first catalog entry, false where there is none."""
    first = entries.groupBy("model_name").agg(F.min_by("chat_model.is_chat_model", "pos").alias("_flag"))
    return models.join(first, "model_name", "left").withColumn(
        "is_chat_model", F.coalesce("_flag", F.lit(False))).drop("_flag")


def write_catalog(classified: DataFrame, outcomes: DataFrame, path: str) -> None:
    """The catalog as three tables: models, statistics and outcomes. None of them passes through one task."""
    classified.write.mode("overwrite").json(f"{path}/models")
    rollup(classified).write.mode("overwrite").json(f"{path}/statistics")
    outcomes.write.mode("overwrite").json(f"{path}/outcomes")



def write_catalog_export(models: DataFrame, path: str) -> None:
    """One JSON object per line and model."""
    models.write.mode("overwrite").json(path)


def provider_export(catalog: DataFrame, provider: str) -> DataFrame:
    """Rows of the export of filtered models: id, provider, and what the catalog says about the model."""
    fields = [c for c in ("task", "downloads", "context_length", "modality") if c in catalog.columns]
    return catalog.select(F.col("model_name").alias("model_id"), F.lit(provider).alias("provider"), *fields)
