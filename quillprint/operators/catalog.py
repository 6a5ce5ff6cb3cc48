"""The model catalog: classification of every model and its rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillprint.functions import batch_json, names


def classify(models: DataFrame) -> DataFrame:
    """Family, organization, architecture, size, chat status and precision of each model, as nested fields.

    Input: ``model_name``, and optionally ``config`` (JSON text), ``has_tokenizer_template``, ``is_gated``,
    ``error``. A row with an error keeps it and gets no classification.
    """
    df = models
    for column, kind in (("config", "string"), ("has_tokenizer_template", "boolean"), ("is_gated", "boolean"),
                         ("error", "string")):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast(kind))
    df = df.withColumn("_config", batch_json.parse(F.col("config")))
    config, name = F.col("_config"), F.col("model_name")
    class_name = batch_json.string_field(config, "architectures[0]")
    model_type = batch_json.string_field(config, "model_type")
    template = batch_json.string_field(config, "chat_template")
    df = (df.withColumn("_class", class_name).withColumn("_type", model_type)
          .withColumn("_template", F.coalesce(template != "", F.lit(False))))
    available = config.isNotNull()
    architecture = F.when(available, names.catalog_architecture(F.col("_class"), F.col("_type"))) \
        .otherwise(F.lit("unknown"))
    df = df.withColumn("_arch", architecture)
    source = names.family_and_organization(name, F.col("_type"))
    fields = {
        "model_family": source["family"],
        "organization": source["organization"],
        "architecture": F.struct(
            F.col("_arch").alias("type"), F.coalesce(F.col("_type"), F.when(available, F.lit("")), F.lit("unknown"))
            .alias("model_type"), names.is_generative(F.col("_arch")).alias("is_generative")),
        "size": names.parameter_info(name, config),
        "chat_model": names.chat_info(name, F.col("has_tokenizer_template"), F.col("_template")),
        "precision": F.struct(
            F.coalesce(batch_json.string_field(config, "torch_dtype"), F.when(available, F.lit("float32")),
                       F.lit("unknown")).alias("default_dtype"),
            (F.col("_arch") == "decoder_only").alias("supports_quantization")),
        "repository": F.struct(F.col("is_gated")),
    }
    good = F.col("error").isNull()
    return df.select("model_name", "error", *[F.when(good, c).alias(n) for n, c in fields.items()])


def default_metadata(models: DataFrame) -> DataFrame:
    """What is said about a model when only its name is known."""
    name = F.col("model_name")
    arch = F.coalesce(names.family(name)["architecture"], F.lit("decoder_only"))
    info = names.parameter_info(name)
    return models.select(
        "model_name", arch.alias("architecture_type"), names.is_generative(arch).alias("is_generative"),
        info["parameter_count"].alias("parameter_count"),
        info["parameter_count_billions"].alias("parameter_count_billions"),
        names.has_chat_name(name).alias("is_chat_model"))


def rollup(classified: DataFrame) -> DataFrame:
    """Counts by architecture, size and organization, and chat and gated totals, in one pass: ``kind, value, n``."""
    def entry(kind: str, value) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    entries = F.array(
        entry("architecture", F.col("architecture.type")), entry("size", F.col("size.size_category")),
        entry("organization", F.col("organization")),
        F.when(F.col("chat_model.is_chat_model"), entry("chat_models", F.lit("all"))),
        F.when(F.col("repository.is_gated"), entry("gated_models", F.lit("all"))))
    good = classified.where(F.col("error").isNull())
    return (good.select(F.explode(F.array_compact(entries)).alias("e")).groupBy("e.kind", "e.value")
            .agg(F.count(F.lit(1)).alias("n")))


def outcome_counts(results: DataFrame) -> DataFrame:
    """Successful, failed and skipped runs, and the failure messages are the rows with an error."""
    return results.agg(
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"), F.count(F.lit(1)).alias("total"))


def outcomes(requested: DataFrame, existing: DataFrame, classified: DataFrame) -> DataFrame:
    """Status of every requested model: skipped where an entry exists, failed where it has an error."""
    done = existing.select("model_name").distinct().withColumn("_exists", F.lit(True))
    state = classified.select("model_name", "error")
    status = (F.when(F.col("_exists"), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("success"))
    return (requested.join(done, "model_name", "left").join(state, "model_name", "left")
            .select("model_name", status.alias("status"),
                    F.when(status == "failed", F.col("error")).alias("error")))
