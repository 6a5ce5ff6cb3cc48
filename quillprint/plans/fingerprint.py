"""Responses or token states to signatures, end to end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.config import RunConfig
from quillprint.functions import text as fn
from quillprint.functions.encoders import encode_texts
from quillprint.operators import filters, pooling, reduce
from quillprint.session import settle


@dataclass(frozen=True)
class Outcome:
    """Signatures of the models that have one, and the others with the reason."""

    signatures: DataFrame
    rejects: DataFrame


def _outcome(reduced: DataFrame) -> Outcome:
    # one row a model; signatures, rejects and the policy all read it
    reduced = settle(reduced, "reduced")
    good, bad = filters.split_valid_signatures(reduced)
    reason = F.when(F.col("status") == reduce.OK, F.col("error")).otherwise(F.col("status"))
    return Outcome(good, bad.withColumn("error", reason))


def from_embeddings(embeddings: DataFrame, config: RunConfig, keys: list[str] | None = None) -> Outcome:
    return _outcome(reduce.signatures(embeddings, config.dim, config.reduction, config.merge, config.seed, keys))


def from_responses(responses: DataFrame, config: RunConfig, failures: DataFrame | None = None,
                   once_per_text: bool = False) -> Outcome:
    """Encode all responses in one pass, then one signature per model, with its identifiers.

    ``failures`` (``model_name, error``) are models whose generation failed upstream; they become rejects.
    """
    embedded = encode_texts(responses, "response", config.encoder, config.encoder_width, once_per_text)
    # the encoder runs once, though moments and projection both read its output
    stored = settle(embedded.select("model_name", "probe_idx", "embedding"), "embeddings")
    outcome = from_embeddings(stored, config)
    named = outcome.signatures.select(
        "*", F.lit(config.extraction_method).alias("extraction_method"),
        fn.probe_set_id(F.lit(config.dataset), F.col("probe_count")).alias("probe_set_id"))
    rejects = outcome.rejects.select("model_name", "error")
    if failures is not None:
        rejects = rejects.unionByName(failures.select("model_name", "error"))
    return Outcome(named, rejects)


def for_model(responses: DataFrame, model_name: str, config: RunConfig) -> Outcome:
    """One model: the same job on its rows only."""
    return from_responses(responses.where(F.col("model_name") == model_name), config)


def settings_table(spark: SparkSession, settings: dict[str, RunConfig]) -> DataFrame:
    """Settings as rows: ``setting, dim, reduction, merge, seed``."""
    return spark.createDataFrame([(name, c.dim, c.reduction, c.merge, c.seed) for name, c in settings.items()],
                                 "setting string, dim int, reduction string, merge string, seed bigint")


def with_settings(embeddings: DataFrame, assignments: DataFrame, settings: dict[str, RunConfig] | DataFrame) -> DataFrame:
    """Signatures under different settings: ``assignments`` says which setting (by name) each model runs under.

    ``settings`` is a table of them (see :func:`settings_table`), or configurations by name. A model assigned to several
    settings gets one signature for each; an assignment named twice counts once. The jobs are the same for any number.
    """
    table = settings if isinstance(settings, DataFrame) else settings_table(embeddings.sparkSession, settings)
    wanted = assignments.select("model_name", "setting").distinct().join(table, "setting")
    return reduce.signatures_by_setting(embeddings, wanted).select(
        "setting", "model_name", "probe_count", "width", "components", "status", "signature")


def apply_failure_policy(outcome: Outcome, continue_on_error: bool = False) -> DataFrame:
    """Signatures that may be saved. Without ``continue_on_error`` any reject fails the run; with it only a run
    without a single signature does. Reports at most a few names of what may be many rejects."""
    if not continue_on_error:
        names = [r.model_name for r in outcome.rejects.select("model_name").limit(20).collect()]
        if names:
            raise RuntimeError(f"Fingerprinting failed for model(s): {', '.join(names)}")
    if outcome.signatures.isEmpty():
        raise RuntimeError("Fingerprinting failed for all models.")
    return outcome.signatures


def from_token_states(states: DataFrame, pooling_rule: str = "last_token", dim: int = 256, reduction: str = "pca",
                      merge: str = "sum", seed: int = 42) -> Outcome:
    """The older form: hidden states of the probe itself, pooled per probe, then reduced."""
    rules = {"last_token": pooling.last_token, "masked_mean": pooling.masked_mean}
    if pooling_rule not in rules:
        raise ValueError(f"Unknown pooling rule: {pooling_rule}. Known: {', '.join(rules)}")
    pooled = settle(rules[pooling_rule](states), "pooled")
    return _outcome(reduce.signatures(pooled, dim, reduction, merge, seed))


EXTRACTORS = {"responses": from_responses, "embeddings": from_embeddings}


def register_extractor(name: str, extractor: callable) -> None:
    """Make ``extractor(df, config) -> Outcome`` available by name."""
    EXTRACTORS[name] = extractor


def extract(kind: str, df: DataFrame, config: RunConfig) -> Outcome:
    if kind not in EXTRACTORS:
        raise ValueError(f"Unknown extractor: {kind}. Known: {', '.join(EXTRACTORS)}")
    return EXTRACTORS[kind](df, config)
