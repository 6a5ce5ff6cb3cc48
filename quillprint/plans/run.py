"""One run from a model list to committed signatures, summaries and rejects.

What a model answered may come from the cache or from generated responses; either way its answers are lined up with the
probe set, missing ones as empty texts. Models whose signature under the same settings is committed already are not computed
again, so a run that was cut short, or whose list has grown, does only the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.config import RunConfig
from quillprint.operators import filters
from quillprint.operators.models import split_cached
from quillprint.operators.responses import accepted_caches
from quillprint.plans import fingerprint
from quillprint.session import discard, settle
from quillprint.sources import batch_files, run_store, signature_files

SIGNATURES = ("model_name string, probe_count bigint, width int, components bigint, status string, "
              "signature array<double>, extraction_method string, probe_set_id string, source string")
SUMMARIES = "model_name string, summary string"
REJECTS = "model_name string, error string"
REQUESTS = "model_name string, probe_idx bigint, request string"
NO_RESPONSES = "no responses"


@dataclass(frozen=True)
class Run:
    """Results in list order, what has none and why, and what a generator still has to answer."""

    run: str
    results: DataFrame
    rejects: DataFrame
    requests: DataFrame


def probe_set(probes: DataFrame, config: RunConfig) -> DataFrame:
    """The first ``max_samples`` probes of the run's dataset, ``probe_idx, place, text``, with places from 0."""
    own = probes.where(F.col("dataset") == config.dataset)
    chosen = filters.first_by_position(own.select("probe_idx", "text"), config.max_samples)
    # at most max_samples rows
    rows = F.array_sort(F.collect_list(F.struct("probe_idx", "text")))
    return (chosen.agg(rows.alias("rows")).select(F.posexplode("rows").alias("place", "row"))
            .select("row.probe_idx", F.col("place").cast("bigint").alias("place"), "row.text"))


def settings_key(asked: DataFrame, config: RunConfig) -> str:
    """What a signature depends on besides the responses: the options that change it, and the probes."""
    probes = asked.agg(F.md5(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(
        " ", F.lpad(F.col("place").cast("string"), 12, "0"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))))
        .cast("binary"))).first()[0]
    return "-".join(str(x) for x in (config.dataset, config.dim, config.reduction, config.merge, config.seed,
                                     config.encoder, config.encoder_width, probes))


def line_up(answers: DataFrame, count: int) -> DataFrame:
    """Exactly ``count`` answers a model, at places 0 to ``count`` - 1: missing ones are empty texts, others drop out.

    Per model only the set of its places is gathered, at most ``count`` numbers; the answers are not.
    """
    known = answers.where(F.col("place").between(0, count - 1)).select(
        "model_name", "place", F.coalesce("response", F.lit("")).alias("response"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))
    held = F.collect_set(F.when(F.col("place").between(0, count - 1), F.col("place")))
    missing = answers.groupBy("model_name").agg(held.alias("held")).select(
        "model_name", F.explode(F.array_except(places, "held")).alias("place"), F.lit("").alias("response"))
    return known.unionByName(missing)


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _summary() -> Column:
    """The run summary of a model as JSON."""
    return F.to_json(F.struct("dataset", "dataset_full", "extractor_type", "dna_dimension", "reduction_method", "num_probes",
                              "total_time_seconds", "signature_stats", "output_file"), {"ignoreNullFields": "false"})


def full_run(spark: SparkSession, models: DataFrame, probes: DataFrame, config: RunConfig, root: str,
             generated: DataFrame | None = None, caches: DataFrame | None = None, failures: DataFrame | None = None,
             once_per_text: bool = True) -> Run:
    """Signatures of all listed models, written below ``root`` and committed together.

    ``models``: ``ord, model_name``; a name may be listed more than once and has a result at each place.
    ``probes``: ``dataset, probe_idx, text``; the first ``max_samples`` count, and two are the least.
    ``generated``: ``model_name, probe_idx, response``. ``caches``: ``model_name, dataset, complete, probe_idx, response``,
    used for the run's dataset as far as a model's cache is whole and not blank, and not at all without
    ``use_response_cache``. A model with a usable cache needs no generated responses. ``failures``: ``model_name, error``.

    A model is rejected if it failed, if nobody answered for it, or if its answers give no signature. Without
    ``continue_on_error`` any reject fails the run and nothing is committed; with it only a run without a result does.
    ``requests`` are the batch requests of the models that nobody answered for, of at most ``max_length`` tokens.
    """
    asked = settle(probe_set(probes, config), "asked")
    count = asked.count()
    if count < 2:
        raise ValueError("Probe set must contain at least two prompts for dimensionality reduction.")
    key = settings_key(asked, config)
    listed = models.select("model_name").distinct()
    done = run_store.read_table(spark, root, "signatures", SIGNATURES, key)
    failed = (failures if failures is not None else _empty(spark, REJECTS)).groupBy("model_name").agg(
        F.min("error").alias("error")).join(listed, "model_name", "left_semi")
    todo = settle(listed.join(done, "model_name", "left_anti").join(failed, "model_name", "left_anti"), "todo")

    # probe sets are bounded by max_samples; their positions become places by a small join
    answers = _empty(spark, "model_name string, probe_idx bigint, response string, source string")
    waiting = todo
    if config.use_response_cache and caches is not None:
        own = caches.where(F.col("dataset") == config.dataset).join(todo, "model_name", "left_semi")
        usable, waiting = split_cached(todo, accepted_caches(own, ["model_name"]), ["model_name"])
        answers = own.join(usable, "model_name", "left_semi").select(
            "model_name", "probe_idx", "response", F.lit("cache").alias("source"))
    if generated is not None:
        answers = answers.unionByName(generated.join(waiting, "model_name", "left_semi").select(
            "model_name", "probe_idx", "response", F.lit("generated").alias("source")))
    placed = settle(answers.join(F.broadcast(asked.select("probe_idx", "place")), "probe_idx", "left").select(
        "model_name", "place", "response", "source"), "answers")
    silent = todo.join(placed, "model_name", "left_anti")
    requests = batch_files.request_lines(silent.crossJoin(F.broadcast(asked)).select(
        "model_name", "probe_idx", F.col("text").alias("prompt")), max_length=config.max_length)

    lined = line_up(placed, count).withColumnRenamed("place", "probe_idx")
    outcome = fingerprint.from_responses(lined, config, once_per_text=once_per_text)
    sources = placed.groupBy("model_name").agg(F.min("source").alias("source"))
    fresh = outcome.signatures.join(sources, "model_name").select(
        *[name.split()[0] for name in SIGNATURES.split(", ")])
    rejects = settle(outcome.rejects.unionByName(failed).unionByName(
        silent.select("model_name", F.lit(NO_RESPONSES).alias("error"))), "rejects")

    if not config.continue_on_error:
        names = [r.model_name for r in rejects.orderBy("model_name").limit(20).collect()]
        if names:
            raise RuntimeError(f"Fingerprinting failed for model(s): {', '.join(names)}")
    run = run_store.new_run()
    run_store.write_table(fresh, root, run, "signatures")
    written = spark.read.schema(SIGNATURES).parquet(f"{root}/data/{run}/signatures")
    if written.isEmpty() and done.join(listed, "model_name", "left_semi").isEmpty():
        raise RuntimeError("Fingerprinting failed for all models.")
    summed = signature_files.summaries(written, config.dataset, config.dim, config.reduction, root=root)
    run_store.write_table(summed.select("model_name", _summary().alias("summary")), root, run, "summaries")
    run_store.write_table(rejects, root, run, "rejects")
    run_store.write_table(requests, root, run, "requests")
    run_store.commit(spark, root, run, settings=key)
    discard(asked, todo, placed, rejects)
    rejects, requests = (spark.read.schema(schema).parquet(f"{root}/data/{run}/{name}")
                         for name, schema in (("rejects", REJECTS), ("requests", REQUESTS)))
    whole = run_store.read_table(spark, root, "signatures", SIGNATURES, key)
    results = models.select("ord", "model_name").join(_one_each(whole), "model_name").orderBy("ord")
    return Run(run, results, rejects, requests)


def _one_each(signatures: DataFrame) -> DataFrame:
    """One row a model: two runs at the same time may both have computed it, with the same result."""
    columns = [c for c in signatures.columns if c not in ("model_name", "run")]
    return signatures.groupBy("model_name").agg(F.min_by(F.struct(*columns), "run").alias("s")).select("model_name", "s.*")


def save_documents(run: Run, path: str, reduction: str, merge: str, width: int) -> None:
    """The results' signature documents, one per model and line, names as they are (slashes too)."""
    once = run.results.drop("ord").dropDuplicates(["model_name"])
    signature_files.write_json(signature_files.with_metadata(once, reduction=reduction, merge=merge,
                                                             embedding_dimension=width), path)
