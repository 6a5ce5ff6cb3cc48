"""Whole runs: resuming, failing, committing, what a run is asked for."""

import json

import pytest
from pyspark.sql import functions as F

from quillprint.config import RunConfig
from quillprint.plans import run
from quillprint.session import scratch_path
from quillprint.sources import run_store, signature_files

CONFIG = RunConfig(dataset="d", dim=6, encoder_width=8, max_samples=4, continue_on_error=True)


@pytest.fixture
def inputs(spark):
    probes = spark.createDataFrame([("d", 10 * i, f"question {i}") for i in range(6)] + [("other", 0, "not asked")],
                                   "dataset string, probe_idx bigint, text string")
    generated = spark.createDataFrame(
        [(m, 10 * i, f"{m} says {'word ' * i} {i}") for m in ("org/a", "b", "c") for i in range(6 if m != "b" else 2)],
        "model_name string, probe_idx bigint, response string")
    caches = spark.createDataFrame(
        [("c", "d", True, 10 * i, f"cached {i} {'x ' * i}") for i in range(4)] + [("b", "d", False, 0, "unfinished")]
        + [("org/a", "other", True, 0, "another set")],
        "model_name string, dataset string, complete boolean, probe_idx bigint, response string")
    models = spark.createDataFrame([(0, "org/a"), (1, "b"), (2, "silent"), (3, "c"), (4, "org/a"), (5, "broken")],
                                   "ord bigint, model_name string")
    failures = spark.createDataFrame([("broken", "out of memory"), ("unlisted", "x")], "model_name string, error string")
    return models, probes, generated, caches, failures


def test_results_in_list_order_and_the_rest_with_reasons(spark, inputs):
    models, probes, generated, caches, failures = inputs
    root = scratch_path(spark, "runs")
    made = run.full_run(spark, models, probes, CONFIG, root, generated, caches, failures)
    rows = made.results.collect()
    assert [(r.ord, r.model_name, r.source) for r in rows] == [
        (0, "org/a", "generated"), (1, "b", "generated"), (3, "c", "cache"), (4, "org/a", "generated")]
    assert rows[0].signature == rows[3].signature and {r.probe_count for r in rows} == {4}
    assert {r.probe_set_id for r in rows} == {"d_4"}
    assert {(r.model_name, r.error) for r in made.rejects.collect()} == {
        ("silent", "no responses"), ("broken", "out of memory")}
    asked = made.requests.orderBy("probe_idx").collect()
    assert [(r.model_name, r.probe_idx) for r in asked] == [("silent", 10 * i) for i in range(4)]
    assert json.loads(asked[0].request)["body"]["max_tokens"] == CONFIG.max_length
    summary = run_store.read_table(spark, root, "summaries", run.SUMMARIES).where("model_name = 'org/a'").first()
    assert json.loads(summary.summary)["output_file"].endswith("/d/org_a/org_a_dna.json")
    path = scratch_path(spark, "documents")
    run.save_documents(made, path, CONFIG.reduction, CONFIG.merge, CONFIG.encoder_width)
    assert {r.model_name for r in signature_files.read_json(spark, path).collect()} == {"org/a", "b", "c"}


def test_a_repeated_run_does_only_the_rest(spark, inputs, monkeypatch):
    models, probes, generated, caches, failures = inputs
    root = scratch_path(spark, "runs")
    first = run.full_run(spark, models.where("ord < 2"), probes, CONFIG, root, generated, caches, failures)
    computed = []
    plain = run.fingerprint.from_responses
    monkeypatch.setattr(run.fingerprint, "from_responses", lambda rows, *a, **k: (
        computed.append({r.model_name for r in rows.select("model_name").distinct().collect()}), plain(rows, *a, **k))[1])
    second = run.full_run(spark, models, probes, CONFIG, root, generated, caches, failures)
    assert computed == [{"c"}]
    before = {r.model_name: r.signature for r in first.results.collect()}
    after = {r.model_name: r.signature for r in second.results.collect()}
    assert set(after) == {"org/a", "b", "c"} and all(after[m] == s for m, s in before.items())
    # other settings are another signature
    run.full_run(spark, models, probes, RunConfig(**{**CONFIG.__dict__, "dim": 5}), root, generated, caches, failures)
    assert computed[-1] == {"org/a", "b", "c"}


def test_without_the_cache_and_without_tolerance(spark, inputs):
    models, probes, generated, caches, failures = inputs
    root = scratch_path(spark, "runs")
    strict = RunConfig(**{**CONFIG.__dict__, "continue_on_error": False})
    with pytest.raises(RuntimeError, match="broken, silent"):
        run.full_run(spark, models, probes, strict, root, generated, caches, failures)
    assert run_store.committed(spark, root).count() == 0
    uncached = RunConfig(**{**CONFIG.__dict__, "use_response_cache": False})
    fresh = run.full_run(spark, models, probes, uncached, root, generated, caches, failures)
    assert {r.source for r in fresh.results.collect()} == {"generated"}
    with pytest.raises(RuntimeError, match="all models"):
        run.full_run(spark, models.where("model_name = 'silent'"), probes, CONFIG, scratch_path(spark, "runs"))
    with pytest.raises(ValueError, match="two prompts"):
        run.full_run(spark, models, probes.where("probe_idx = 0"), CONFIG, root, generated)


def test_only_committed_runs_are_read(spark):
    root = scratch_path(spark, "runs")
    rows = spark.createDataFrame([("m", "why")], run.REJECTS)
    whole, torn = run_store.new_run(), run_store.new_run()
    for name in (whole, torn):
        run_store.write_table(rows, root, name, "rejects")
    assert run_store.read_table(spark, root, "rejects", run.REJECTS).count() == 0
    run_store.commit(spark, root, whole, settings="k")
    assert [r.run for r in run_store.read_table(spark, root, "rejects", run.REJECTS).collect()] == [whole]
    assert run_store.read_table(spark, root, "rejects", run.REJECTS, "other").count() == 0
    with pytest.raises(FileExistsError):
        run_store.commit(spark, root, whole, settings="k")


def test_answers_are_lined_up(spark):
    answers = spark.createDataFrame([("a", 0, "x"), ("a", 2, None), ("a", 9, "surplus"), ("b", None, "nowhere")],
                                    "model_name string, place bigint, response string")
    got = {(r.model_name, r.place): r.response for r in run.line_up(answers, 3).collect()}
    assert got == {("a", 0): "x", ("a", 1): "", ("a", 2): "", ("b", 0): "", ("b", 1): "", ("b", 2): ""}


def test_empty_list_of_models(spark, inputs):
    _, probes, generated, caches, _ = inputs
    models = spark.createDataFrame([], "ord bigint, model_name string")
    with pytest.raises(RuntimeError, match="all models"):
        run.full_run(spark, models, probes, CONFIG, scratch_path(spark, "runs"), generated, caches)
