import numpy as np
import pytest
from pyspark.sql import functions as F

from quillprint.config import RunConfig
from quillprint.operators import reduce
from quillprint.plans import fingerprint

SCHEMA = "model_name string, probe_idx bigint, embedding array<float>"


def _frame(spark, models, partitions=4):
    rows = [(name, int(i), [float(x) for x in v]) for name, (idx, x) in models.items() for i, v in zip(idx, x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def _models():
    rng = np.random.default_rng(11)
    dense = {f"m{i}": (np.arange(p), rng.normal(size=(p, 12)).astype(np.float32)) for i, p in enumerate((2, 5, 40))}
    dense["gaps"] = (np.arange(30) * 7 + 3, rng.normal(size=(30, 12)).astype(np.float32))
    constant = rng.normal(size=(20, 12)).astype(np.float32)
    constant[:, 4] = 0.25
    dense["constant"] = (np.arange(20), constant)
    return dense


def _expected(x, dim, reduction, merge, seed=42):
    x = np.nan_to_num(x.astype(float), nan=0.0, posinf=0.0, neginf=0.0)
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(scale < 1e-12, 1.0, scale)
    k = min(len(x) - 1, x.shape[1], dim)
    if reduction == "random_projection":
        y = z @ np.random.RandomState(seed).normal(0, 1 / np.sqrt(k), (k, x.shape[1])).T
    else:
        v = np.linalg.svd(z, full_matrices=False)[2][:k]
        top = (np.abs(v) >= np.abs(v).max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)
        y = z @ (v * np.sign(v[np.arange(k), top])[:, None]).T
    flat = y.max(axis=0) if merge == "max" else y.ravel()
    return np.concatenate([flat, np.zeros(dim)])[:dim]


@pytest.mark.parametrize("merge", ["concat", "max"])
@pytest.mark.parametrize("reduction,merged", [("random_projection", 16), ("pca", 16), ("svd", 2)])
@pytest.mark.parametrize("dim", [4, 30])
def test_against_numpy(spark, monkeypatch, reduction, merged, merge, dim):
    monkeypatch.setattr(reduce, "MERGED", merged)
    models = _models()
    got = reduce.signatures(_frame(spark, models), dim, reduction, merge).collect()
    assert {r.model_name for r in got} == set(models)
    for r in got:
        assert r.status == "ok" and len(r.signature) == dim
        np.testing.assert_allclose(r.signature, _expected(models[r.model_name][1], dim, reduction, merge), atol=1e-6)


def test_same_result_on_any_partitioning(spark):
    models = _models()
    results = []
    for partitions in (1, 4, 16):
        rows = reduce.signatures(_frame(spark, models, partitions), 8, "random_projection", "concat").collect()
        results.append({r.model_name: np.array(r.signature) for r in rows})
    for other in results[1:]:
        for name, signature in results[0].items():
            np.testing.assert_allclose(other[name], signature, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("sent", [reduce.BROADCAST_BYTES, 0])
def test_one_model_with_most_rows(spark, monkeypatch, sent):
    monkeypatch.setattr(reduce, "BROADCAST_BYTES", sent)
    monkeypatch.setattr(reduce, "PART_ROWS", 100)
    rng = np.random.default_rng(2)
    models = {"hot": (np.arange(3000), rng.normal(size=(3000, 6)).astype(np.float32)),
              "cold": (np.arange(10), rng.normal(size=(10, 6)).astype(np.float32))}
    for reduction in ("random_projection", "pca"):
        got = reduce.signatures(_frame(spark, models, 8), 6, reduction, "max").collect()
        for r in got:
            np.testing.assert_allclose(r.signature, _expected(models[r.model_name][1], 6, reduction, "max"), atol=1e-5)


def test_two_probes_are_padded(spark):
    x = np.array([[1.0, 2, 3, 4, 5, 6], [2.0, 2, 1, 0, 5, 9]], dtype=np.float32)
    row = reduce.signatures(_frame(spark, {"m": ([0, 1], x)}), 4).first()
    assert row.components == 1 and row.signature[2:] == [0.0, 0.0] and row.signature[0] != 0.0


def test_nan_and_infinity_count_as_zero(spark):
    x = np.random.default_rng(1).normal(size=(6, 5)).astype(np.float32)
    x[0, 0], x[1, 1], x[2, 2] = np.nan, np.inf, -np.inf
    row = reduce.signatures(_frame(spark, {"m": (np.arange(6), x)}), 4).first()
    np.testing.assert_allclose(row.signature, _expected(x, 4, "random_projection", "concat"), atol=1e-6)


def test_rejects_and_degenerate_merges(spark):
    models = {"single": ([0], np.ones((1, 3))), "fine": (np.arange(4), np.random.default_rng(0).normal(size=(4, 3)))}
    df = _frame(spark, models).unionByName(spark.createDataFrame([("empty", 0, []), ("empty", 1, [])], SCHEMA))
    got = {r.model_name: r for r in reduce.signatures(df, 2).collect()}
    assert {n: r.status for n, r in got.items()} == {
        "single": "too_few_probes", "fine": "ok", "empty": "zero_width"}
    for merge in ("sum", "mean"):
        row = [r for r in reduce.signatures(df, 2, merge=merge).collect() if r.model_name == "fine"][0]
        assert row.status == "degenerate_merge" and row.signature is None
    with pytest.raises(ValueError):
        reduce.signatures(df, 2, reduction="lda")
    with pytest.raises(ValueError):
        reduce.signatures(df, 2, merge="median")


def test_constant_input_is_rejected_as_all_zero(spark):
    df = _frame(spark, {"flat": (np.arange(4), np.full((4, 3), 2.0))})
    outcome = fingerprint.from_embeddings(df, RunConfig(dim=4))
    assert outcome.signatures.count() == 0
    assert outcome.rejects.first().error == "all-zero signature"


def test_failure_policy(spark):
    responses = spark.createDataFrame(
        [("ok", i, f"word{i} some text {i * 7}") for i in range(5)], "model_name string, probe_idx bigint, response string")
    failures = spark.createDataFrame([("broken", "timeout")], "model_name string, error string")
    outcome = fingerprint.from_responses(responses, RunConfig(dim=4), failures)
    with pytest.raises(RuntimeError, match="broken"):
        fingerprint.apply_failure_policy(outcome)
    kept = fingerprint.apply_failure_policy(outcome, continue_on_error=True).collect()
    assert [r.model_name for r in kept] == ["ok"]
    assert kept[0].probe_set_id == "rand_5"
    assert kept[0].extraction_method == "text_response_embeddings_random_projection_concat"
    nothing = fingerprint.from_responses(responses.where("probe_idx = 0"), RunConfig(dim=4))
    with pytest.raises(RuntimeError, match="all models"):
        fingerprint.apply_failure_policy(nothing, continue_on_error=True)


def test_run_options_are_checked():
    with pytest.raises(ValueError, match="max_samples >= 2"):
        RunConfig(max_samples=1)
    with pytest.raises(ValueError, match="reduction"):
        RunConfig(reduction="tsne")


def test_other_encoder_by_name(spark):
    from quillprint.functions.encoders import encode_texts, register_encoder

    def by_length(width):
        return lambda texts: np.array([[len(t) % 11 + j for j in range(width)] for t in texts])

    register_encoder("by_length", by_length)
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    for once in (False, True):
        got = encode_texts(df, "t", "by_length", 3, once_per_text=once).orderBy("t").collect()
        assert [list(r.embedding) for r in got] == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError, match="Unknown encoder"):
        encode_texts(df, "t", "missing")


def test_default_width_of_hidden_state_runs(spark):
    states = spark.createDataFrame(
        [("m", p, t, int(t < 2), [float(p + t), float(p * t)]) for p in range(4) for t in range(3)],
        "model_name string, probe_idx bigint, tok_idx int, mask int, state array<double>")
    outcome = fingerprint.from_token_states(states)
    assert outcome.rejects.first().error == "degenerate_merge"
    from quillprint.operators import pooling
    last = {r.probe_idx: r.embedding for r in pooling.last_token(states).collect()}
    assert last == {p: [p + 1.0, float(p)] for p in range(4)}
    mean = {r.probe_idx: r.embedding for r in pooling.masked_mean(states).collect()}
    assert mean == {p: [p + 0.5, p / 2] for p in range(4)}
    unmasked = states.withColumn("mask", F.lit(0))
    assert pooling.last_token(unmasked).where("probe_idx = 3").first().embedding == [5.0, 6.0]
    assert pooling.masked_mean(unmasked).first().embedding == [0.0, 0.0]


def test_triangles_keep_small_spread_around_large_means(spark, monkeypatch):
    monkeypatch.setattr(reduce, "TRIANGLE_BYTES", 2000)
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(400, 5)) * [1, 1e-3, 1e-3, 1, 1] + rng.normal(size=(400, 1)) * [1e-1, 1e-3, 1e-3, 1, 2]
    models = {f"m{i}": (np.arange(400), spread + 1000.0 * i) for i in range(4)}
    rows = [(name, int(p), [float(v) for v in x]) for name, (at, xs) in models.items() for p, x in zip(at, xs)]
    frame = spark.createDataFrame(rows, "model_name string, probe_idx bigint, embedding array<double>").repartition(7)
    table = reduce.ModelTable.of(frame, ["model_name"], 3)
    found = {r.model_name: np.array(r.basis).reshape(3, 5) for r in reduce.principal_basis(frame, table).collect()}
    for name, (_, x) in models.items():
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        want = np.linalg.svd(z, full_matrices=False)[2][:3]
        want *= np.sign(want[np.arange(3), np.abs(want).argmax(axis=1)])[:, None]
        np.testing.assert_allclose(found[name], want, atol=1e-6)
        np.testing.assert_allclose(found[name] @ found[name].T, np.eye(3), atol=1e-10)


def test_settings_as_rows_give_what_single_runs_give(spark):
    models = _models()
    frame = _frame(spark, models)
    settings = {f"{r}-{m}-{d}-{s}": RunConfig(dim=d, reduction=r, merge=m, seed=s)
                for r, m, d, s in [("random_projection", "concat", 4, 42), ("random_projection", "concat", 30, 42),
                                   ("random_projection", "concat", 9, 7), ("random_projection", "max", 4, 7),
                                   ("random_projection", "max", 12, 42), ("pca", "concat", 5, 1), ("svd", "max", 3, 2),
                                   ("umap", "concat", 30, 3), ("random_projection", "sum", 4, 42)]}
    names = spark.createDataFrame([(m, s) for m in models for s in settings] + [(next(iter(models)), next(iter(settings)))],
                                  "model_name string, setting string")
    found = {(r.setting, r.model_name): r for r in fingerprint.with_settings(frame, names, settings).collect()}
    assert len(found) == len(models) * len(settings)
    for name, c in settings.items():
        for r in reduce.signatures(frame, c.dim, c.reduction, c.merge, c.seed).collect():
            got = found[name, r.model_name]
            assert (got.status, got.components, got.probe_count) == (r.status, r.components, r.probe_count)
            if r.signature is None:
                assert got.signature is None
            else:
                np.testing.assert_allclose(got.signature, r.signature, atol=1e-9)


def test_jobs_do_not_grow_with_settings(spark):
    frame = _frame(spark, _models())
    counts = []
    for n in (3, 50):
        settings = {f"s{i}": RunConfig(dim=2 + i % 9, seed=i % 2, merge="max" if i % 3 else "concat") for i in range(n)}
        named = spark.createDataFrame([(s,) for s in settings], "setting string")
        names = frame.select("model_name").distinct().crossJoin(named)
        spark.sparkContext.setJobGroup(f"settings-{n}", "")
        fingerprint.with_settings(frame, names, settings).write.format("noop").mode("overwrite").save()
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"settings-{n}")))
    spark.sparkContext._jsc.clearJobGroup()
    assert counts[0] == counts[1] > 0


def test_encoders_take_texts_a_few_at_a_time(spark):
    from pyspark.util import PythonEvalType

    from quillprint.functions import encoders
    # Arrow arrays are cut and turned into texts slice by slice; a series would hold all texts of a batch
    assert encoders.encoder_udf("hashed_words", 4).evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
    texts = spark.createDataFrame([(i, None if i % 9 == 0 else f"w{i} " * (i % 5)) for i in range(100)], "id int, text string")
    got = {r.id: r.embedding for r in encoders.encode_texts(texts.coalesce(1), "text", width=4).collect()}
    plain = encoders.hashed_words(4)
    assert all(got[i] == plain([f"w{i} " * (i % 5) if i % 9 else ""])[0].tolist() for i in range(100))


def test_token_ids_are_made_once(spark):
    from quillprint.operators import pooling
    texts = spark.createDataFrame([(1, "a b"), (2, "b")], "text_id int, text string").select("text_id", F.transform(
        F.split("text", " "), lambda w: F.length(F.md5(w.cast("binary"))).cast("bigint") - 32).alias("token_ids"))
    words = spark.createDataFrame([(0, [1.0])], "token_id bigint, embedding array<float>")
    found = pooling.token_embeddings(texts, words, 1)
    assert "md5" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.text_id, r.pos) for r in found.collect()) == [(1, 0), (1, 1), (2, 0)]
