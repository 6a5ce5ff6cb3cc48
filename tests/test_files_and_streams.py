import json
import os

import pytest
from pyspark.sql import functions as F

from quillprint.sources import batch_files, catalogs, datasets, results, signature_files as io
from quillprint.session import scratch_path
from quillprint.streaming import texts as st


def _signatures(spark):
    return spark.createDataFrame([("a/b", [1.0, 2.5, -3.0]), ("c", [0.0, 1e-3, 2.0])],
                                 "model_name string, signature array<double>")


def test_json_keeps_metadata_and_refuses_nan(spark):
    path = scratch_path(spark, "sig")
    io.write_json(io.with_metadata(_signatures(spark), "x_y", "rand_3"), path)
    back = {r.model_name: r for r in io.read_json(spark, path).collect()}
    assert back["a/b"].signature == [1.0, 2.5, -3.0] and back["a/b"].metadata.dna_dimension == 3
    assert back["c"].metadata.extraction_method == "x_y" and back["c"].metadata.probe_set_id == "rand_3"
    bad = spark.createDataFrame([("n", [float("nan")])], "model_name string, signature array<double>")
    with pytest.raises(Exception, match="cannot express"):
        io.write_json(io.with_metadata(bad), scratch_path(spark, "sig"))


def test_csv_forms(spark, tmp_path):
    (tmp_path / "org_m_dna.csv").write_text("dna_value\n1.5\n-2\n0.25\n")
    (tmp_path / "k_dna.json").write_text(json.dumps({"signature": [4.0], "metadata": {"model_name": "k"}}))
    (tmp_path / "x_dna.json").write_text("broken")
    got = {r.model_name: r.signature for r in io.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"org_m": [1.5, -2.0, 0.25], "k": [4.0]}
    (tmp_path / "wide.csv").write_text("model_name,dna_0,other,dna_1\nm,1,9,2\nn,3,9,\n")
    rows = {r.model_name: r.signature for r in io.read_wide_csv(spark, str(tmp_path / "wide.csv")).collect()}
    assert rows["m"] == [1.0, 2.0] and rows["n"][0] == 3.0 and rows["n"][1] != rows["n"][1]


def test_catalog_lookups(spark, tmp_path):
    file = tmp_path / "catalog.json"
    entry = lambda flag, org: {"model_name": "m", "organization": org, "chat_model": {"is_chat_model": flag}}
    file.write_text(json.dumps({"metadata": {}, "models": [entry(True, "first"), entry(False, "last")]}, indent=2))
    entries = catalogs.read_catalog(spark, str(file))
    assert [r.organization for r in catalogs.last_entries(entries).collect()] == ["last"]
    models = spark.createDataFrame([("m",), ("other",)], "model_name string")
    assert {r.model_name: r.is_chat_model for r in catalogs.chat_flags(models, entries).collect()} == {
        "m": True, "other": False}
    assert catalogs.read_catalog(spark, str(tmp_path / "none.json")).count() == 0


def test_result_formats(spark):
    df = spark.range(3)
    for fmt in ("json", "parquet"):
        path = scratch_path(spark, "r") + "." + fmt
        results.save_results(df, path)
        assert results.load_results(spark, path, df.schema).count() == 3
    with pytest.raises(ValueError, match="Unsupported format"):
        results.save_results(df, "/tmp/x.yaml")


def test_embedding_cache_encodes_only_what_is_missing(spark):
    path = scratch_path(spark, "emb")
    seen = []

    def encode(df):
        seen.append(df.count())
        return df.withColumn("embedding", F.array(F.col("probe_idx").cast("float")))

    texts = spark.range(10).select(F.col("id").alias("probe_idx"), F.lit("t").alias("text"))
    datasets.cached_embeddings(texts.where("probe_idx < 4"), path, encode, ["probe_idx"])
    assert datasets.cached_embeddings(texts, path, encode, ["probe_idx"]).count() == 10
    datasets.cached_embeddings(texts, path, encode, ["probe_idx"])
    assert seen == [4, 6, 0]


def _arrivals(spark, folder, rows):
    spark.createDataFrame(rows, "model_name string, probe_idx bigint, at timestamp").coalesce(1).write.mode(
        "append").parquet(folder)


def test_progress_over_several_runs(spark):
    """Every run goes on from the checkpoint; repeats, however late, odd positions and compaction change nothing."""
    import datetime
    base = scratch_path(spark, "stream")
    at = datetime.datetime(2024, 1, 1)
    schema = "model_name string, probe_idx bigint, at timestamp"

    def advance():
        arriving = spark.readStream.schema(schema).parquet(f"{base}/in")
        progress = st.response_progress(arriving, 3, most=70)
        st.track_progress(progress, f"{base}/out", f"{base}/check", compact_every=2).awaitTermination()
        return {r.model_name: (r["count"], r.complete) for r in st.latest_progress(spark, f"{base}/out").collect()}

    assert st.latest_progress(spark, f"{base}/out").count() == 0
    _arrivals(spark, f"{base}/in", [("a", 0, at), ("a", 0, at), ("b", 0, at)])
    assert advance() == {"a": (1, False), "b": (1, False)}
    _arrivals(spark, f"{base}/in", [("a", 1, at), ("a", 69, at), ("b", 0, at), ("c", 70, at), ("c", -1, at), ("c", None, at)])
    assert advance() == {"a": (3, True), "b": (1, False)}
    _arrivals(spark, f"{base}/in", [("a", 0, at + datetime.timedelta(days=900)), ("c", 5, at)])
    assert advance() == {"a": (3, True), "b": (1, False), "c": (1, False)}
    _arrivals(spark, f"{base}/in", [("b", 1, at)])
    assert advance() == {"a": (3, True), "b": (2, False), "c": (1, False)}
    assert st._numbers(spark, f"{base}/out", "whole", True) == [1, 3]


@pytest.mark.parametrize("n", [0, 1, 7, 12, 13, 99])
def test_first_rows_of_a_stream_with_gaps(spark, n):
    base = scratch_path(spark, "stream")
    schema = "id bigint, text string"

    def arrive(ids):
        spark.createDataFrame([(i, f"t{i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        texts = st.stream_texts(spark, f"{base}/in", spark.createDataFrame([], schema).schema, "text", "id", files_per_batch=1)
        st.append_first(texts, n, f"{base}/out", f"{base}/check").awaitTermination()
        return sorted(r.probe_idx for r in st.first_texts(spark, f"{base}/out", texts.schema).collect())

    first, second = [3 * i + 100 for i in range(8)], [7 * i for i in range(5)]
    arrive(first)
    assert run() == first[:n]
    arrive(second)
    assert run() == sorted(first[:n] + second[:max(0, n - 8)])
    assert run() == sorted(first[:n] + second[:max(0, n - 8)])


def test_text_stream_needs_its_column_and_resumes(spark):
    base = scratch_path(spark, "stream")
    frame = spark.range(20).select("id", F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    frame.where("id < 12").write.parquet(f"{base}/in")
    with pytest.raises(ValueError, match="Text column"):
        st.stream_texts(spark, f"{base}/in", frame.schema, "body", "id")

    def run():
        texts = st.stream_texts(spark, f"{base}/in", frame.schema, "text", "id", below=15, files_per_batch=1)
        st.append_embeddings(texts, f"{base}/out", f"{base}/check", width=8).awaitTermination()
        return spark.read.parquet(f"{base}/out").count()

    assert run() == 12
    frame.where("id >= 12").write.mode("append").parquet(f"{base}/in")
    assert run() == 15


def test_callback_sees_every_response(spark):
    base = scratch_path(spark, "stream")
    spark.range(9).write.parquet(f"{base}/in")
    counts = []
    stream = spark.readStream.schema("id bigint").parquet(f"{base}/in")
    st.each_response(stream, lambda df, _: counts.append(df.count()), f"{base}/check").awaitTermination()
    assert sum(counts) == 9


def test_signatures_by_kind_of_path(spark, tmp_path):
    rows = [("a/b", [1.0, 2.0]), ("a_b", [3.0, 4.0])]
    frame = spark.createDataFrame(rows, "model_name string, signature array<double>")
    io.write_wide_csv(frame, f"{tmp_path}/wide.csv", 2)
    io.write_value_csv(frame, f"{tmp_path}/folder")
    io.write_json(io.with_metadata(frame), f"{tmp_path}/all.json")
    for name in ("wide.csv", "folder", "all.json"):
        found = io.read_signatures(spark, f"{tmp_path}/{name}").collect()
        assert sorted((r.model_name, r.signature) for r in found) == rows
    with pytest.raises(Exception, match="longer than 1"):
        io.write_wide_csv(frame, f"{tmp_path}/cut.csv", 1)


def _folders(path):
    return {name: sorted((path / name / f).read_text(encoding="utf-8") for f in os.listdir(path / name) if f.endswith(".csv"))
            for name in os.listdir(path) if name.startswith("file=")}


@pytest.mark.parametrize("kind", ["double", "float"])
def test_value_files_are_those_of_the_partitioned_writer(spark, tmp_path, kind):
    """Without Hadoop's checksum files, whose making starts a process for each model."""
    names = [f"a{chr(c)}b" for c in (1, 9, 31, *range(32, 128))] + ["a%2Fb", "", None, "x" * 60]
    rows = [(n, [float(i), -0.0, 1e-7 * i, 1e22, float("nan"), float("-inf"), None]) for i, n in enumerate(names)]
    rows += [("empty", []), ("none", None), ("only null", [None])]
    frame = spark.createDataFrame(rows, f"model_name string, signature array<{kind}>")
    io.write_value_csv(frame, f"{tmp_path}/own")
    (frame.select(F.concat("model_name", F.lit("_dna.csv")).alias("file"),
                  F.posexplode("signature").alias("pos", "dna_value")).repartition("file")
     .sortWithinPartitions("file", "pos").drop("pos").write.option("header", True).partitionBy("file").csv(
        f"{tmp_path}/spark"))
    own, given = _folders(tmp_path / "own"), _folders(tmp_path / "spark")
    assert own == given and len(own) == len(names) + 1
    assert not [f for _, _, files in os.walk(tmp_path / "own") for f in files if f.endswith(".crc") and "part" in f]


def test_value_files_of_one_name_and_of_other_letters(spark, tmp_path):
    rows = [("é/ü", [1.0, 2.0]), ("twice", [3.0, 4.0, 5.0]), ("twice", [3.0, 4.0, 5.0])]
    frame = spark.createDataFrame(rows, "model_name string, signature array<double>")
    for _ in range(2):  # the second takes the place of the first
        io.write_value_csv(frame, f"{tmp_path}/folder")
    found = sorted((r.model_name, r.signature) for r in io.read_value_csv(spark, f"{tmp_path}/folder").collect())
    assert found == [("twice", [3.0, 3.0, 4.0, 4.0, 5.0, 5.0]), ("é/ü", [1.0, 2.0])]
    bad = frame.withColumn("signature", F.transform("signature", lambda x: F.when(x < 5, x).otherwise(
        F.raise_error(F.lit("no value")).cast("double"))))
    with pytest.raises(Exception, match="no value"):
        io.write_value_csv(bad, f"{tmp_path}/folder")
    assert io.read_value_csv(spark, f"{tmp_path}/folder").count() == 2 and os.listdir(tmp_path) == ["folder"]


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    cores, key = spark.sparkContext.defaultParallelism, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    frame = spark.range(12 * cores).select(F.concat(F.lit("m"), "id").alias("model_name"),
                                           F.array(F.col("id").cast("double")).alias("signature"))
    io.write_value_csv(frame, f"{tmp_path}/folder")
    before = spark.conf.get(key, None)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        read = io.read_value_csv(spark, f"{tmp_path}/folder")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * cores
    assert spark.conf.get(key, None) == before and read.count() == 12 * cores


def test_many_files_are_read_once(spark, tmp_path):
    frame = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0])], "model_name string, signature array<double>")
    io.write_value_csv(frame, f"{tmp_path}/values")
    plan = io.read_value_csv(spark, f"{tmp_path}/values")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Window" not in plan
    frame.select("model_name", F.lit("x").alias("value")).write.partitionBy("model_name").text(f"{tmp_path}/output")
    plan = batch_files.read_output(spark, f"{tmp_path}/output")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan
