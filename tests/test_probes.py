import pytest
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.operators import grammar, ordering, probes as ops
from quillprint.sources import datasets, lines, probe_cache
from quillprint.session import scratch_path


def _sources(spark, n=40):
    rows = [(d, i, f"{d} text {i}") for d in ("squad", "arc") for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, probe_idx bigint, text string")


@pytest.mark.parametrize("block", [1, 3, 100])
def test_numbering_in_blocks(spark, block):
    df = spark.range(50).withColumn("g", F.col("id") % 2).withColumn("b", F.floor(F.col("id") / block)).repartition(7)
    got = ordering.number_blocks(df, ["b"], ["id"], "n", group=["g"]).collect()
    assert all(r.n == r.id // 2 for r in got)


def test_offsets_run_over_blocks(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)], "ord int, responses int").repartition(6)
    got = ordering.running_offsets(df, "ord", "responses", block_rows=3).orderBy("ord").collect()
    ends = [sum(range(1, i + 2)) for i in range(20)]
    assert [r.slice_end for r in got] == ends and [r.slice_start for r in got] == [0, *ends[:-1]]


def test_shuffle_is_a_permutation_that_ignores_partitioning(spark):
    frames = [ordering.shuffle_positions(_sources(spark).repartition(p), 42, ["dataset", "probe_idx"]) for p in (1, 9)]
    first, second = [[(r.dataset, r.probe_idx) for r in f.orderBy("position").collect()] for f in frames]
    assert first == second and sorted(first) != first
    other = ordering.shuffle_positions(_sources(spark), 7, ["dataset", "probe_idx"]).orderBy("position").collect()
    assert [(r.dataset, r.probe_idx) for r in other] != first
    assert [r.position for r in other] == list(range(80))


def test_standard_sets(spark):
    counts = {r.probe_set: r["count"] for r in ops.standard_probes(spark).groupBy("probe_set").count().collect()}
    assert counts == {"general": 20, **{s: 15 for s in ("reasoning", "creative", "factual", "conversational", "coding",
                                                        "multilingual")}}
    with pytest.raises(ValueError, match="Unknown standard probe set"):
        ops.standard_probes(spark, "rand")


def test_templates_rotate(spark):
    one = spark.createDataFrame([("s", 50, 42)], "set_id string, count int, seed int")
    got = ops.template_probes(one).collect()
    assert len(got) == 50 and not any("{" in r.text for r in got)
    assert len({r.text for r in got if r.domain == "general"}) == 10


def test_dataset_samples_fall_back(spark):
    got = ops.dataset_samples(_sources(spark), ["squad", "writing_prompts"], 6, 1).collect()
    assert sum(r.dataset == "squad" for r in got) == 3
    assert [r.text for r in got if r.dataset == "writing_prompts"] == fixed.FALLBACK_PROBES["writing_prompts"][:3]


def test_diverse_set_has_its_size(spark):
    for size in (10, 33):
        got = ops.diverse_probes(_sources(spark), size).collect()
        assert sorted(r.probe_idx for r in got) == list(range(size))
    only = ops.diverse_probes(_sources(spark), 7, templates=False, samples=False).collect()
    assert {r.origin for r in only} == {"filler"} and len(only) == 7


def test_dispatch(spark):
    sources = _sources(spark)
    assert ops.probe_texts(sources, "syn", "coding", 4).count() == 4
    assert [r.text for r in ops.probe_texts(sources, "arc", "", 2).orderBy("probe_idx").collect()] == [
        "arc text 0", "arc text 1"]
    assert ops.probe_texts(sources, "squad,arc", "", 5).count() == 10


def test_probe_cache_is_written_once(spark):
    path = scratch_path(spark, "cache")
    some = _sources(spark).where("dataset = 'arc'").limit(3)
    assert probe_cache.save_probes(some, path, "arc", 3, 42)
    assert not probe_cache.save_probes(some.limit(1), path, "arc", 3, 42)
    assert probe_cache.lookup(probe_cache.read_probe_cache(spark, path), "arc", 3, 42).count() == 3
    assert probe_cache.lookup(probe_cache.read_probe_cache(spark, path), "arc", 3, 7).count() == 0


def test_two_writers_at_once_leave_one_set(spark, monkeypatch):
    path = scratch_path(spark, "probes")
    one, two = (spark.createDataFrame([(i, f"{name} {i}") for i in range(3)], "probe_idx bigint, text string")
                for name in ("one", "two"))
    plain, waiting = probe_cache._set_of, [True]

    def late(*args):
        """The second writer looks before the first has claimed the key."""
        return None if waiting and waiting.pop() else plain(*args)

    assert probe_cache.save_probes(one, path, "arc", 3, 42)
    monkeypatch.setattr(probe_cache, "_set_of", late)
    assert not probe_cache.save_probes(two, path, "arc", 3, 42) and not waiting
    assert sorted(r.text for r in probe_cache.read_probe_cache(spark, path).collect()) == ["one 0", "one 1", "one 2"]
    assert sorted(r.text for r in probe_cache.cached_probes(spark, path, "arc", 3, 42).collect()) == ["one 0", "one 1", "one 2"]
    assert probe_cache.cached_probes(spark, path, "arc", 4, 42) is None


def test_a_miss_is_saved_and_found_again(spark):
    path = scratch_path(spark, "probes")
    sources = spark.createDataFrame([("squad", i, f"t{i}") for i in range(9)], "dataset string, probe_idx bigint, text string")
    cache = {"cached": lambda: probe_cache.cached_probes(spark, path, "squad", 4, 1),
             "save": lambda made: probe_cache.save_probes(made, path, "squad", 4, 1)}
    made = ops.probe_texts(sources, "squad", "", 4, 1, **cache).collect()
    again = ops.probe_texts(sources.limit(0), "squad", "", 4, 1, **cache).collect()
    assert sorted(made) == sorted(again) and len(again) == 4


def _vocabulary(spark, classes):
    return spark.createDataFrame([(c, f"{c[:4]}{i}") for c in set(classes.values()) for i in range(9)],
                                 "word_class string, word string")


def test_english_samples(spark):
    ids = spark.range(12).select(F.col("id").alias("sample_id"))
    words = _vocabulary(spark, fixed.ENGLISH_WORD_CLASSES)
    got = {r.sample_id: r.text for r in grammar.english_samples(ids, words).collect()}
    again = {r.sample_id: r.text for r in grammar.english_samples(ids.repartition(5), words.repartition(3)).collect()}
    assert got == again and len(set(got.values())) == 12
    for text in got.values():
        sentences = text.split(". ")
        assert len(text.split()) >= 100 and text.endswith(".") and "{" not in text
        assert len(text.rsplit(". ", 1)[0].split()) < 100
        assert all(s[0].isupper() for s in sentences)
    other = {r.sample_id: r.text for r in grammar.english_samples(ids, words, seed=1).collect()}
    assert other != got


def test_chinese_samples_and_missing_words(spark):
    ids = spark.range(3).select(F.col("id").alias("sample_id"))
    words = _vocabulary(spark, fixed.CHINESE_WORD_CLASSES)
    for r in grammar.chinese_samples(ids, words, chars=50).collect():
        assert len([c for c in r.text if c not in fixed.CJK_PUNCTUATION]) >= 50 and r.text.endswith("。")
    with pytest.raises(Exception, match="No vocabulary for"):
        grammar.chinese_samples(ids, words.where("word_class <> 'places'"), chars=50).collect()


def test_model_lists(spark, tmp_path):
    file = tmp_path / "models.txt"
    file.write_text("# head\n\n  a/b \n  # indented\nc\n")
    assert [r.model_name for r in lines.read_model_list(spark, str(file)).orderBy("ord").collect()] == ["a/b", "c"]
    raw = lines.read_model_list(spark, str(file), raw_comments=True)
    assert [r.model_name for r in raw.orderBy("ord").collect()] == ["a/b", "# indented", "c"]
    file.write_text("# only\n\n")
    with pytest.raises(ValueError, match="No valid model names"):
        lines.require_models(lines.read_model_list(spark, str(file)), str(file))
    given = lines.choose_models(spark, ["x, y", "z"], max_models=2)
    assert [r.model_name for r in given.orderBy("ord").collect()] == ["x", "y"]


def test_prompt_csv_and_missing_columns(spark, tmp_path):
    (tmp_path / "train.csv").write_text('id,question\n1,"two\nlines, ""quoted"""\n2,\n')
    got = datasets.read_prompt_csv(spark, str(tmp_path / "train.csv")).orderBy("probe_idx").collect()
    assert [r.text for r in got] == ['two\nlines, "quoted"', "nan"]
    (tmp_path / "other.csv").write_text("id,body\n1,x\n")
    with pytest.raises(ValueError, match="Text column"):
        datasets.read_prompt_csv(spark, str(tmp_path / "other.csv"))


def test_random_dataset_is_made_when_missing(spark, tmp_path):
    path = str(tmp_path / "rand")
    ids = spark.range(25).select(F.col("id").alias("sample_id"))
    make = lambda: grammar.english_samples(ids, _vocabulary(spark, fixed.ENGLISH_WORD_CLASSES), 10)
    first = datasets.read_string_array(spark, path, "rand", generate=make).collect()
    assert len(first) == 25
    assert sorted(map(tuple, datasets.read_string_array(spark, path, "rand").collect())) == sorted(map(tuple, first))
    assert datasets.read_string_array(spark, path, "rand", n=4).count() == 4
    with pytest.raises(FileNotFoundError):
        datasets.read_string_array(spark, path + "-none", "rand")


def test_first_per_group_beyond_the_group_limit(spark):
    df = spark.range(7000).selectExpr("id % 2 AS g", "id", "hash(id) AS h")
    got = ordering.first_per_group(df, ["g"], [F.desc("h"), "id"], 2000)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    want = {g: sorted(((-r.h, r.id) for r in df.where(f"g = {g}").collect()))[:2000] for g in (0, 1)}
    assert {g: sorted((-r.h, r.id) for r in got.where(f"g = {g}").collect()) for g in (0, 1)} == want


def test_samples_are_written_by_many_tasks(spark):
    words = spark.createDataFrame([(c, c) for c in sorted(set(fixed.CHINESE_WORD_CLASSES.values()))], "word_class string, word string")
    made = grammar.chinese_samples(spark.range(3).coalesce(1).withColumnRenamed("id", "sample_id"), words)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(8), REPARTITION_BY_NUM" in plan and made.count() == 3
