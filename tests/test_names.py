import pytest
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions import names
from quillprint.operators import catalog, models as model_ops

def test_provider_by_prefix(spark):
    """Every prefix, in either case, and near misses; the first prefix in the table's order decides."""
    want = {}
    for who, prefixes in fixed.PROVIDER_PREFIXES:
        for prefix in prefixes:
            want.setdefault(f"{prefix}zeta-9", next(w for w, ps in fixed.PROVIDER_PREFIXES
                                                    if any(f"{prefix}zeta-9".startswith(p) for p in ps)))
            want.setdefault(f"{prefix.upper()}ZETA", want[f"{prefix}zeta-9"])
            want.setdefault(f"my {prefix}zeta", fixed.DEFAULT_PROVIDER)
    want[""] = want["zeta-9"] = fixed.DEFAULT_PROVIDER
    df = spark.createDataFrame([(n,) for n in want], "n string")
    assert {r.n: r.p for r in df.select("n", names.provider(F.col("n")).alias("p")).collect()} == want


def test_size_in_name(spark):
    want = {"qwen2.5-0.5b-instruct": 0.5, "mixtral-8x7b": 7.0, "llama-8bit": 8.0, "gpt-neo-125m": 0.125,
            "distilgpt2": None}
    df = spark.createDataFrame([(n,) for n in want], "n string")
    got = df.select("n", names.parameter_info(F.col("n"))["parameter_count_billions"].alias("b")).collect()
    assert {r.n: r.b for r in got} == want


def test_first_family_wins(spark):
    df = spark.createDataFrame([("roberta-base",), ("distilgpt2",), ("code-llama",), ("nothing",)], "n string")
    got = [r.f and r.f.family for r in df.select(names.family(F.col("n")).alias("f")).collect()]
    assert got == ["bert", "gpt", "llama", None]


def test_size_categories_and_batches(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (7.0,), (20.0,), (50.0,), (None,)], "b double")
    assert [r.c for r in df.select(names.size_category(F.col("b")).alias("c")).collect()] == [
        "small", "medium", "large", "very_large", "ultra_large", "unknown"]
    sized = spark.createDataFrame([("x-70b",), ("x-34b",), ("x-7b",), ("x",)], "n string")
    assert [tuple(r.c) for r in sized.select(names.batch_class(F.col("n")).alias("c")).collect()] == [
        ("very_large", 1), ("large", 2), ("standard", 8), ("medium", 8)]


def test_memory_order_and_unknown_precision(spark):
    df = spark.createDataFrame([("gpt2-medium", "float16"), ("gpt2", "bfloat16"), ("opt-6.7b", "4bit")],
                               "n string, p string")
    assert [r.m for r in df.select(names.memory_gb(F.col("n"), F.col("p")).alias("m")).collect()] == [1.0, 2.0, 6.25]


def test_contradicting_quantization_flags(spark):
    df = spark.createDataFrame([(1.0, True, True, False)], "b double, e boolean, f boolean, n boolean")
    with pytest.raises(Exception, match="Use only one"):
        df.select(names.quantization(F.col("b"), F.col("e"), F.col("f"), F.col("n"))).collect()


def test_round_robin_keeps_explicit_workers(spark):
    df = spark.createDataFrame([(0, None), (1, 7), (2, None), (3, None)], "ord int, worker int")
    assert [r.worker for r in model_ops.assign_round_robin(df, [2, 3]).orderBy("ord").collect()] == [2, 7, 2, 3]


def test_classification_uses_config_before_name(spark):
    config = '{"architectures": ["BertModel"], "model_type": "llama", "num_parameters": 3000000000}'
    df = spark.createDataFrame([("org/some-gpt-13b-chat", config), ("org/some-gpt-13b-chat", None)],
                               "model_name string, config string")
    first, second = catalog.classify(df).collect()
    assert (first.model_family, first.organization, first.architecture.type) == ("llama", "Meta", "encoder_only")
    assert (first.size.source, first.size.size_category) == ("config", "medium")
    assert (second.model_family, second.organization, second.architecture.type) == ("gpt", "OpenAI", "unknown")
    assert second.chat_model.confidence == "medium"
