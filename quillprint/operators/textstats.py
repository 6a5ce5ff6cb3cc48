"""Corpus and coverage figures of texts. One pass of partial aggregates; only the vocabulary counts shuffle words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions import text as fn

COVERAGE_METRICS = ["length_diversity", "lexical_diversity", "syntactic_diversity", "domain_coverage",
                    "complexity_range"]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def word_rows(texts: DataFrame, column: str, by: list[str]) -> DataFrame:
    return texts.select(*by, F.explode(fn.words(F.lower(F.col(column)))).alias("word"))


def vocabulary(texts: DataFrame, column: str = "text", by: list[str] | None = None) -> DataFrame:
    """Distinct lower-cased words."""
    return word_rows(texts, column, by or []).distinct()


def vocabulary_size(texts: DataFrame, column: str = "text", by: list[str] | None = None) -> DataFrame:
    """Distinct lower-cased words per group: distinct pairs first, so a group of any size is counted in parallel."""
    by = by or []
    return vocabulary(texts, column, by).groupBy(*by).agg(F.count(F.lit(1)).alias("unique_words"))


def _join_on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    if by:
        return left.join(right, by, "left")
    # two one-row aggregates
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def corpus_statistics(texts: DataFrame, column: str = "text", by: list[str] | None = None) -> DataFrame:
    """Counts, lengths, word counts and vocabulary of a corpus, per group. No texts, no row."""
    by = by or []
    sized = texts.select(*by, F.length(column).alias("chars"), fn.word_count(F.col(column)).alias("n_words"))
    figures = sized.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.sum("chars").alias("total_characters"),
        F.sum("n_words").cast("bigint").alias("total_words"), F.avg("chars").alias("avg_length"),
        F.avg("n_words").alias("avg_word_count"), F.min("chars").cast("bigint").alias("min_length"),
        F.max("chars").cast("bigint").alias("max_length"), F.stddev_pop("chars").alias("length_std"),
        F.stddev_pop("n_words").alias("word_count_std")).where(F.col("count") > 0)
    joined = _join_on(figures, vocabulary_size(texts, column, by), by)
    unique = F.coalesce(F.col("unique_words"), F.lit(0).cast("bigint"))
    return (joined.withColumn("unique_words", unique).withColumn("vocabulary_size", F.col("unique_words"))
            .withColumn("type_token_ratio", _ratio(F.col("unique_words"), F.col("total_words"))))


def dataset_info(texts: DataFrame, column: str = "text", order: str = "probe_idx", by: str = "dataset",
                 samples: int = 5) -> DataFrame:
    """Number of texts, word-count figures and the first few texts of every dataset."""
    from quillprint.operators.ordering import first_per_group

    figures = texts.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg(fn.word_count(F.col(column))).alias("avg_length"),
        F.stddev_pop(fn.word_count(F.col(column))).alias("std_length"),
        F.min(fn.word_count(F.col(column))).alias("min_length"),
        F.max(fn.word_count(F.col(column))).alias("max_length"))
    first = first_per_group(texts.select(by, order, column), [by], [order], samples)
    shown = first.groupBy(by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(order, column))), lambda r: r[column]).alias("sample_texts"))
    return figures.join(shown, by, "left")


def coverage(probes: DataFrame, metrics: list[str] | None = None, column: str = "text",
             by: list[str] | None = None) -> DataFrame:
    """Coverage report of probe sets: the chosen metrics side by side, one row per set."""
    by, metrics = by or [], metrics or COVERAGE_METRICS
    unknown = set(metrics) - set(COVERAGE_METRICS)
    if unknown:
        raise ValueError(f"Unknown coverage metrics: {sorted(unknown)}")
    probe = F.col(column)
    lowered = probes.withColumn("_lowered", F.lower(column)) if "domain_coverage" in metrics else probes.withColumn(
        "_lowered", F.lit(""))
    sized = lowered.select(
        *by, fn.word_count(probe).alias("n_words"), fn.is_question(probe).cast("int").alias("question"),
        fn.complexity(probe).alias("complexity"),
        *[fn.mentions_domain(F.col("_lowered"), d).cast("int").alias(f"domain_{d}") for d in fixed.DOMAIN_KEYWORDS])
    mean, std = F.avg("n_words"), F.stddev_pop("n_words")
    columns = {
        "length_diversity": [
            mean.alias("length_mean"), std.alias("length_std"), F.min("n_words").alias("length_min"),
            F.max("n_words").alias("length_max"), _ratio(std, mean).alias("length_cv")],
        "lexical_diversity": [F.sum("n_words").cast("bigint").alias("total_words")],
        "syntactic_diversity": [
            F.avg("question").alias("question_ratio"), F.avg(1 - F.col("question")).alias("statement_ratio"),
            mean.alias("avg_sentence_length")],
        "domain_coverage": [F.avg(f"domain_{d}").alias(f"domain_{d}") for d in fixed.DOMAIN_KEYWORDS],
        "complexity_range": [
            F.min("complexity").alias("min_complexity"), F.max("complexity").alias("max_complexity"),
            F.avg("complexity").alias("mean_complexity"),
            (F.max("complexity") - F.min("complexity")).alias("complexity_range")],
    }
    report = sized.groupBy(*by).agg(*[c for m in COVERAGE_METRICS if m in metrics for c in columns[m]])
    if "lexical_diversity" not in metrics:
        return report
    joined = _join_on(report, vocabulary_size(probes, column, by), by)
    unique = F.coalesce(F.col("unique_words"), F.lit(0).cast("bigint"))
    return (joined.withColumn("unique_words", unique)
            .withColumn("ttr", _ratio(F.col("unique_words"), F.col("total_words"))))
