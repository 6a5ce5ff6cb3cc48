"""The corpus pipeline: from the table ``documents`` to a shuffled mixture for training.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
stage's input. All stages but the last return the columns of ``documents``. Whatever a stage learns or counts, it does so
over all that its predecessor kept. Nulls, empty texts, repeated rows and empty tables pass through every stage: a stage's
docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.llm import decontamination, language_id, line_dedup, mixing, ngram_join
from quillprint.llm.common import table
from quillprint.session import scratch_path

#: Normalised phrases per character from which a text of at least so many characters is in none of the learned languages:
#: what is hardly more than unseen letters.
STRANGE_RATE = 9.0
STRANGE_CHARS = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    A document goes if its text is null or has no letter, or is long and cross-parses worse than any language would.
    Where nothing can be learned (no labelled text), all documents with a letter stay.
    """
    samples = language_id.sample_texts(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not samples:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, samples)
    strange = (F.col("phrase_rate") >= STRANGE_RATE) & (F.length("text") >= STRANGE_CHARS)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~strange).select(*columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines stay in their first document only; a document that consisted of nothing else goes.

    A document that had no line to lose stays as it is, empty or null ones too. ``n_chars`` follows the text.
    """
    cleaned = line_dedup.remove_boilerplate(docs)
    gone = (F.col("n_dropped") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    names = [F.col(f"`{c}`") if c != "n_chars" else
             F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
             .alias("n_chars") for c in docs.columns]
    return cleaned.where(~F.coalesce(gone, F.lit(False))).select(*names)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links the one of the smallest doc_id stays; those without words all stay."""
    return ngram_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; the others are not touched."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate and shuffled, with ``copy_no`` and ``shuffle_key``."""
    return mixing.mix(docs)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_copies", keep_one_of_near_copies),
          ("decontamination", remove_benchmark), ("mixing", mix_sources)]

#: Cross-parsing has no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
