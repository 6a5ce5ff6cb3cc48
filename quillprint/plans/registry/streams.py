"""Registered queries that run a stream over a table to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillprint.plans.registry.inputs import TURNS_SQL, table, words_sql
from quillprint.session import scratch_path
from quillprint.streaming import texts as st

QUERIES = {}
SLACK = 500


def _text_stream(spark, sf, n=None):
    schema = table(spark, sf, "documents").schema
    # a file name pattern, so that the source takes the table file (or a folder of that name) as it is
    return st.stream_texts(spark, f"{sf}/documents.parque[t]", schema, "text", "doc_id", n)


def _finished(query):
    query.awaitTermination()
    return query


def _first_texts(spark, sf):
    path = scratch_path(spark, "stream")
    _finished(st.append_parquet(_text_stream(spark, sf, SLACK), f"{path}/out", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").select("probe_idx", F.md5(F.col("text").cast("binary")).alias("text"))


QUERIES["w1_stream_first_texts"] = (
    _first_texts, f"SELECT doc_id AS probe_idx, md5(text) AS text FROM documents WHERE doc_id < {SLACK}")


def _gapped_texts(spark, sf):
    """The first texts of a folder of several files, whose positions have gaps: every third document, in five files."""
    path = scratch_path(spark, "stream")
    kept = table(spark, sf, "documents").where("doc_id % 3 = 1").select("doc_id", "text")
    kept.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{path}/in")
    texts = st.stream_texts(spark, f"{path}/in", kept.schema, "text", "doc_id", files_per_batch=5)
    _finished(st.append_first(texts, SLACK // 4, f"{path}/out", f"{path}/checkpoint"))
    return st.first_texts(spark, f"{path}/out", texts.schema).select(
        "probe_idx", F.md5(F.col("text").cast("binary")).alias("text"))


QUERIES["w1_stream_first_with_gaps"] = (_gapped_texts, f"""
    SELECT doc_id AS probe_idx, md5(text) AS text FROM documents WHERE doc_id % 3 = 1 ORDER BY doc_id LIMIT {SLACK // 4}""")


def _batches(spark, sf):
    path = scratch_path(spark, "stream")
    numbered = st.with_batch_number(_text_stream(spark, sf), 300).select("probe_idx", "batch")
    _finished(st.append_parquet(numbered, f"{path}/out", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").groupBy("batch").agg(
        F.count(F.lit(1)).alias("texts"), F.min("probe_idx").alias("first"), F.max("probe_idx").alias("last"))


QUERIES["w2_stream_batches"] = (_batches, """
    SELECT doc_id // 300 AS batch, count(*) AS texts, min(doc_id) AS first, max(doc_id) AS last FROM documents
    GROUP BY batch""")


def _encoded(spark, sf):
    path = scratch_path(spark, "stream")
    _finished(st.append_embeddings(_text_stream(spark, sf), f"{path}/out", f"{path}/checkpoint", width=16))
    back = spark.read.parquet(f"{path}/out").select("probe_idx", F.posexplode("embedding").alias("pos", "v"))
    return back.where("v > 0").select("probe_idx", F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("double")
                                      .alias("value"))


QUERIES["w3_stream_embeddings"] = (_encoded, f"""
    WITH w AS (SELECT doc_id AS probe_idx, unnest({words_sql('text')}) AS w FROM documents)
    SELECT probe_idx, CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % 16 AS pos, count(*)::DOUBLE AS value FROM w
    GROUP BY ALL""")


def _progress(spark, sf):
    """Assistant turns as responses, each delivered twice."""
    path = scratch_path(spark, "stream")
    schema = table(spark, sf, "conversations").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]")
    answers = arriving.where("role = 'assistant'").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("model_name"),
        F.explode(F.array(F.col("turn"), F.col("turn"))).alias("probe_idx"))
    tracked = st.response_progress(answers, 2, most=100_000)
    _finished(st.track_progress(tracked, f"{path}/out", f"{path}/checkpoint"))
    return st.latest_progress(spark, f"{path}/out").select("model_name", "count", "complete")


QUERIES["w4_stream_progress"] = (_progress, f"""
    WITH {TURNS_SQL} SELECT 'conv-' || conv_id AS model_name, count(*) AS count, count(*) >= 2 AS complete
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")


def _callback(spark, sf):
    """A handler that gets every micro-batch of responses and keeps its lengths."""
    path = scratch_path(spark, "stream")
    schema = table(spark, sf, "conversations").schema
    answers = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]").where("role = 'assistant'")

    def keep(batch, batch_id):
        batch.select("conv_id", "turn", F.length("text").cast("bigint").alias("chars")).write.mode(
            "overwrite").parquet(f"{path}/out/batch={batch_id}")

    _finished(st.each_response(answers, keep, f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").select("conv_id", "turn", "chars")


QUERIES["x3_response_callback"] = (_callback, """
    SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS chars FROM conversations WHERE role = 'assistant'""")
