"""Streams of texts and responses. Every job runs on whatever has arrived and stops (``availableNow``), or stays up
with a trigger of the caller's choice; state and offsets live in the checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillprint.functions import fixed_values as fixed
from quillprint.functions.encoders import encode_texts
from quillprint.session import any_path, ship_package


def stream_texts(spark: SparkSession, path: str, schema, column: str, order: str, below: int | None = None,
                 fmt: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """Texts of a growing folder: ``probe_idx, text``. A missing column is an error before the stream starts; the
    rows of positions under ``below`` are kept by a filter, which needs no state (they are the first ``below`` texts only
    where positions have no gaps)."""
    fields = schema.fieldNames()
    if column not in fields:
        raise ValueError(f"Text column '{column}' not found. Available: {fields}")
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    texts = reader.load(path).select(F.col(order).cast("bigint").alias("probe_idx"), F.col(column).alias("text"))
    return texts if below is None else texts.where(F.col("probe_idx") < below)


def with_batch_number(texts: DataFrame, size: int = fixed.STREAM_BATCH) -> DataFrame:
    """The fixed-size batch each text belongs to."""
    return texts.withColumn("batch", F.floor(F.col("probe_idx") / size))


def append_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def append_first(texts: DataFrame, n: int, path: str, checkpoint: str) -> StreamingQuery:
    """Append the first ``n`` rows of a stream, and stop; positions may have gaps and may begin anew in every file.

    First means in the order of arrival, by ``probe_idx`` within a micro-batch. How many rows are there already is read
    from what earlier micro-batches wrote: one small file of counts each. A micro-batch writes into a folder of its own
    number, so one that is repeated after a failure counts and keeps the same rows; one that finds ``n`` reached reads
    nothing.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken = 0
        if any_path(spark, f"{path}/counts/step=*"):
            counts = spark.read.schema("n bigint, step bigint").parquet(f"{path}/counts")
            taken = counts.where(F.col("step") < batch_id).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        target = f"{path}/rows/step={batch_id}"
        wanted = batch.orderBy("probe_idx").limit(n - taken) if taken < n else batch.limit(0)
        wanted.write.mode("overwrite").parquet(target)
        written = spark.read.schema(batch.schema).parquet(target).agg(F.count(F.lit(1)).alias("n"))
        written.write.mode("overwrite").parquet(f"{path}/counts/step={batch_id}")

    return (texts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
            .trigger(availableNow=True).start())


def first_texts(spark: SparkSession, path: str, schema) -> DataFrame:
    """What :func:`append_first` kept."""
    return spark.read.schema(schema).parquet(f"{path}/rows").drop("step")


def append_embeddings(texts: DataFrame, path: str, checkpoint: str, encoder: str = "hashed_words", width: int = 64,
                      available_now: bool = True) -> StreamingQuery:
    """Encode texts as they arrive and append the embeddings."""
    encoded = encode_texts(texts, "text", encoder, width).select("probe_idx", "embedding")
    return append_parquet(encoded, path, checkpoint, available_now)


def response_progress(responses: DataFrame, expected: int, most: int | None = None) -> DataFrame:
    """Running count of distinct answered probes per model, and whether that is all of them: ``model_name, count, complete``.

    A model's state is one bit per position from 0 on, whenever its answers come: a repeat never counts twice, however
    late it is, and the state is bounded by ``most`` / 8 bytes (``most`` positions; without it as many as ``expected``).
    Positions beyond, negative or null ones do not count. A row is put out for each model whose count has changed.
    """
    ship_package(responses.sparkSession)
    most = max(expected, most or 0)

    def note(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bits = int.from_bytes(state.get[0], "little") if state.exists else 0
        before = bits
        for batch in batches:
            for position in batch["probe_idx"].dropna().astype("int64").unique().tolist():
                if 0 <= position < most:
                    bits |= 1 << position
        if bits != before:
            state.update((bits.to_bytes((bits.bit_length() + 7) // 8, "little"),))
            count = bits.bit_count()
            yield pd.DataFrame({"model_name": [key[0]], "count": [count], "complete": [count >= expected]})

    return responses.select("model_name", F.col("probe_idx").cast("bigint").alias("probe_idx")).groupBy(
        "model_name").applyInPandasWithState(
        note, "model_name string, count bigint, complete boolean", "bits binary", "update", "NoTimeout")


def track_progress(progress: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                   compact_every: int = 16) -> StreamingQuery:
    """Keep the current progress by model; :func:`latest_progress` reads it.

    A micro-batch appends what has changed. Every ``compact_every``-th one folds all changes since into one table of one row
    per model, so that reading takes that table and a bounded number of changes, not the history.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        # the folder is named after the batch, so a batch that is repeated after a failure replaces itself
        batch.withColumn("at", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/step={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            _progress(batch.sparkSession, path, batch_id).write.mode("overwrite").parquet(f"{path}/whole={batch_id}")

    writer = progress.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _numbers(spark: SparkSession, path: str, kind: str, finished: bool) -> list[int]:
    """Numbers of the folders of one kind that are written to the end, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*" + ("/_SUCCESS" if finished else ""))
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    names = [str(f.getPath().getParent().getName() if finished else f.getPath().getName()) for f in found]
    return sorted(int(name.split("=")[1]) for name in names)


def _progress(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """Last state of every model: the newest whole table before ``until`` and the steps after it."""
    schema = "model_name string, count bigint, complete boolean, at bigint"
    wholes = [k for k in _numbers(spark, path, "whole", True) if until is None or k < until]
    base = wholes[-1] if wholes else -1
    steps = [k for k in _numbers(spark, path, "step", True) if k > base and (until is None or k <= until)]
    folders = ([f"{path}/whole={base}"] if wholes else []) + [f"{path}/step={k}" for k in steps]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*folders)
    return (rows.groupBy("model_name").agg(F.max_by(F.struct("count", "complete", "at"), "at").alias("p"))
            .select("model_name", "p.*"))


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    return _progress(spark, path).select("model_name", "count", "complete")


def each_response(responses: DataFrame, handle: callable, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Call ``handle(batch DataFrame, batch id)`` for every micro-batch of responses."""
    writer = responses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
