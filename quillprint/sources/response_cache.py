"""Cached responses as JSON documents, and as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.functions import batch_json
from quillprint.operators.responses import accepted_caches
from quillprint.session import settle

DOCUMENT_ITEMS = 50_000


def response_documents(responses: DataFrame, expected: int | None = None,
                       items_per_document: int = DOCUMENT_ITEMS) -> DataFrame:
    """One JSON document per model and dataset: ``model_name, dataset, document``.

    Positions may have gaps: an item says where it belongs if that is not its place in the list.

    A model with more than ``items_per_document`` responses gets several documents, each with the position of its
    first item, so no task holds more than that. ``count`` and, with ``expected``, the ``complete`` mark of incremental
    saves are those of the whole model in each of them.
    """
    totals = responses.groupBy("model_name", "dataset").agg(F.count(F.lit(1)).alias("_total"))
    part = F.floor(F.col("probe_idx") / items_per_document)
    grouped = responses.withColumn("_part", part).groupBy("model_name", "dataset", "_part").agg(
        F.array_sort(F.collect_list(F.struct("probe_idx", "prompt", "response"))).alias("rows"),
        F.min("probe_idx").cast("bigint").alias("offset")).join(totals, ["model_name", "dataset"])
    # as texts, because an item without a gap before it has no such field, and a missing response is a JSON null
    items = F.transform("rows", lambda r, i: F.when(
        r["probe_idx"] == F.col("offset") + i,
        F.to_json(F.struct(r["prompt"].alias("prompt"), r["response"].alias("response")), {"ignoreNullFields": "false"}))
        .otherwise(F.to_json(F.struct(r["prompt"].alias("prompt"), r["response"].alias("response"),
                                      r["probe_idx"].alias("probe_idx")), {"ignoreNullFields": "false"})))
    fields = [F.col("model_name").alias("model"), F.col("dataset"), F.col("_total").cast("int").alias("count")]
    if expected is not None:
        fields.append((F.col("_total") >= expected).alias("complete"))
    head = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    tail = F.to_json(F.struct(F.col("offset"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                              .alias("generated_at")))
    document = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"items":['), F.array_join(items, ","),
                        F.lit("],"), F.substring(tail, F.lit(2), F.length(tail)))
    return grouped.select("model_name", "dataset", document.alias("document"))


def write_response_documents(documents: DataFrame, path: str) -> None:
    """One document per line, below a folder per dataset."""
    documents.select("dataset", F.col("document").alias("value")).write.mode("overwrite").partitionBy("dataset") \
        .text(path)


def read_response_documents(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Document texts. ``whole_files`` for one document per file, which may then span lines."""
    return spark.read.text(path, wholetext=whole_files).select(
        F.col("value").alias("document"), F.col("_metadata.file_path").alias("file"))


def cached_items(documents: DataFrame) -> DataFrame:
    """``model_name, dataset, complete, probe_idx, response`` of all readable documents.

    An object with items or a bare array. Items that are no objects drop out and later ones move up, but an item that
    names its position has that one.
    """
    parsed = documents.withColumn("_doc", batch_json.parse(F.col("document")))
    doc = F.col("_doc")
    objects = F.filter(batch_json.array_field(doc, "items"), lambda i: batch_json.kind(i) == "object")
    from_items = F.transform(objects, lambda i: F.struct(
        batch_json.cached_response(i).alias("response"),
        F.try_variant_get(i, "$.probe_idx", "bigint").alias("own")))
    from_array = F.transform(batch_json.array_field(doc, ""), lambda i: F.struct(
        batch_json.cached_element(i).alias("response"), F.lit(None).cast("bigint").alias("own")))
    keyed = parsed.select(
        F.coalesce(batch_json.string_field(doc, "model"), F.col("file")).alias("model_name"),
        F.coalesce(batch_json.string_field(doc, "dataset"), F.lit("")).alias("dataset"),
        # anything but an explicit false counts as complete
        F.coalesce(F.when(batch_json.kind(batch_json.field(doc, "complete")) == "boolean",
                          F.try_variant_get(doc, "$.complete", "boolean")), F.lit(True)).alias("complete"),
        F.coalesce(F.try_variant_get(doc, "$.offset", "bigint"), F.lit(0).cast("bigint")).alias("_offset"),
        F.posexplode(F.coalesce(from_items, from_array)).alias("_pos", "_item"))
    return keyed.select("model_name", "dataset", "complete",
                        F.coalesce("_item.own", F.col("_offset") + F.col("_pos")).alias("probe_idx"), "_item.response")


def usable_items(items: DataFrame) -> DataFrame:
    """Items of caches that may be used. Items are written out first: which caches count is known after all of them are
    parsed, and parsing is most of the work."""
    items = settle(items, "cached-items")
    return items.join(accepted_caches(items), ["model_name", "dataset"], "left_semi")
