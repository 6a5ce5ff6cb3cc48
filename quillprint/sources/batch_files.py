"""Batch request and output files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.functions import batch_json as bj
from quillprint.functions.text import has_text
from quillprint.operators.responses import chat_request, content_request, latest_by_position

LAYOUTS = ("chat", "contents")


def request_lines(prompts: DataFrame, layout: str = "chat", **options) -> DataFrame:
    """``model_name, probe_idx, request``: one JSON request per prompt."""
    if layout == "chat":
        line = chat_request(F.col("prompt"), F.col("probe_idx"), F.col("model_name"), **options)
    elif layout == "contents":
        line = content_request(F.col("prompt"), F.col("probe_idx"), **options)
    else:
        raise ValueError(f"Unknown batch layout: {layout}")
    return prompts.select("model_name", "probe_idx", line.alias("request"))


def with_request_bytes(lines: DataFrame) -> DataFrame:
    return lines.withColumn("request_bytes", F.octet_length("request").cast("bigint"))



def parse_chat_output(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Responses of chat-layout output lines (``keys, line_no, value``): ``keys, probe_idx, response``; ``line_no`` is
    anything that orders the lines.

    Blank and unreadable lines and lines without a prompt id are skipped. The body may itself be JSON text. No choice
    is an empty response. Of several lines for one prompt the last counts.
    """
    doc = F.col("_doc")
    body = bj.field(doc, "response.body")
    response = bj.object_field(doc, "response")
    # an absent body means the response itself is the body
    inner = F.when(body.isNull(), response).when(bj.kind(body) == "string", bj.parse(bj.string_field(
        doc, "response.body"))).otherwise(body)
    parsed = (lines.where(has_text(F.col("value"))).withColumn("_doc", bj.parse(F.col("value")))
              .where(doc.isNotNull())
              .select(*keys, "line_no", bj.prompt_index(bj.string_field(doc, "custom_id")).alias("probe_idx"),
                      inner.alias("_body"))
              .where(F.col("probe_idx").isNotNull()))
    answer = bj.choice_text(bj.field(F.col("_body"), "choices[0]"))
    rows = parsed.select(*keys, "line_no", "probe_idx", answer.alias("response"))
    return latest_by_position(rows, keys, "probe_idx", "line_no")


def _keyed(item: Column, order: tuple[str, str]) -> Column:
    return F.coalesce(*[bj.request_key(bj.field(item, path)) for path in order])


def _answer(item: Column) -> Column:
    found = F.coalesce(*[F.when(~bj.blank(bj.field(item, p)), bj.field(item, p))
                         for p in ("response", "inlineResponse")])
    return bj.candidate_text(found)


def parse_inlined_output(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Responses that a job document carries itself: ``keys, probe_idx, response``. Input: ``keys, document``."""
    doc = F.col("_doc")
    items = F.coalesce(bj.array_field(doc, "response.inlinedResponses.inlinedResponses"),
                       bj.array_field(doc, "response.inlinedResponses"))
    rows = (jobs.withColumn("_doc", bj.parse(F.col("document")))
            .select(*keys, F.posexplode(items).alias("line_no", "_item"))
            .where(bj.kind(F.col("_item")) == "object")
            .select(*keys, "line_no", _keyed(F.col("_item"), ("metadata.key", "key")).alias("probe_idx"),
                    _answer(F.col("_item")).alias("response"))
            .where(F.col("probe_idx").isNotNull()))
    return latest_by_position(rows, keys, "probe_idx", "line_no")


def parse_contents_output(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Responses of contents-layout output lines (``keys, line_no, value``): ``keys, probe_idx, response``."""
    doc = F.col("_doc")
    rows = (lines.where(has_text(F.col("value"))).withColumn("_doc", bj.parse(F.col("value")))
            .where(bj.kind(doc) == "object")
            .select(*keys, "line_no", _keyed(doc, ("key", "metadata.key")).alias("probe_idx"),
                    _answer(doc).alias("response"))
            .where(F.col("probe_idx").isNotNull()))
    return latest_by_position(rows, keys, "probe_idx", "line_no")


def parse_job_output(jobs: DataFrame, file_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Inlined responses of each job; jobs without any take those of their result file."""
    inlined = parse_inlined_output(jobs, keys)
    from_files = parse_contents_output(file_lines, keys)
    return inlined.unionByName(from_files.join(inlined.select(*keys).distinct(), keys, "left_anti"))


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """Output lines with the model from the folder: ``model_name, line_no, value``. ``line_no`` is a place to order lines by
    (file, split, line of the split), not a count: only the order of lines matters here, and a count would be a second
    pass over all files."""
    file = F.col("_metadata.file_path")
    place = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("row"))
    model = F.url_decode(F.regexp_extract(file, r"model_name=([^/]+)", 1))
    return spark.read.text(path).select(model.alias("model_name"), place.alias("line_no"), "value")
