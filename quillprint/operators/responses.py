"""Prompts, responses and batch requests."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.functions import fixed_values as fixed
from quillprint.functions.text import has_text
from quillprint.operators.ordering import number_blocks
from quillprint.session import ship_package

PACK_BLOCK = 65_536


def align(models: DataFrame, probes: DataFrame, responses: DataFrame) -> DataFrame:
    """Exactly one response per model and probe, by position: missing ones are empty, surplus ones drop out.

    ``models`` carries the dataset each model was asked, ``probes`` the positions of that dataset.
    """
    expected = models.select("model_name", "dataset").join(probes, "dataset")
    keys = ["model_name", "dataset", "probe_idx"]
    answered = responses.select(*keys, F.col("response").alias("_response"))
    return (expected.join(answered, keys, "left")
            .select(*keys, F.col("text").alias("prompt"), F.coalesce("_response", F.lit("")).alias("response")))


def accepted_caches(items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys of cached response sets that may be used: not marked incomplete, not empty, not all blank."""
    keys = keys or ["model_name", "dataset"]
    filled = F.bool_or(has_text(F.col("response")))
    complete = F.bool_and(F.coalesce(F.col("complete"), F.lit(True)))
    return (items.groupBy(*keys).agg(filled.alias("_filled"), complete.alias("_complete"))
            .where("_filled AND _complete").select(*keys))


def progress(items: DataFrame, expected: int | Column, keys: list[str] | None = None) -> DataFrame:
    """How many responses each model has, and whether that is all of them."""
    keys = keys or ["model_name", "dataset"]
    expected = F.lit(expected) if isinstance(expected, int) else expected
    counted = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("complete", F.col("count") >= expected)


def progress_steps(items: DataFrame, expected: int, keys: list[str] | None = None) -> DataFrame:
    """The running count after each response, as each incremental save would report it.

    Positions may have gaps: the count is the rank of the position within its model, taken block by block.
    """
    keys = keys or ["model_name", "dataset"]
    blocked = items.select(*keys, "probe_idx").withColumn("_block", F.floor(F.col("probe_idx") / PACK_BLOCK))
    ranked = number_blocks(blocked, ["_block"], ["probe_idx"], "_place", group=keys)
    return ranked.select(*keys, "probe_idx", (F.col("_place") + 1).alias("count"),
                         (F.col("_place") + 1 >= expected).alias("complete"))


def chunk_number(position: Column, size: int) -> tuple[Column, Column]:
    """Number of the fixed-size chunk a position falls in, and the chunk's first position."""
    if size <= 0:
        raise ValueError("chunk size must be > 0")
    number = F.floor(position / size)
    return number, number * size


def merge_with_fallback(requests: DataFrame, batch: DataFrame, fallback: DataFrame,
                        resolved_chunks: DataFrame) -> DataFrame:
    """Final response per request: the batch answer where its chunk came back (missing is empty, and empty stays),
    else the sequential answer, else empty."""
    keys = ["model_name", "probe_idx"]
    chunks = resolved_chunks.select("model_name", "chunk").distinct().withColumn("_resolved", F.lit(True))
    joined = (requests.join(chunks, ["model_name", "chunk"], "left")
              .join(batch.select(*keys, F.col("response").alias("_batch")), keys, "left")
              .join(fallback.select(*keys, F.col("response").alias("_single")), keys, "left"))
    answer = F.when(F.col("_resolved"), F.coalesce("_batch", F.lit(""))).otherwise(F.coalesce("_single", F.lit("")))
    return joined.select(*requests.columns, answer.alias("response"))


def _json_string(text: Column) -> Column:
    """A text as a quoted JSON string."""
    wrapped = F.to_json(F.struct(text.alias("t")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _filled(document: dict, **values: Column) -> Column:
    """JSON text of ``document`` with every ``@NAME@`` string replaced by a column's JSON."""
    pieces = [json.dumps(document, ensure_ascii=False)]
    for name in values:
        pieces = [p for piece in pieces for p in _split_keeping(piece, f'"@{name}@"')]
    slots = {f'"@{name}@"': column for name, column in values.items()}
    return F.concat(*[slots[p] if p in slots else F.lit(p) for p in pieces])


def _split_keeping(text: str, separator: str) -> list[str]:
    parts = text.split(separator)
    out = [parts[0]]
    for part in parts[1:]:
        out += [separator, part]
    return [p for p in out if p]


def chat_request(prompt: Column, position: Column, model: Column, max_length: int = 1024, temperature: float = 0.0,
                 do_sample: bool = False, top_p: float = 1.0, **options) -> Column:
    """One batch request line in the chat-completions layout."""
    body = {"model": "@MODEL@", "messages": [{"role": "user", "content": "@PROMPT@"}], "max_tokens": int(max_length),
            "temperature": float(temperature), "top_p": float(top_p if do_sample else 1.0), **options}
    document = {"custom_id": "@ID@", "method": "POST", "url": fixed.BATCH_ENDPOINT, "body": body}
    identifier = F.concat(F.lit(f'"{fixed.BATCH_ID_PREFIX}'), position.cast("string"), F.lit('"'))
    return _filled(document, ID=identifier, MODEL=_json_string(model), PROMPT=_json_string(prompt))


def content_request(prompt: Column, position: Column, max_length: int = 1024, temperature: float = 0.0,
                    do_sample: bool = False, top_p: float = 1.0, **options) -> Column:
    """One batch request line in the contents-and-parts layout, with its key in the metadata."""
    generation = {"maxOutputTokens": int(max_length), "temperature": float(temperature) if do_sample else 0.0,
                  "topP": float(top_p) if do_sample else 1.0}
    document = {"request": {"contents": [{"role": "user", "parts": [{"text": "@PROMPT@"}]}],
                            "generationConfig": generation, **options}, "metadata": {"key": "@KEY@"}}
    key = F.concat(F.lit('"'), position.cast("string"), F.lit('"'))
    return _filled(document, KEY=key, PROMPT=_json_string(prompt))


def _next_starts(sizes: np.ndarray, max_requests: int, max_bytes: int) -> np.ndarray:
    """For a pack starting at each row, the row the following pack starts at."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    rows = np.arange(len(sizes))
    by_bytes = np.searchsorted(ends, ends[rows] + max_bytes, side="right") - 1
    return np.minimum(np.maximum(by_bytes, rows + 1), rows + max_requests)


def pack_requests(requests: DataFrame, max_requests: int = fixed.BATCH_MAX_REQUESTS,
                  max_bytes: int = fixed.BATCH_MAX_BYTES, key: str = "model_name", position: str = "probe_idx",
                  size: str = "request_bytes", block_rows: int = PACK_BLOCK) -> DataFrame:
    """Greedy packing of each model's requests in order, by count and by bytes; adds ``pack`` from 0.

    Positions may have gaps; requests are first numbered in their order. The packing is a chain, but a pack never spans more than ``max_requests`` rows, so a
    block only needs to know at which of its first rows a pack starts. Each block is summarized for every such
    entry, the summaries of a model are followed from block to block, and the blocks then number their packs.
    A request at or above the byte limit fails the job.
    """
    ship_package(requests.sparkSession)
    block_rows = max(block_rows, max_requests)
    message = F.concat(F.lit("Single prompt payload exceeds the batch limit, position "),
                       F.col(position).cast("string"))
    checked = F.when(F.col(size) < max_bytes, F.col(size)).otherwise(F.raise_error(message).cast("bigint"))
    given = requests.select(key, F.col(position).alias("given"), checked.cast("bigint").alias("bytes")).withColumn(
        "_block", F.floor(F.col("given") / PACK_BLOCK))
    placed = number_blocks(given, ["_block"], ["given"], "pos", group=[key])
    slim = placed.select(key, "pos", "bytes")
    home = F.floor(F.col("pos") / block_rows)
    # the first rows of a block are also seen by the block before it, which a pack may leave late
    ahead = (F.col("pos") % block_rows < max_requests) & (home > 0)
    shared = slim.withColumn("block", F.explode(F.when(ahead, F.array(home, home - 1)).otherwise(F.array(home))))

    def summarize(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        pos = table.column("pos").to_numpy()
        order = np.argsort(pos, kind="stable")
        starts = _next_starts(table.column("bytes").to_numpy()[order], max_requests, max_bytes)
        inside = int((pos < (block + 1) * block_rows).sum())
        # backwards: from row r, how many packs start inside the block and where the next block is entered
        packs, leave = np.zeros(inside, dtype=np.int64), np.zeros(inside, dtype=np.int64)
        for row in range(inside - 1, -1, -1):
            following = starts[row]
            if following >= inside:
                packs[row], leave[row] = 1, following - inside
            else:
                packs[row], leave[row] = packs[following] + 1, leave[following]
        entries = min(inside, max_requests)
        return pa.table({key: table.column(key).slice(0, 1), "block": pa.array([block], pa.int64()),
                         "packs": pa.array([packs[:entries].tolist()]), "leave": pa.array([leave[:entries].tolist()])})

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        entry, count, entries, counts = 0, 0, [], []
        for packs, leave in zip(table.column("packs").to_pylist(), table.column("leave").to_pylist()):
            entries.append(entry)
            counts.append(count)
            if entry >= len(packs):
                entry -= len(packs)
                continue
            entry, count = leave[entry], count + packs[entry]
        return table.select([key, "block"]).append_column("entry", pa.array(entries, pa.int64())) \
            .append_column("before", pa.array(counts, pa.int64()))

    def number(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy(), kind="stable")
        starts = _next_starts(table.column("bytes").to_numpy()[order], max_requests, max_bytes)
        row, pack = table.column("entry")[0].as_py(), table.column("before")[0].as_py()
        begins = np.zeros(len(order), dtype=np.int64)
        while row < len(order):
            begins[row] = 1
            row = starts[row]
        numbers = pack - 1 + np.cumsum(begins)
        table = table.take(pa.array(order))
        return table.select([key, "pos"]).append_column("pack", pa.array(numbers))

    key_field = requests.schema[key]
    long = T.LongType()

    def schema(**fields) -> T.StructType:
        return T.StructType([key_field] + [T.StructField(n, t) for n, t in fields.items()])

    summaries = shared.groupBy(key, "block").applyInArrow(
        summarize, schema(block=long, packs=T.ArrayType(long), leave=T.ArrayType(long)))
    entered = summaries.groupBy(key).applyInArrow(follow, schema(block=long, entry=long, before=long))
    numbered = (slim.withColumn("block", home).join(entered, [key, "block"]).groupBy(key, "block")
                .applyInArrow(number, schema(pos=long, pack=long)))
    packs = placed.select(key, F.col("given").alias(position), "pos").join(numbered, [key, "pos"]).drop("pos")
    return requests.join(packs, [key, position])


def latest_by_position(items: DataFrame, keys: list[str], position: str, order: str) -> DataFrame:
    """One row per key and position: the last one written. A partial aggregate, so repeats cost no shuffle."""
    rest = [c for c in items.columns if c not in (*keys, position, order)]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("_last")
    return items.groupBy(*keys, position).agg(last).select(*keys, position, "_last.*")


