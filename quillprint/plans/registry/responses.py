"""Registered queries on prompts, responses and batch files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillprint.functions import batch_json as bj
from quillprint.operators import responses as ops
from quillprint.plans.registry.inputs import TURNS_SQL, models, strip_sql, table, turns, MODELS_SQL
from quillprint.session import scratch_path, spread
from quillprint.sources import batch_files, response_cache

QUERIES = {}


def _answered(spark, sf):
    return turns(spark, sf).where("response IS NOT NULL")


def _aligned(spark, sf):
    """Every model was asked one of eleven datasets; a dataset has all positions that any of its models answered."""
    t = turns(spark, sf).withColumn("dataset", F.concat(F.lit("set-"), (F.col("conv_id") % 11).cast("string")))
    probes = t.groupBy("dataset", "probe_idx").agg(F.concat(F.lit("probe "), F.min("probe_idx").cast("string"))
                                                   .alias("text"))
    return ops.align(t.select("model_name", "dataset").distinct(), probes, t.where("response IS NOT NULL")).select(
        "model_name", "dataset", "probe_idx", "prompt", F.md5(F.col("response").cast("binary")).alias("response"))


QUERIES["j3_align_responses"] = (_aligned, f"""
    WITH {TURNS_SQL}, t AS (SELECT * REPLACE ('set-' || (conv_id % 11) AS dataset) FROM turns)
    SELECT m.model_name, dataset, p.probe_idx, 'probe ' || p.probe_idx AS prompt, md5(coalesce(a.response, '')) AS response
    FROM (SELECT DISTINCT model_name, dataset FROM t) m JOIN (SELECT DISTINCT dataset, probe_idx FROM t) p USING (dataset)
    LEFT JOIN t a USING (model_name, dataset, probe_idx)""")


def _merged(spark, sf):
    t = turns(spark, sf).select(
        F.concat(F.lit("bot-"), (F.col("conv_id") % 7).cast("string")).alias("model_name"), "conv_id",
        (F.col("conv_id") * 10 + F.col("probe_idx")).alias("probe_idx"), "response")
    requests = t.select("model_name", "probe_idx", ops.chunk_number(F.col("probe_idx"), 64)[0].alias("chunk"))
    batch = t.where("conv_id % 3 = 0 AND response IS NOT NULL").select("model_name", "probe_idx", "response")
    single = t.where("conv_id % 3 = 1 AND response IS NOT NULL").select("model_name", "probe_idx", "response")
    resolved = requests.where("chunk % 2 = 0").select("model_name", "chunk")
    return ops.merge_with_fallback(requests, batch, single, resolved).select(
        "model_name", "probe_idx", "chunk", F.md5(F.col("response").cast("binary")).alias("response"))


QUERIES["j4_merge_batch_and_fallback"] = (_merged, f"""
    WITH {TURNS_SQL}, t AS (SELECT 'bot-' || (conv_id % 7) AS model_name, conv_id, conv_id * 10 + probe_idx AS probe_idx,
                                   response FROM turns)
    SELECT model_name, probe_idx, probe_idx // 64 AS chunk,
           md5(CASE WHEN probe_idx // 64 % 2 = 0 THEN CASE WHEN conv_id % 3 = 0 THEN coalesce(response, '') ELSE '' END
                    WHEN conv_id % 3 = 1 THEN coalesce(response, '') ELSE '' END) AS response FROM t""")

QUERIES["v6_fixed_chunks"] = (
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", *[c.alias(n) for n, c in zip(("chunk", "chunk_start"), ops.chunk_number(F.col("doc_id"), 32))]),
    "SELECT doc_id, doc_id // 32 AS chunk, doc_id // 32 * 32 AS chunk_start FROM documents")


def _packed(step):
    def run(spark, sf):
        sized = table(spark, sf, "documents").select(
            F.lit("one model").alias("model_name"), (F.col("doc_id") * step).alias("probe_idx"),
            (F.octet_length("text") % 9000 + 50).cast("bigint").alias("request_bytes"))
        return ops.pack_requests(sized, 7, 30_000, block_rows=64).select("probe_idx", "request_bytes", "pack")
    return run


_PACKED_SQL = """
    WITH RECURSIVE sized AS (SELECT doc_id AS i, octet_length(encode(text)) % 9000 + 50 AS b FROM documents),
    fold(i, b, pack, held, bytes) AS (
        SELECT i, b, 0, 1, b FROM sized WHERE i = 0
        UNION ALL
        SELECT s.i, s.b, CASE WHEN held >= 7 OR bytes + s.b > 30000 THEN pack + 1 ELSE pack END,
               CASE WHEN held >= 7 OR bytes + s.b > 30000 THEN 1 ELSE held + 1 END,
               CASE WHEN held >= 7 OR bytes + s.b > 30000 THEN s.b ELSE bytes + s.b END
        FROM fold f JOIN sized s ON s.i = f.i + 1)
    SELECT i * {step} AS probe_idx, CAST(b AS BIGINT) AS request_bytes, CAST(pack AS BIGINT) AS pack FROM fold"""
QUERIES["v7_greedy_packing"] = (_packed(1), _PACKED_SQL.replace("{step}", "1"))
QUERIES["v7_packing_with_gaps"] = (_packed(70_000), _PACKED_SQL.replace("{step}", "70000"))


def _requests(layout, **options):
    def run(spark, sf):
        lines = batch_files.with_request_bytes(batch_files.request_lines(turns(spark, sf), layout, **options))
        return lines.select("model_name", "probe_idx", "request_bytes", F.md5(F.col("request").cast("binary"))
                            .alias("request"))
    return run


_CHAT_LINE = """'{"custom_id": "prompt_' || probe_idx || '", "method": "POST", "url": "/v1/chat/completions", "body": '
    || '{"model": "' || model_name || '", "messages": [{"role": "user", "content": ' || to_json(prompt) || '}], '
    || '"max_tokens": 512, "temperature": 0.5, "top_p": 1.0}}'"""
_CONTENT_LINE = """'{"request": {"contents": [{"role": "user", "parts": [{"text": ' || to_json(prompt) || '}]}], '
    || '"generationConfig": {"maxOutputTokens": 1024, "temperature": 0.7, "topP": 0.9}}, "metadata": {"key": "'
    || probe_idx || '"}}'"""
for _layout, _line, _options in (("chat", _CHAT_LINE, {"max_length": 512, "temperature": 0.5, "top_p": 0.9}),
                                 ("contents", _CONTENT_LINE, {"temperature": 0.7, "do_sample": True, "top_p": 0.9})):
    QUERIES[f"s18_requests_{_layout}"] = (_requests(_layout, **_options), f"""
        WITH {TURNS_SQL}, lines AS (SELECT model_name, probe_idx, {_line} AS r FROM turns)
        SELECT model_name, probe_idx, CAST(octet_length(encode(r)) AS BIGINT) AS request_bytes, md5(r) AS request
        FROM lines""")


def _chat_body(content):
    return F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"))


def _chat_output(spark, sf):
    """Output lines of every shape the parser knows, by conversation; reversed order is left to the files."""
    t = _answered(spark, sf)
    text = F.concat(F.lit("  "), F.col("response"), F.lit("\n"))
    identifier = F.concat(F.lit("prompt_"), F.col("probe_idx").cast("string"))

    def line(body):
        return F.to_json(F.struct(identifier.alias("custom_id"), F.struct(body.alias("body")).alias("response")))

    plain = line(_chat_body(text))
    as_text = line(F.to_json(_chat_body(text)))
    parts = line(_chat_body(F.array(
        F.struct(text.alias("text"), F.lit(None).cast("string").alias("type")),
        F.struct(F.lit(None).cast("string").alias("text"), F.lit("image").alias("type")),
        F.struct(F.lit("end ").alias("text"), F.lit(None).cast("string").alias("type")))))
    empty = line(F.struct(F.array().cast("array<string>").alias("choices")))
    older = line(_chat_body(F.lit("older answer")))
    shape = F.col("conv_id") % 6
    lines = (F.when(shape == 0, F.array(plain)).when(shape == 1, F.array(as_text, F.lit(" ")))
             .when(shape == 2, F.array(parts)).when(shape == 3, F.array(empty))
             .when(shape == 4, F.array(older, plain))
             .otherwise(F.array(F.lit("not-json-line"), F.regexp_replace(plain, "prompt_", "other_"))))
    return t.select("model_name", "probe_idx", F.posexplode(lines).alias("place", "value"))


def _chat_round_trip(spark, sf):
    path = scratch_path(spark, "batch-output")
    # one file a model, not one for every task that has a line of it
    lines = _chat_output(spark, sf).repartition("model_name").sortWithinPartitions("model_name", "probe_idx", "place")
    lines.select("model_name", "value").write.partitionBy("model_name").text(path)
    parsed = batch_files.parse_chat_output(batch_files.read_output(spark, path), ["model_name"])
    return parsed.select("model_name", "probe_idx", F.md5(F.col("response").cast("binary")).alias("response"))


_STRIPPED = strip_sql("response")
QUERIES["s19_chat_batch_output"] = (_chat_round_trip, f"""
    WITH {TURNS_SQL}
    SELECT model_name, probe_idx, md5(CASE conv_id % 6 WHEN 2 THEN {strip_sql("'  ' || response")} || chr(10) || chr(10)
           || 'end' WHEN 3 THEN '' ELSE {_STRIPPED} END) AS response
    FROM turns WHERE response IS NOT NULL AND conv_id % 6 <> 5""")


def _candidate(text):
    return F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content")))
                    .alias("candidates"))


def _contents_output(spark, sf):
    """Jobs that carry their responses, and jobs that leave them in a file."""
    t = _answered(spark, sf)
    key = F.col("probe_idx").cast("string")
    item = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(
        F.struct(key.alias("key")).alias("metadata"), _candidate(F.col("response")).alias("response")))).otherwise(
        F.to_json(F.struct(F.col("probe_idx").alias("key"), F.struct(F.col("response").alias("text"))
                           .alias("inlineResponse"))))
    inlined = (t.where("conv_id % 2 = 0").groupBy("model_name").agg(F.array_join(F.collect_list(item), ",").alias("i"))
               .select("model_name", F.concat(F.lit('{"done": true, "response": {"inlinedResponses": {"inlinedResponses": [3, '),
                                              F.col("i"), F.lit("]}}}")).alias("document")))
    waiting = t.where("conv_id % 2 = 1").select("model_name").distinct().select(
        "model_name", F.lit('{"done": true, "response": {"responsesFile": "files/x"}}').alias("document"))
    lines = t.select("model_name", (F.col("probe_idx")).alias("line_no"), item.alias("value"))
    return inlined.unionByName(waiting), lines


def _contents_parsed(spark, sf):
    jobs, lines = _contents_output(spark, sf)
    return batch_files.parse_job_output(jobs, lines, ["model_name"]).select(
        "model_name", "probe_idx", F.md5(F.col("response").cast("binary")).alias("response"))


QUERIES["s20_contents_batch_output"] = (_contents_parsed, f"""
    WITH {TURNS_SQL} SELECT model_name, probe_idx, md5({_STRIPPED}) AS response FROM turns
    WHERE response IS NOT NULL""")

# --- N: single JSON values, composed from part so that every shape occurs ---

_N1 = """CASE ord % 6 WHEN 0 THEN '{"message": {"content": "  x ' || p_brand || ' "}}'
    WHEN 1 THEN '{"message": {"content": [{"text": "' || p_brand || '"}, {"text": 5}, 7, {"text": "b "}]}}'
    WHEN 2 THEN '{"message": {"content": null}}' WHEN 3 THEN '{"other": 1}' WHEN 4 THEN '"just text"'
    ELSE '{"message": {"content": 12}}' END"""
_N2 = """CASE ord % 6 WHEN 0 THEN '{"text": " ' || p_brand || ' "}'
    WHEN 1 THEN '{"candidates": [{"content": {"parts": [{"text": "' || p_brand || '"}, {"x": 1}, {"text": "z"}]}}]}'
    WHEN 2 THEN '{"candidates": []}' WHEN 3 THEN '[]' WHEN 4 THEN '{"candidates": [{"content": {}}]}'
    ELSE '{"text": 3, "candidates": [{"content": {"parts": [{"text": "c"}]}}]}' END"""
_N3 = """CASE ord % 6 WHEN 0 THEN 'prompt_' || ord WHEN 1 THEN 'prompt_-' || p_size WHEN 2 THEN 'prompt_x'
    WHEN 3 THEN 'request_' || ord WHEN 4 THEN 'prompt_' ELSE 'prompt_1.5' END"""
_N4 = """CASE ord % 7 WHEN 0 THEN '{"metadata": {"state": "RUN' || p_size || '"}}'
    WHEN 1 THEN '{"metadata": {"state": {"name": "N' || p_size || '", "code": "c"}}}'
    WHEN 2 THEN '{"metadata": {"state": {"code": "C"}}, "state": "S"}' WHEN 3 THEN '{"state": "S' || p_size || '"}'
    WHEN 4 THEN '{"state": {"state": "T"}}' WHEN 5 THEN '{"metadata": {"state": 4}, "state": {"name": 1, "code": "D"}}'
    ELSE '{"state": 5}' END"""
_N5 = """CASE ord % 6 WHEN 0 THEN '{"content": " ' || p_brand || ' ", "reasoning": "r"}'
    WHEN 1 THEN '{"content": "  ", "reasoning": " why ' || p_size || '"}'
    WHEN 2 THEN '{"content": null, "reasoning": "", "reasoning_details": [{"text": " "}, {"text": "d' || p_size || ' "}]}'
    WHEN 3 THEN '{"reasoning_details": [{"kind": "x"}]}' WHEN 4 THEN '{"content": ""}'
    ELSE '{"reasoning": " only "}' END"""


def _json_query(expression, parse, name="value"):
    return lambda spark, sf: models(spark, sf).select("ord", parse(F.expr(expression)).alias(name))


def _json_sql(cases, modulus, default, name="value"):
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items())
    return f"WITH {MODELS_SQL} SELECT ord, CASE ord % {modulus} {whens} ELSE {default} END AS {name} FROM models"


QUERIES["n1_choice_text"] = (
    _json_query(_N1, lambda c: bj.choice_text(bj.parse(c))),
    _json_sql({0: "'x ' || p_brand", 1: "p_brand || chr(10) || 'b'"}, 6, "''"))
QUERIES["n2_candidate_text"] = (
    _json_query(_N2, lambda c: bj.candidate_text(bj.parse(c))),
    _json_sql({0: "p_brand", 1: "p_brand || chr(10) || 'z'", 5: "'c'"}, 6, "''"))
QUERIES["n3_prompt_index"] = (_json_query(_N3, bj.prompt_index),
                              _json_sql({0: "ord", 1: "-CAST(p_size AS BIGINT)"}, 6, "NULL"))
QUERIES["n4_job_state"] = (
    _json_query(_N4, lambda c: bj.job_state(bj.parse(c))),
    _json_sql({0: "'RUN' || p_size", 1: "'N' || p_size", 2: "'C'", 3: "'S' || p_size", 4: "'T'", 5: "'D'"}, 7, "NULL"))
QUERIES["n5_reasoning_text"] = (
    _json_query(_N5, lambda c: bj.reasoning_text(bj.parse(c))),
    _json_sql({0: "p_brand", 1: "'why ' || p_size", 2: "'d' || p_size", 5: "'only'"}, 6, "''"))

# --- caches ---

_CACHED = "CASE WHEN conv_id % 4 = 0 THEN chr(9) || ' ' ELSE coalesce(response, '') END"


def _cache_items(spark, sf):
    return turns(spark, sf).select("model_name", "dataset", "probe_idx", F.expr(
        _CACHED.replace("chr(9)", "'\\t'")).alias("response"), (F.col("conv_id") % 5 != 0).alias("complete"))


QUERIES["f9_accepted_caches"] = (
    lambda spark, sf: ops.accepted_caches(_cache_items(spark, sf)),
    f"""WITH {TURNS_SQL}, items AS (SELECT model_name, dataset, conv_id, {_CACHED} AS r FROM turns)
        SELECT model_name, dataset FROM items WHERE conv_id % 5 <> 0 GROUP BY model_name, dataset
        HAVING bool_or({strip_sql('r')} <> '')""")


def _split_complete(spark, sf):
    """Incremental saves of two wanted responses, one item to a document."""
    path = scratch_path(spark, "responses")
    filled = turns(spark, sf).withColumn("response", F.coalesce("response", F.lit("")))
    documents = response_cache.response_documents(filled, expected=2, items_per_document=1)
    response_cache.write_response_documents(documents, path)
    items = response_cache.cached_items(response_cache.read_response_documents(spark, path))
    return response_cache.usable_items(items).groupBy("model_name").agg(F.count(F.lit(1)).alias("items"))


QUERIES["s5_split_cache_complete"] = (_split_complete, f"""
    WITH {TURNS_SQL} SELECT model_name, count(*) AS items FROM turns GROUP BY model_name
    HAVING count(*) >= 2 AND bool_or({strip_sql("coalesce(response, '')")} <> '')""")


def _cache_round_trip(spark, sf):
    path = scratch_path(spark, "responses")
    filled = turns(spark, sf).withColumn("response", F.coalesce("response", F.lit("")))
    # two items to a document, so that longer caches are split
    response_cache.write_response_documents(response_cache.response_documents(filled, items_per_document=2), path)
    items = response_cache.cached_items(response_cache.read_response_documents(spark, path))
    return response_cache.usable_items(items).select(
        "model_name", "dataset", "probe_idx", F.md5(F.col("response").cast("binary")).alias("response"))


QUERIES["s5_cache_round_trip"] = (_cache_round_trip, f"""
    WITH {TURNS_SQL}, filled AS (SELECT model_name FROM turns GROUP BY model_name
                                 HAVING bool_or({strip_sql("coalesce(response, '')")} <> ''))
    SELECT model_name, dataset, probe_idx, md5(coalesce(response, '')) AS response
    FROM turns JOIN filled USING (model_name)""")



def _gaps(spark, sf):
    """Every third answer is missing; the rest have to keep their places."""
    path = scratch_path(spark, "responses")
    filled = turns(spark, sf).where("(conv_id + probe_idx) % 3 <> 0").withColumn(
        "response", F.coalesce("response", F.lit("")))
    response_cache.write_response_documents(response_cache.response_documents(filled, items_per_document=3), path)
    items = response_cache.cached_items(response_cache.read_response_documents(spark, path))
    return response_cache.usable_items(items).select(
        "model_name", "dataset", "probe_idx", F.md5(F.col("response").cast("binary")).alias("response"))


QUERIES["s5_cache_with_gaps"] = (_gaps, f"""
    WITH {TURNS_SQL}, kept AS (SELECT * FROM turns WHERE (conv_id + probe_idx) % 3 <> 0),
    filled AS (SELECT model_name FROM kept GROUP BY model_name HAVING bool_or({strip_sql("coalesce(response, '')")} <> ''))
    SELECT model_name, dataset, probe_idx, md5(coalesce(response, '')) AS response
    FROM kept JOIN filled USING (model_name)""")

_SHAPES = """CASE ord % 6
    WHEN 0 THEN '{"model": "m' || ord || '", "dataset": "d", "items": [{"prompt": "p", "response": "r' || p_size
                || '"}, 5, {"prompt": "q"}, {"response": null}]}'
    WHEN 1 THEN '{"model": "m' || ord || '", "dataset": "d", "complete": false, "items": [{"response": "x"}]}'
    WHEN 2 THEN '["a' || p_size || '", null, 7]' WHEN 3 THEN '{"model": "m' || ord || '", "items": []}'
    WHEN 4 THEN '{"model": "m' || ord || '", "items": [{"response": " "}, {"response": ""}]}'
    ELSE 'broken {' END"""


def _cache_shapes(spark, sf):
    documents = spread(models(spark, sf)).select(F.expr(_SHAPES).alias("document"), F.concat(
        F.lit("file-"), F.col("ord").cast("string")).alias("file"))
    return response_cache.usable_items(response_cache.cached_items(documents)).select(
        "model_name", "dataset", "probe_idx", "response")


QUERIES["s4_cache_shapes"] = (_cache_shapes, f"""
    WITH {MODELS_SQL}
    SELECT 'm' || ord AS model_name, 'd' AS dataset, CAST(i AS BIGINT) AS probe_idx,
           CASE i WHEN 0 THEN 'r' || p_size WHEN 1 THEN '' ELSE 'None' END AS response
    FROM models, range(0, 3) t(i) WHERE ord % 6 = 0
    UNION ALL SELECT 'file-' || ord, '', CAST(i AS BIGINT), CASE i WHEN 0 THEN 'a' || p_size WHEN 1 THEN 'None' ELSE '7' END
    FROM models, range(0, 3) t(i) WHERE ord % 6 = 2""")

QUERIES["w4_progress_batch"] = (
    lambda spark, sf: ops.progress(_answered(spark, sf), 2).select("model_name", "count", "complete"),
    f"""WITH {TURNS_SQL} SELECT model_name, count(*) AS count, count(*) >= 2 AS complete FROM turns
        WHERE response IS NOT NULL GROUP BY model_name""")
QUERIES["s5_incremental_progress"] = (
    lambda spark, sf: ops.progress_steps(turns(spark, sf), 2).select("model_name", "probe_idx", "count", "complete"),
    f"""WITH {TURNS_SQL} SELECT model_name, probe_idx, row_number() OVER (PARTITION BY model_name ORDER BY probe_idx)
        AS count, row_number() OVER (PARTITION BY model_name ORDER BY probe_idx) >= 2 AS complete FROM turns""")


def _stamps(spark, sf):
    documents = response_cache.response_documents(turns(spark, sf))
    stamp = F.get_json_object("document", "$.generated_at")
    return documents.select("model_name", stamp.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$").alias("is_iso"),
                            F.get_json_object("document", "$.count").cast("bigint").alias("count"))


QUERIES["d1_iso_timestamps"] = (_stamps, f"""
    WITH {TURNS_SQL} SELECT model_name, true AS is_iso, count(*) AS count FROM turns GROUP BY model_name""")
