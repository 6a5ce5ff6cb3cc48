import json
import random

import pytest
from pyspark.sql import functions as F

from quillprint.functions import batch_json as bj
from quillprint.operators import responses as ops
from quillprint.sources import batch_files, response_cache


def _greedy(sizes, most, limit):
    packs, held, total = [0], 1, sizes[0]
    for size in sizes[1:]:
        if held >= most or total + size > limit:
            packs.append(packs[-1] + 1)
            held, total = 1, size
        else:
            packs.append(packs[-1])
            held, total = held + 1, total + size
    return packs


@pytest.mark.parametrize("most,limit,block", [(2, 10_000, 2), (5, 300, 5), (7, 500, 16), (50, 400, 50), (3, 101, 1000)])
def test_packing_equals_the_sequential_rule(spark, most, limit, block):
    rng = random.Random(most)
    sizes = {m: [rng.randrange(1, 100) for _ in range(n)] for m, n in (("a", 1), ("b", 5), ("c", 333))}
    rows = [(m, i, s) for m, ss in sizes.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "model_name string, probe_idx bigint, request_bytes bigint").repartition(5)
    got = ops.pack_requests(df, most, limit, block_rows=block).orderBy("model_name", "probe_idx").collect()
    for model, values in sizes.items():
        assert [r.pack for r in got if r.model_name == model] == _greedy(values, most, limit)


def test_five_prompts_two_per_batch(spark):
    df = spark.createDataFrame([("m", i, 10) for i in range(5)], "model_name string, probe_idx bigint, request_bytes int")
    assert [r.pack for r in ops.pack_requests(df, 2).orderBy("probe_idx").collect()] == [0, 0, 1, 1, 2]
    number, start = ops.chunk_number(F.col("probe_idx"), 2)
    assert [(r[0], r[1]) for r in df.orderBy("probe_idx").select(number, start).collect()] == [
        (0, 0), (0, 0), (1, 2), (1, 2), (2, 4)]


def test_too_large_request_is_an_error(spark):
    df = spark.createDataFrame([("m", 0, 100)], "model_name string, probe_idx bigint, request_bytes int")
    with pytest.raises(Exception, match="exceeds the batch limit"):
        ops.pack_requests(df, 2, 100).collect()


def test_requests_are_the_lines_json_would_write(spark):
    prompt = 'say "hi"\n\tno \\ é 文 \x01'
    df = spark.createDataFrame([("org/m", 3, prompt)], "model_name string, probe_idx bigint, prompt string")
    chat = batch_files.request_lines(df, "chat", max_length=9, temperature=1, do_sample=False, top_p=0.5).first().request
    assert chat == json.dumps({
        "custom_id": "prompt_3", "method": "POST", "url": "/v1/chat/completions",
        "body": {"model": "org/m", "messages": [{"role": "user", "content": prompt}], "max_tokens": 9,
                 "temperature": 1.0, "top_p": 1.0}}, ensure_ascii=False)
    content = batch_files.with_request_bytes(batch_files.request_lines(df, "contents", do_sample=True, top_p=0.5,
                                                                       temperature=0.2)).first()
    assert json.loads(content.request)["metadata"] == {"key": "3"}
    assert json.loads(content.request)["request"]["generationConfig"] == {
        "maxOutputTokens": 1024, "temperature": 0.2, "topP": 0.5}
    assert content.request_bytes == len(content.request.encode())
    with pytest.raises(ValueError, match="layout"):
        batch_files.request_lines(df, "xml")


def test_chat_output_shapes(spark):
    def record(index, body):
        return json.dumps({"custom_id": f"prompt_{index}", "response": {"body": body}})

    lines = [
        record(2, json.dumps({"choices": [{"message": {"content": " as text "}}]})),
        record(1, {"error": {"message": "bad"}}), "not-json-line", "", "  ",
        record(0, {"choices": [{"message": {"content": "first"}}]}),
        record(0, {"choices": [{"message": {"content": "last"}}]}),
        json.dumps({"custom_id": "prompt_3", "response": {"choices": [{"message": {"content": "no body"}}]}}),
        json.dumps({"custom_id": "other_4", "response": {}}), json.dumps({"custom_id": 5}), "[1]", "7",
        record(6, "{broken"), record(7, {"choices": [{"message": None}]})]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(lines)], "model_name string, line_no int, value string")
    got = batch_files.parse_chat_output(df, ["model_name"]).collect()
    assert {r.probe_idx: r.response for r in got} == {0: "last", 1: "", 2: "as text", 3: "no body", 6: "", 7: ""}


def test_contents_output_prefers_inlined(spark):
    job = {"response": {"inlinedResponses": {"inlinedResponses": [
        {"metadata": {"key": "0"}, "response": {"candidates": [{"content": {"parts": [{"text": "zero"}]}}]}},
        {"key": 1, "inlineResponse": {"text": " one "}}, {"response": {"text": "no key"}}, 4,
        {"metadata": {"key": "x"}, "response": {"text": "bad key"}}]}}}
    jobs = spark.createDataFrame([("a", json.dumps(job)), ("b", '{"response": {"responsesFile": "f"}}'),
                                  ("c", "{}")], "model_name string, document string")
    lines = spark.createDataFrame(
        [("a", 0, '{"key": 0, "response": {"text": "ignored"}}'),
         ("b", 0, '{"key": "5", "metadata": {"key": "6"}, "response": {"text": "five"}}'), ("b", 1, "oops")],
        "model_name string, line_no int, value string")
    got = {(r.model_name, r.probe_idx): r.response for r in batch_files.parse_job_output(jobs, lines, ["model_name"])
           .collect()}
    assert got == {("a", 0): "zero", ("a", 1): "one", ("b", 5): "five"}


def test_reasoning_fallback_and_job_state(spark):
    cases = {'{"content": " a "}': "a", '{"content": " ", "reasoning": "r "}': "r",
             '{"content": null, "reasoning_details": [{"text": " "}, {"text": "d"}]}': "d", '{}': "", '[]': ""}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.o for r in df.select("c", bj.reasoning_text(bj.parse(F.col("c"))).alias("o")).collect()} == cases
    states = {'{"metadata": {"state": "A"}, "state": "B"}': "A", '{"state": {"code": "C"}}': "C", '{"state": 1}': None}
    df = spark.createDataFrame([(c,) for c in states], "c string")
    assert {r.c: r.o for r in df.select("c", bj.job_state(bj.parse(F.col("c"))).alias("o")).collect()} == states


def test_alignment_pads_and_cuts(spark):
    models = spark.createDataFrame([("a", "d"), ("b", "d")], "model_name string, dataset string")
    probes = spark.createDataFrame([("d", 0, "p0"), ("d", 1, "p1")], "dataset string, probe_idx bigint, text string")
    given = spark.createDataFrame([("a", "d", 0, "x"), ("a", "d", 5, "late"), ("b", "d", 1, None)],
                                  "model_name string, dataset string, probe_idx bigint, response string")
    got = {(r.model_name, r.probe_idx): (r.prompt, r.response) for r in ops.align(models, probes, given).collect()}
    assert got == {("a", 0): ("p0", "x"), ("a", 1): ("p1", ""), ("b", 0): ("p0", ""), ("b", 1): ("p1", "")}


def test_batch_answers_keep_even_empty_ones(spark):
    schema = "model_name string, probe_idx bigint, response string"
    requests = spark.createDataFrame([("m", i, i // 2) for i in range(6)], "model_name string, probe_idx bigint, chunk int")
    batch = spark.createDataFrame([("m", 0, ""), ("m", 2, "unresolved")], schema)
    single = spark.createDataFrame([("m", 0, "no"), ("m", 1, "no"), ("m", 3, "yes")], schema)
    chunks = spark.createDataFrame([("m", 0)], "model_name string, chunk int")
    got = ops.merge_with_fallback(requests, batch, single, chunks).orderBy("probe_idx").collect()
    assert [r.response for r in got] == ["", "", "", "yes", "", ""]


def test_cache_rules(spark):
    documents = {
        "a": '{"model": "a", "complete": false, "items": [{"response": "x"}]}',
        "b": '{"model": "b", "complete": null, "items": [{"response": null}, 3, {"prompt": "p"}, {"response": "z"}]}',
        "c": '{"model": "c", "items": [{"response": " "}]}', "d": "[]", "e": '["one", true, null]', "f": "{oops",
        "g": '{"model": "g", "items": {"response": "x"}}'}
    df = spark.createDataFrame(list(documents.items()), "file string, document string")
    items = response_cache.usable_items(response_cache.cached_items(df)).orderBy("model_name", "probe_idx").collect()
    assert [(r.model_name, r.probe_idx, r.response) for r in items] == [
        ("b", 0, "None"), ("b", 1, ""), ("b", 2, "z"), ("e", 0, "one"), ("e", 1, "True"), ("e", 2, "None")]


def test_documents_say_whether_they_are_complete(spark):
    rows = spark.createDataFrame([("m", "d", i, "p", f"r{i}") for i in range(3)],
                                 "model_name string, dataset string, probe_idx bigint, prompt string, response string")
    whole = json.loads(response_cache.response_documents(rows, expected=3).first().document)
    assert whole["complete"] is True and whole["count"] == 3
    assert whole["items"] == [{"prompt": "p", "response": f"r{i}"} for i in range(3)]
    assert json.loads(response_cache.response_documents(rows, expected=4).first().document)["complete"] is False


def test_caches_are_parsed_once(spark):
    document = '{"model": "m", "dataset": "d", "items": [{"response": "x"}]}'
    documents = spark.createDataFrame([(document, "f")], "document string, file string")
    items = response_cache.usable_items(response_cache.cached_items(documents))
    assert [(r.model_name, r.dataset, r.response) for r in items.collect()] == [("m", "d", "x")]
    assert "parse_json" not in items._jdf.queryExecution().executedPlan().toString().lower()
