"""Registered queries that write files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillprint.functions.encoders import encode_texts
from quillprint.operators import reduce
from quillprint.plans.registry.inputs import (EMBEDDINGS_SQL, MODELS_SQL, SIGNATURES_SQL, concat_sql, embeddings,
                                              long_signature, models, probes, r6, reduced_sql, signatures, table)
from quillprint.session import scratch_path
from quillprint.sources import datasets, lines, results, signature_files as sf_io

QUERIES = {}


def _in_order(df, order):
    """Ranges of rows in order: the written part files, taken by name, hold the rows in order."""
    return df.repartitionByRange(order).sortWithinPartitions(order)


def _model_list(raw_comments):
    def run(spark, sf):
        path = scratch_path(spark, "models")
        m = models(spark, sf)
        line = (F.when(F.col("ord") % 10 == 3, F.lit("# a comment")).when(F.col("ord") % 10 == 4, F.lit(" \t"))
                .when(F.col("ord") % 10 == 5, F.lit("  # indented")).otherwise(
            F.concat(F.lit(" "), F.col("model_name"), F.lit("\t"))))
        _in_order(m.select("ord", line.alias("value")), "ord").select("value").write.text(path)
        return lines.require_models(lines.read_model_list(spark, path, raw_comments), path)
    return run


QUERIES["s1_model_list"] = (_model_list(False), f"""
    WITH {MODELS_SQL} SELECT row_number() OVER (ORDER BY ord) - 1 AS ord, model_name FROM models
    WHERE ord % 10 NOT IN (3, 4, 5)""")
QUERIES["s1_model_list_raw_comments"] = (_model_list(True), f"""
    WITH {MODELS_SQL} SELECT row_number() OVER (ORDER BY ord) - 1 AS ord,
           CASE WHEN ord % 10 = 5 THEN '# indented' ELSE model_name END AS model_name
    FROM models WHERE ord % 10 NOT IN (3, 4)""")


def _chosen_models(spark, sf):
    path = scratch_path(spark, "models")
    listed = models(spark, sf).select("ord", F.col("model_name").alias("value"))
    _in_order(listed, "ord").select("value").write.text(path)
    return lines.choose_models(spark, models_file=path, max_models=500).select("ord", "model_name")


QUERIES["f13_choose_models"] = (_chosen_models, f"""
    WITH {MODELS_SQL} SELECT ord, model_name FROM models ORDER BY ord LIMIT 500""")

QUERIES["s7_dataset_reader"] = (
    lambda spark, sf: datasets.read_dataset(spark, f"{sf}/documents.parquet", "text", "doc_id", 300, dataset="docs")
    .select("dataset", "probe_idx", F.md5(F.col("text").cast("binary")).alias("text")),
    "SELECT 'docs' AS dataset, doc_id AS probe_idx, md5(text) AS text FROM documents ORDER BY doc_id LIMIT 300")


QUERIES["s7_named_dataset"] = (
    lambda spark, sf: datasets.read_named_dataset(spark, "rand", f"{sf}/documents.parquet", "doc_id").unionByName(
        datasets.read_named_dataset(spark, "embed", f"{sf}/documents.parquet", "doc_id")).select(
        "dataset", "probe_idx", F.md5(F.col("text").cast("binary")).alias("text")),
    """(SELECT 'rand' AS dataset, doc_id AS probe_idx, md5(text) AS text FROM documents ORDER BY doc_id LIMIT 600)
       UNION ALL SELECT 'embedllm', doc_id, md5(text) FROM documents""")


def _prompt_csv(spark, sf):
    path = scratch_path(spark, "prompts")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("question"), F.lit("x").alias("other"))
    (_in_order(rows, "doc_id").drop("doc_id").write.option("header", True).option("escape", '"')
     .option("quoteAll", True).csv(path))
    return datasets.read_prompt_csv(spark, path).select(
        "probe_idx", F.md5(F.col("text").cast("binary")).alias("text"))


QUERIES["s8_prompt_csv"] = (_prompt_csv, """
    SELECT row_number() OVER (ORDER BY doc_id) - 1 AS probe_idx,
           md5(CASE WHEN doc_id % 9 <> 0 THEN text ELSE 'nan' END) AS text FROM documents""")


def _string_array(spark, sf):
    path = scratch_path(spark, "array")
    make = lambda: table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    return datasets.read_string_array(spark, path, "rand", generate=make).select(
        "dataset", "probe_idx", F.md5(F.col("text").cast("binary")).alias("text"))


QUERIES["s9_string_array"] = (_string_array, """
    SELECT 'rand' AS dataset, row_number() OVER (ORDER BY doc_id) - 1 AS probe_idx, md5(text) AS text FROM documents""")


def _json(spark, sf):
    path = scratch_path(spark, "signatures")
    sf_io.write_json(sf_io.with_metadata(signatures(spark, sf).drop("label"), "csv_loaded", "rand_2"), path)
    back = sf_io.read_json(spark, path)
    return back.select("model_name", F.col("metadata.probe_set_id").alias("probe_set_id"),
                       F.col("metadata.dna_dimension").alias("width"), F.posexplode("signature").alias("pos", "v")) \
        .select("model_name", "probe_set_id", "width", F.col("pos").cast("bigint").alias("pos"), r6("v").alias("value"))


_VALUES_SQL = "CAST(i - 1 AS BIGINT) AS pos, round(s[i], 6) + 0.0 AS value FROM sig, range(1, len(s) + 1) t(i)"
QUERIES["s10_signature_json"] = (_json, f"""
    WITH {SIGNATURES_SQL} SELECT model_name, 'rand_2' AS probe_set_id, len(s) AS width, {_VALUES_SQL}""")


def _value_csv(spark, sf):
    path = scratch_path(spark, "signatures")
    sf_io.write_value_csv(signatures(spark, sf), path)
    return long_signature(sf_io.read_value_csv(spark, path), "model_name")


QUERIES["s11_single_csv"] = (_value_csv, f"WITH {SIGNATURES_SQL} SELECT model_name, {_VALUES_SQL}")


def _alike_names(spark, sf):
    """Names that differ in a slash, a percent sign or a plus only."""
    path = scratch_path(spark, "signatures")
    sign = F.element_at(F.array(F.lit("/"), F.lit("_"), F.lit("%2F"), F.lit("+")), (F.col("ord") % 4 + 1).cast("int"))
    named = signatures(spark, sf).withColumn("model_name", F.concat(F.lit("org"), sign, F.floor(F.col("ord") / 4)))
    sf_io.write_value_csv(named, path)
    return long_signature(sf_io.read_value_csv(spark, path), "model_name")


QUERIES["s11_alike_names"] = (_alike_names, f"""
    WITH {SIGNATURES_SQL} SELECT 'org' || ['/', '_', '%2F', '+'][CAST(ord % 4 + 1 AS INT)] || (ord // 4) AS model_name,
    {_VALUES_SQL}""")


def _wide_csv(spark, sf):
    path = scratch_path(spark, "signatures")
    short = F.when(F.col("ord") % 5 == 0, F.slice("signature", 1, 60)).otherwise(F.col("signature"))
    sf_io.write_wide_csv(signatures(spark, sf).withColumn("signature", short), path, 64)
    back = sf_io.read_wide_csv(spark, path)
    return back.select("model_name", F.posexplode("signature").alias("pos", "v")).where(~F.isnan("v")).select(
        "model_name", F.col("pos").cast("bigint").alias("pos"), r6("v").alias("value"))


QUERIES["s12_wide_csv"] = (
    _wide_csv, f"WITH {SIGNATURES_SQL} SELECT model_name, {_VALUES_SQL} WHERE ord % 5 <> 0 OR i <= 60")


def _folder(spark, sf):
    """CSV files and JSON files side by side, with a broken one among them."""
    path = scratch_path(spark, "folder")
    s = signatures(spark, sf)
    sf_io.write_value_csv(s.where("ord % 2 = 0"), path)
    spark.createDataFrame([("not a signature",)], "value string").coalesce(1).write.text(f"{path}/broken_dna.json")
    sf_io.write_json(sf_io.with_metadata(s.where("ord % 2 = 1")), f"{path}/rest_dna.json")
    return long_signature(sf_io.read_signatures(spark, path), "model_name")


QUERIES["s13_signature_folder"] = (_folder, f"WITH {SIGNATURES_SQL} SELECT model_name, {_VALUES_SQL}")


def _unreadable(spark, sf):
    """Every sixth signature is spoilt on its way into the folder: words for numbers in CSV, no signature in JSON."""
    path = scratch_path(spark, "folder")
    s = signatures(spark, sf)
    sf_io.write_value_csv(s.where("ord % 2 = 0 AND ord % 6 <> 0"), path)
    words = F.transform("signature", lambda x: F.lit("word"))
    sf_io.write_value_csv(s.where("ord % 6 = 0").withColumn("signature", words), f"{path}/spoilt_dna.csv")
    spoilt = F.when(F.col("ord") % 6 != 3, F.col("signature"))
    sf_io.write_json(sf_io.with_metadata(s.where("ord % 2 = 1").withColumn("signature", spoilt)), f"{path}/rest_dna.json")
    return sf_io.read_folder_report(spark, path).select(
        "model_name", F.size(F.coalesce("signature", F.array().cast("array<double>"))).cast("bigint").alias("values"),
        "reason")


QUERIES["s13_unreadable_files"] = (_unreadable, f"""
    WITH {SIGNATURES_SQL} SELECT model_name, CASE WHEN ord % 3 = 0 THEN 0 ELSE len(s) END AS "values",
    CASE ord % 6 WHEN 0 THEN 'no values' WHEN 3 THEN 'no signature' END AS reason FROM sig""")


def _summary(spark, sf):
    path = scratch_path(spark, "summary")
    made = reduce.signatures(embeddings(spark, sf), 16)
    sf_io.write_summaries(sf_io.summaries(made, "cqa", 16, "random_projection"), path)
    back = spark.read.json(path)
    return back.select("model_name", "dataset_full", F.col("num_probes").alias("num_probes"), "output_file",
                       r6("signature_stats.mean").alias("mean"), r6("signature_stats.l2_norm").alias("l2_norm"))


QUERIES["s14_run_summary"] = (_summary, f"""
    WITH {EMBEDDINGS_SQL}, {reduced_sql('emb', 'model_name', 16, 64)},
    sig AS (SELECT model_name, any_value(n) AS n, avg(y) AS m, sqrt(sum(y * y)) AS l2
            FROM proj JOIN ranked USING (model_name, probe_idx) WHERE rank = 0 GROUP BY model_name)
    SELECT model_name, 'commonsense_qa' AS dataset_full, n AS num_probes,
           'out/cqa/' || model_name || '/' || model_name || '_dna.json' AS output_file,
           round(m, 6) + 0.0 AS mean, round(l2, 6) + 0.0 AS l2_norm FROM sig""")


def _embedding_cache(spark, sf):
    path = scratch_path(spark, "embeddings")
    texts = probes(spark, sf)

    def encode(df):
        return encode_texts(df, "text", width=16)

    datasets.cached_embeddings(texts.where("probe_idx % 3 = 0"), path, encode, ["dataset", "probe_idx"])
    full = datasets.cached_embeddings(texts, path, encode, ["dataset", "probe_idx"])
    return full.groupBy("dataset").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.aggregate(
        F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)).alias("words"))


def _words_sql():
    from quillprint.plans.registry.inputs import word_count_sql
    return word_count_sql("text")


QUERIES["s21_embedding_cache"] = (_embedding_cache, f"""
    SELECT lang AS dataset, count(*) AS texts, CAST(sum({_words_sql()}) AS DOUBLE) AS words FROM documents
    GROUP BY lang""")


def _results(spark, sf):
    path = scratch_path(spark, "results")
    rows = models(spark, sf).select("ord", "model_name", "downloads")
    results.save_results(rows, f"{path}.json")
    results.save_results(rows, f"{path}.parquet")
    json = results.load_results(spark, f"{path}.json", rows.schema)
    parquet = results.load_results(spark, f"{path}.parquet")
    return json.select(F.lit("json").alias("form"), "*").unionByName(parquet.select(F.lit("parquet").alias("form"), "*"))


QUERIES["s22_result_store"] = (_results, f"""
    WITH {MODELS_SQL} SELECT form, ord, model_name, downloads FROM models, (SELECT unnest(['json', 'parquet']) AS form)
    """)
