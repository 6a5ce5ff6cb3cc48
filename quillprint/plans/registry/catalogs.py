"""Registered queries on model names and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions import names
from quillprint.operators import catalog, filters, models as model_ops
from quillprint.plans import catalog_job
from quillprint.plans.registry.inputs import (MODELS_SQL, case_sql, contains_any_sql, models, quoted, r6, table)
from quillprint.session import scratch_path, settle
from quillprint.sources import catalogs as catalog_files

QUERIES = {}
NAME = "lower(model_name)"


def _names(select):
    return lambda spark, sf: models(spark, sf).select("ord", *select(F.col("model_name")))


def _named_sql(columns):
    return f"WITH {MODELS_SQL} SELECT ord, {columns} FROM models"


def _first_sql(cases, default):
    return case_sql([(contains_any_sql(NAME, p), quoted(v)) for p, v in cases], default)


# --- K: classification of names ---

PROVIDER_SQL = case_sql([(" OR ".join(f"starts_with({NAME}, {quoted(p)})" for p in prefixes), quoted(who))
                         for who, prefixes in fixed.PROVIDER_PREFIXES], quoted(fixed.DEFAULT_PROVIDER))
QUERIES["k1_provider"] = (_names(lambda n: [names.provider(n).alias("provider")]),
                          _named_sql(f"{PROVIDER_SQL} AS provider"))

QUERIES["k2_api_only"] = (
    lambda spark, sf: model_ops.is_api_only(models(spark, sf)).withColumn("list", F.lit("all")).unionByName(
        model_ops.is_api_only(models(spark, sf).where("model_name LIKE 'deepseek/%'")).withColumn(
            "list", F.lit("one provider"))).unionByName(
        model_ops.is_api_only(models(spark, sf).where("ord < 0")).withColumn("list", F.lit("empty"))),
    f"""WITH {MODELS_SQL}, kinds AS (SELECT model_name, {PROVIDER_SQL} <> 'huggingface' AS api FROM models)
        SELECT 'all' AS list, coalesce(bool_and(api), false) AS api_only FROM kinds
        UNION ALL SELECT 'one provider', coalesce(bool_and(api), false) FROM kinds WHERE model_name LIKE 'deepseek/%'
        UNION ALL SELECT 'empty', false""")

FAMILY_SQL = _first_sql([([f], f) for f, _, _ in fixed.MODEL_FAMILIES], "NULL")
FAMILY_ARCH_SQL = _first_sql([([f], a) for f, a, _ in fixed.MODEL_FAMILIES], "NULL")
FAMILY_ORG_SQL = _first_sql([([f], o) for f, _, o in fixed.MODEL_FAMILIES], "NULL")
QUERIES["k3_family"] = (
    _names(lambda n: [names.family(n)[c].alias(c) for c in ("family", "architecture", "organization")]),
    _named_sql(f"{FAMILY_SQL} AS family, {FAMILY_ARCH_SQL} AS architecture, {FAMILY_ORG_SQL} AS organization"))

NAME_ORG_SQL = "CASE WHEN contains(model_name, '/') THEN split_part(model_name, '/', 1) ELSE 'unknown' END"
TYPE_SQL = "json_extract_string(config, '$.model_type')"
TYPE_ORG_SQL = case_sql([(f"{TYPE_SQL} = '{f}'", quoted(o)) for f, _, o in fixed.MODEL_FAMILIES], "NULL")
ORGANIZATION_SQL = f"""CASE WHEN coalesce({TYPE_SQL}, '') <> '' THEN coalesce({TYPE_ORG_SQL}, {NAME_ORG_SQL})
                       ELSE coalesce({FAMILY_ORG_SQL}, {NAME_ORG_SQL}) END"""
CATALOG_FAMILY_SQL = f"coalesce(nullif({TYPE_SQL}, ''), {FAMILY_SQL}, 'unknown')"
QUERIES["k4_organization"] = (
    lambda spark, sf: catalog.classify(models(spark, sf)).select("model_name", "model_family", "organization"),
    f"""WITH {MODELS_SQL} SELECT model_name, {CATALOG_FAMILY_SQL} AS model_family, {ORGANIZATION_SQL} AS organization
        FROM models""")

QUERIES["k5_architecture_from_name"] = (
    _names(lambda n: [names.architecture_from_name(n).alias("architecture")]),
    _named_sql(_first_sql([(fixed.ENCODER_DECODER_NAMES, "encoder_decoder"), (fixed.ENCODER_ONLY_NAMES, "encoder_only"),
                           (fixed.DECODER_ONLY_NAMES, "decoder_only")], "'decoder_only'") + " AS architecture"))

CLASS_SQL = "json_extract_string(config, '$.architectures[0]')"


def _class_sql(encoder, tail, default):
    return case_sql([
        (contains_any_sql(CLASS_SQL, fixed.CONFIG_DECODER_CLASSES), "'decoder_only'"),
        (contains_any_sql(CLASS_SQL, fixed.CONFIG_ENCODER_DECODER_CLASSES), "'encoder_decoder'"),
        (f"{contains_any_sql(CLASS_SQL, encoder)} AND NOT contains({CLASS_SQL}, 'CausalLM')", "'encoder_only'"),
        *tail], default)


def _in(values):
    return "(" + ", ".join(quoted(v) for v in values) + ")"


CATALOG_ARCH_SQL = _class_sql(fixed.CONFIG_ENCODER_CLASSES_CATALOG, [
    (f"{TYPE_SQL} IN {_in(fixed.CONFIG_ENCODER_TYPES)}", "'encoder_only'"),
    (f"{TYPE_SQL} IN {_in(fixed.CONFIG_ENCODER_DECODER_TYPES)}", "'encoder_decoder'"),
    (f"{TYPE_SQL} IN {_in(fixed.CONFIG_DECODER_TYPES)}", "'decoder_only'")], "'unknown'")
QUERIES["k6_architecture_from_config"] = (
    lambda spark, sf: models(spark, sf).select(
        "ord", names.architecture_from_class(F.get_json_object("config", "$.architectures[0]")).alias("simple"),
        names.catalog_architecture(F.get_json_object("config", "$.architectures[0]"),
                                   F.get_json_object("config", "$.model_type")).alias("catalog")),
    _named_sql(f"{_class_sql(fixed.CONFIG_ENCODER_CLASSES, [], quoted('decoder_only'))} AS simple, "
               f"{CATALOG_ARCH_SQL} AS catalog"))

CHAT_NAME_SQL = contains_any_sql(NAME, fixed.CHAT_NAME_PATTERNS)
TEMPLATE_SQL = "coalesce(json_extract_string(config, '$.chat_template') <> '', false)"
QUERIES["k7_chat_model"] = (
    lambda spark, sf: models(spark, sf).withColumn("c", names.chat_info(
        F.col("model_name"), F.col("has_tokenizer_template"),
        F.coalesce(F.get_json_object("config", "$.chat_template") != "", F.lit(False)))).select(
        "ord", F.col("c.is_chat_model").alias("is_chat_model"),
        F.array_join("c.chat_indicators", ",").alias("indicators"), F.col("c.confidence").alias("confidence")),
    f"""WITH {MODELS_SQL},
        marks AS (SELECT ord, has_tokenizer_template AS tok, {TEMPLATE_SQL} AND NOT has_tokenizer_template AS cfg,
                         {CHAT_NAME_SQL} AS nm FROM models)
        SELECT ord, tok OR cfg OR nm AS is_chat_model,
               concat_ws(',', CASE WHEN cfg THEN 'has_chat_template_in_config' END,
                         CASE WHEN tok THEN 'has_chat_template_in_tokenizer_config' END,
                         CASE WHEN nm THEN 'name_pattern_match' END) AS indicators,
               CASE WHEN tok OR cfg THEN 'high' WHEN nm THEN 'medium' ELSE 'low' END AS confidence FROM marks""")


def _size_sql(patterns, name=NAME):
    """Count in billions and in units, from the first pattern that matches."""
    found = [f"nullif(regexp_extract({name}, {quoted(p)}, 1), '')" for p, _ in patterns]
    billions = case_sql([(f"{f} IS NOT NULL", f"CAST({f} AS DOUBLE)" + ("" if u == "b" else " / 1000"))
                         for f, (_, u) in zip(found, patterns)], "NULL")
    count = case_sql([(f"{f} IS NOT NULL", f"CAST(trunc(CAST({f} AS DOUBLE) * {'1e9' if u == 'b' else '1e6'}) AS BIGINT)")
                      for f, (_, u) in zip(found, patterns)], "NULL")
    return count, billions


def _category_sql(billions):
    return case_sql([(f"{billions} IS NULL", "'unknown'")]
                    + [(f"{billions} < {b}", quoted(c)) for b, c in fixed.SIZE_CATEGORIES],
                    quoted(fixed.LARGEST_SIZE_CATEGORY))


NAME_COUNT_SQL, NAME_BILLIONS_SQL = _size_sql(fixed.SIZE_PATTERNS)


def _config_int(key):
    return f"CAST(json_extract_string(config, '$.{key}') AS BIGINT)"


SIZE_CTE = f"""
    stated AS (SELECT *, coalesce({', '.join(_config_int(k) for k in fixed.CONFIG_COUNT_FIELDS)}) AS given,
                      12 * {_config_int('num_hidden_layers')} * {_config_int('hidden_size')} * {_config_int('hidden_size')}
                      + {_config_int('vocab_size')} * {_config_int('hidden_size')} AS computed,
                      {NAME_COUNT_SQL} AS name_count, {NAME_BILLIONS_SQL} AS name_billions FROM models),
    sized AS (SELECT *, coalesce(given, computed, name_count) AS parameter_count,
                     CASE WHEN coalesce(given, computed) IS NOT NULL THEN round(coalesce(given, computed) / 1e9, 2)
                          ELSE name_billions END AS parameter_count_billions,
                     coalesce(coalesce(given, computed) / 1e9, name_billions) AS exact_billions,
                     CASE WHEN given IS NOT NULL THEN 'config' WHEN computed IS NOT NULL THEN 'calculated'
                          WHEN name_count IS NOT NULL THEN 'name_pattern' ELSE 'not_available' END AS size_source
              FROM stated)"""
QUERIES["k8_parameter_count"] = (
    lambda spark, sf: models(spark, sf).withColumn("p", names.parameter_info(
        F.col("model_name"), F.try_parse_json("config"))).select(
        "ord", F.col("p.parameter_count").alias("parameter_count"),
        F.col("p.parameter_count_billions").alias("parameter_count_billions"),
        F.col("p.size_category").alias("size_category"), F.col("p.source").alias("source")),
    f"""WITH {MODELS_SQL}, {SIZE_CTE} SELECT ord, parameter_count, parameter_count_billions,
        {_category_sql('exact_billions')} AS size_category, size_source AS source FROM sized""")
QUERIES["k9_size_category"] = (
    _names(lambda n: [names.parameter_info(n)["size_category"].alias("size_category")]),
    _named_sql(f"{_category_sql(NAME_BILLIONS_SQL)} AS size_category"))
_BATCH_BILLIONS = _size_sql(fixed.BATCH_SIZE_PATTERNS)[1]
QUERIES["k10_batch_class"] = (
    _names(lambda n: [names.batch_class(n)["size_class"].alias("size_class"),
                      names.batch_class(n)["batch_size"].cast("bigint").alias("batch_size")]),
    f"""WITH {MODELS_SQL}, b AS (SELECT ord, {_BATCH_BILLIONS} AS x FROM models)
        SELECT ord, CASE WHEN x >= 60 THEN 'very_large' WHEN x >= 30 THEN 'large' WHEN x IS NOT NULL THEN 'standard'
                    ELSE 'medium' END AS size_class,
               CAST(CASE WHEN x >= 60 THEN 1 WHEN x >= 30 THEN 2 ELSE 8 END AS BIGINT) AS batch_size FROM b""")
QUERIES["k11_large_and_trusted"] = (
    _names(lambda n: [names.is_large(n).alias("is_large"), names.is_likely_large(n).alias("is_likely_large"),
                      names.needs_trusted_code(n).alias("needs_trusted_code")]),
    _named_sql(f"{contains_any_sql(NAME, fixed.LARGE_NAMES)} AS is_large, "
               f"{contains_any_sql(NAME, fixed.LARGE_NAMES + fixed.LIKELY_LARGE_EXTRA_NAMES)} AS is_likely_large, "
               f"{contains_any_sql(NAME, fixed.TRUST_CODE_NAMES)} AS needs_trusted_code"))
QUERIES["k12_quantization"] = (
    lambda spark, sf: models(spark, sf).select("ord", names.quantization(
        names.parameter_info(F.col("model_name"))["parameter_count_billions"], F.col("ord") % 11 == 0,
        F.col("ord") % 11 == 1, F.col("ord") % 11 == 2).alias("quantization")),
    f"""WITH {MODELS_SQL}, b AS (SELECT ord, {NAME_BILLIONS_SQL} AS x FROM models)
        SELECT ord, CASE ord % 11 WHEN 0 THEN '8bit' WHEN 1 THEN '4bit' WHEN 2 THEN 'none'
                    ELSE CASE WHEN x >= 7 THEN '8bit' ELSE 'none' END END AS quantization FROM b""")
_PRECISION = "split_part('float32,float16,load_8bit,4bit,bfloat16', ',', CAST(ord % 5 + 1 AS INT))"
_MEMORY_SQL = case_sql([(f"contains({NAME}, '{k}') AND f IS NOT NULL", f"{g} * f") for k, g in fixed.MEMORY_GB], "2.0")
QUERIES["k13_memory"] = (
    lambda spark, sf: models(spark, sf).select("ord", names.memory_gb(F.col("model_name"), F.expr(_PRECISION))
                                               .alias("gb")),
    f"""WITH {MODELS_SQL}, p AS (SELECT *, {_PRECISION} AS pr FROM models),
        f AS (SELECT *, CAST(CASE WHEN pr = 'float32' THEN 2.0 WHEN pr = 'float16' THEN 1.0
              WHEN contains(pr, '8bit') THEN 0.5 WHEN contains(pr, '4bit') THEN 0.25 END AS DOUBLE) AS f FROM p)
        SELECT ord, CAST({_MEMORY_SQL} AS DOUBLE) AS gb FROM f""")
QUERIES["k14_context_budget"] = (
    lambda spark, sf: models(spark, sf).withColumn("b", names.context_budget(
        F.when(F.col("ord") % 5 == 0, F.lit(None).cast("int")).otherwise((F.col("ord") * 13 % 4096 + 1).cast("int")),
        F.col("p_size") * 40)).select("ord", F.col("b.input_tokens").cast("bigint").alias("input_tokens"),
                                      F.col("b.new_tokens").cast("bigint").alias("new_tokens")),
    f"""WITH {MODELS_SQL},
        c AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN 1024 ELSE ord * 13 % 4096 + 1 END AS total, p_size * 40 AS want
              FROM models),
        n AS (SELECT ord, total, least(want, total // 2) AS new FROM c)
        SELECT ord, CAST(CASE WHEN total - new < 64 THEN 64 ELSE total - new END AS BIGINT) AS input_tokens,
               CAST(CASE WHEN total - new < 64 THEN greatest(1, total - 64) ELSE new END AS BIGINT) AS new_tokens
        FROM n""")

# --- F: filters on models ---

_GENERATIVE = "CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END"
QUERIES["f2_generative_models"] = (
    lambda spark, sf: filters.generative_models(table(spark, sf, "part").select(
        F.col("p_partkey").alias("ord"), F.expr(_GENERATIVE).alias("is_generative"))).select("ord", "is_generative"),
    f"""SELECT ord, is_generative FROM (SELECT p_partkey AS ord, {_GENERATIVE} AS is_generative FROM part)
        WHERE is_generative IS DISTINCT FROM false""")
QUERIES["f3_name_patterns"] = (
    lambda spark, sf: filters.by_name_patterns(models(spark, sf), ["Llama", "bert", "chat"], ["openai/", "roberta"])
    .select("model_name"),
    f"""WITH {MODELS_SQL} SELECT model_name FROM models
        WHERE (contains(model_name, 'Llama') OR contains(model_name, 'bert') OR contains(model_name, 'chat'))
          AND NOT (contains(model_name, 'openai/') OR contains(model_name, 'roberta'))""")
_INS = "split_part('text;text,image;image;audio,text', ';', CAST(ord % 4 + 1 AS INT))"
_OUTS = "split_part('text;image;text,audio', ';', CAST(p_size % 3 + 1 AS INT))"
QUERIES["f5_text_models"] = (
    lambda spark, sf: filters.text_to_text_models(models(spark, sf).select(
        "model_name", F.split(F.expr(_INS), ",").alias("input_modalities"),
        F.split(F.expr(_OUTS), ",").alias("output_modalities"))).select("model_name", "modality"),
    f"""WITH {MODELS_SQL}, m AS (SELECT model_name, {_INS} AS i, {_OUTS} AS o FROM models)
        SELECT model_name, replace(i, ',', '|') || ' -> ' || replace(o, ',', '|') AS modality FROM m
        WHERE list_contains(string_split(i, ','), 'text') AND list_contains(string_split(o, ','), 'text')""")
_TASK = "split_part('text-generation,fill-mask,text2text-generation,other', ',', CAST(ord % 4 + 1 AS INT))"
QUERIES["f6_most_downloaded"] = (
    lambda spark, sf: filters.most_downloaded(models(spark, sf).withColumn("task", F.expr(_TASK))).select(
        "model_name", "task", "downloads"),
    f"""WITH {MODELS_SQL} SELECT model_name, {_TASK} AS task, downloads FROM models
        WHERE {_TASK} IN ('text-generation', 'text2text-generation') ORDER BY downloads DESC, model_name LIMIT 12000""")
QUERIES["t1_top_downloads"] = (
    lambda spark, sf: filters.most_downloaded(models(spark, sf).withColumn("task", F.expr(_TASK)), 50).select(
        "model_name", "downloads"),
    f"""WITH {MODELS_SQL} SELECT model_name, downloads FROM models
        WHERE {_TASK} IN ('text-generation', 'text2text-generation') ORDER BY downloads DESC, model_name LIMIT 50""")
QUERIES["f10_supported_models"] = (
    lambda spark, sf: filters.supported_models(models(spark, sf)).select("model_name"),
    f"WITH {MODELS_SQL} SELECT model_name FROM models WHERE NOT {contains_any_sql(NAME, fixed.UNSUPPORTED_NAMES)}")

_FLAG = "CASE ord % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE NULL END"
_TEMPLATE = "<user>{}</user><assistant>"


def _chat_prompt(spark, sf):
    m = models(spark, sf).withColumn("flag", F.expr(_FLAG)).withColumn("use", F.col("p_size") % 2 == 0)
    prompt = F.col("p_brand")
    columns = [names.apply_chat_template(prompt, _TEMPLATE, names.wants_chat_template(
        rule, F.col("use"), F.col("has_tokenizer_template"), F.col("model_name"), F.col("flag"))).alias(rule)
        for rule in ("probes", "wrapper", "generate")]
    return m.select("ord", *columns)


_FILLED = "'<user>' || p_brand || '</user><assistant>'"
QUERIES["f14_chat_template"] = (_chat_prompt, f"""
    WITH {MODELS_SQL}, m AS (SELECT *, {_FLAG} AS flag, p_size % 2 = 0 AS use, has_tokenizer_template AS has FROM models)
    SELECT ord, CASE WHEN use AND has AND coalesce(flag, true) THEN {_FILLED} ELSE p_brand END AS probes,
           CASE WHEN has AND {contains_any_sql(NAME, fixed.CHAT_TEMPLATE_NAME_PATTERNS)} THEN {_FILLED}
                ELSE p_brand END AS wrapper,
           CASE WHEN use AND has THEN {_FILLED} ELSE p_brand END AS generate FROM m""")

# --- J: lookups and positions ---


def _known(spark, sf):
    """Catalog entries of two models out of three."""
    return models(spark, sf).where("ord % 3 <> 2").select(
        "model_name", F.when(F.col("ord") % 3 == 0, True).otherwise(F.lit(None).cast("boolean"))
        .alias("is_generative"), F.col("p_size").alias("size"))


_KNOWN_SQL = """known AS (SELECT model_name, CASE WHEN ord % 3 = 0 THEN true END AS is_generative, p_size AS size
                          FROM models WHERE ord % 3 <> 2)"""
QUERIES["j1_metadata_lookup"] = (
    lambda spark, sf: model_ops.with_metadata(models(spark, sf).select("ord", "model_name"), _known(spark, sf)).select(
        "ord", "in_catalog", "is_generative", F.col("size").cast("bigint").alias("size")),
    f"""WITH {MODELS_SQL}, {_KNOWN_SQL}
        SELECT ord, k.model_name IS NOT NULL AS in_catalog,
               CASE WHEN k.model_name IS NULL THEN true ELSE k.is_generative END AS is_generative,
               CAST(k.size AS BIGINT) AS size FROM models LEFT JOIN known k USING (model_name)""")


def _cached_split(spark, sf):
    m = models(spark, sf).select("model_name", F.lit("rand").alias("dataset"))
    cached, missing = model_ops.split_cached(m, _known(spark, sf).withColumn("dataset", F.lit("rand")))
    return cached.select("model_name", F.lit(True).alias("cached")).unionByName(
        missing.select("model_name", F.lit(False).alias("cached")))


QUERIES["j2_cached_split"] = (
    _cached_split, f"WITH {MODELS_SQL} SELECT model_name, ord % 3 <> 2 AS cached FROM models")


def _list_order(spark, sf):
    m = models(spark, sf)
    twice = m.select("ord", "model_name").unionByName(
        m.where("ord % 10 = 0").select((F.col("ord") + 1_000_000).alias("ord"), "model_name"))
    return model_ops.in_list_order(m.select("model_name", "downloads"), twice).select("ord", "model_name", "downloads")


QUERIES["j7_list_order"] = (_list_order, f"WITH {MODELS_SQL} SELECT ord, model_name, downloads FROM models")
QUERIES["t5_restore_order"] = (
    lambda spark, sf: model_ops.in_list_order(models(spark, sf).orderBy("model_name").select("model_name"),
                                              models(spark, sf).select("ord", "model_name")).select("ord", "model_name"),
    f"WITH {MODELS_SQL} SELECT ord, model_name FROM models")
_ALIAS_ID = "split_part('syn,squad,cqa,hs,wg,arc,mmlu,embed,mix,rand,rand_chinese,custom', ',', CAST(ord % 12 + 1 AS INT))"
QUERIES["j8_dataset_alias"] = (
    lambda spark, sf: models(spark, sf).select("ord", _dataset_name(F.expr(_ALIAS_ID)).alias("dataset")),
    _named_sql(case_sql([(f"{_ALIAS_ID} = '{k}'", f"'{v}'") for k, v in fixed.DATASET_ALIASES.items()], _ALIAS_ID)
               + " AS dataset"))


def _dataset_name(column):
    from quillprint.functions.text import dataset_name
    return dataset_name(column)


QUERIES["j9_round_robin"] = (
    lambda spark, sf: model_ops.assign_round_robin(models(spark, sf).withColumn(
        "worker", F.when(F.col("ord") % 7 == 1, F.lit(7))), [2, 3]).select(
        "ord", F.col("worker").cast("bigint").alias("worker")),
    f"""WITH {MODELS_SQL} SELECT ord, CAST(CASE WHEN ord % 7 = 1 THEN 7 WHEN ord % 2 = 0 THEN 2 ELSE 3 END AS BIGINT)
        AS worker FROM models""")
QUERIES["a17_total_seconds"] = (
    lambda spark, sf: model_ops.total_seconds(models(spark, sf).select(
        "ord", (F.col("p_size") / 7).alias("generation_seconds"), (F.col("downloads") / 1000).alias("reduce_seconds")),
        F.lit(1.5)).select("ord", r6("total_seconds").alias("total_seconds")),
    _named_sql("round(p_size / 7 + 1.5 + downloads / 1000, 6) + 0.0 AS total_seconds"))
QUERIES["a18_response_slices"] = (
    lambda spark, sf: model_ops.response_slices(models(spark, sf).select("ord", F.col("p_size").alias("responses")))
    .select("ord", "slice_start", "slice_end"),
    """SELECT p_partkey AS ord, CAST(sum(p_size) OVER (ORDER BY p_partkey) - p_size AS BIGINT) AS slice_start,
              CAST(sum(p_size) OVER (ORDER BY p_partkey) AS BIGINT) AS slice_end FROM part""")

# --- catalog job ---


def _catalog_input(spark, sf):
    return models(spark, sf).withColumn("error", F.when(F.col("ord") % 13 == 5, F.lit("config unreadable")))


CATALOG_CTE = f"""
    {MODELS_SQL}, {SIZE_CTE},
    classified AS (SELECT ord, model_name, CASE WHEN ord % 13 = 5 THEN 'config unreadable' END AS error,
        {CATALOG_FAMILY_SQL} AS model_family, {ORGANIZATION_SQL} AS organization,
        CASE WHEN config IS NULL THEN 'unknown' ELSE {CATALOG_ARCH_SQL} END AS architecture,
        {_category_sql('exact_billions')} AS size_category,
        has_tokenizer_template OR {TEMPLATE_SQL} OR {CHAT_NAME_SQL} AS is_chat_model, is_gated,
        CASE WHEN config IS NULL THEN 'unknown'
             ELSE coalesce(json_extract_string(config, '$.torch_dtype'), 'float32') END AS dtype FROM sized)"""
ROLLUP_SQL = """
    SELECT 'architecture' AS kind, architecture AS value, count(*) AS n FROM {0} GROUP BY architecture
    UNION ALL SELECT 'size', size_category, count(*) FROM {0} GROUP BY size_category
    UNION ALL SELECT 'organization', organization, count(*) FROM {0} GROUP BY organization
    UNION ALL SELECT 'chat_models', 'all', count(*) FROM {0} WHERE is_chat_model HAVING count(*) > 0
    UNION ALL SELECT 'gated_models', 'all', count(*) FROM {0} WHERE is_gated HAVING count(*) > 0"""
QUERIES["a8_catalog_rollup"] = (
    lambda spark, sf: catalog.rollup(catalog.classify(_catalog_input(spark, sf))),
    f"WITH {CATALOG_CTE}, good AS (SELECT * FROM classified WHERE error IS NULL) {ROLLUP_SQL.format('good')}")


def _flat(entries):
    return entries.select(
        "model_name", "error", "model_family", "organization", F.col("architecture.type").alias("architecture"),
        F.col("architecture.is_generative").alias("is_generative"),
        F.col("size.size_category").alias("size_category"), F.col("chat_model.is_chat_model").alias("is_chat_model"),
        F.col("precision.default_dtype").alias("dtype"),
        F.col("precision.supports_quantization").alias("supports_quantization"))


_FLAT_SQL = """
    SELECT model_name, error, CASE WHEN error IS NULL THEN model_family END AS model_family,
           CASE WHEN error IS NULL THEN organization END AS organization,
           CASE WHEN error IS NULL THEN architecture END AS architecture,
           CASE WHEN error IS NULL THEN architecture IN ('decoder_only', 'encoder_decoder') END AS is_generative,
           CASE WHEN error IS NULL THEN size_category END AS size_category,
           CASE WHEN error IS NULL THEN is_chat_model END AS is_chat_model,
           CASE WHEN error IS NULL THEN dtype END AS dtype,
           CASE WHEN error IS NULL THEN architecture = 'decoder_only' END AS supports_quantization FROM classified"""
QUERIES["e6_catalog_entries"] = (
    lambda spark, sf: _flat(catalog_job.build_catalog(_catalog_input(spark, sf)).entries),
    f"WITH {CATALOG_CTE} {_FLAT_SQL}")


def _job_with_existing(spark, sf):
    existing = catalog.classify(models(spark, sf).where("ord % 3 = 0"))
    return catalog_job.build_catalog(_catalog_input(spark, sf), existing)


QUERIES["a9_outcome_counts"] = (
    lambda spark, sf: catalog.outcome_counts(_job_with_existing(spark, sf).outcomes),
    """WITH o AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'skipped' WHEN p_partkey % 13 = 5 THEN 'failed'
                         ELSE 'success' END AS s FROM part)
       SELECT count(*) FILTER (s = 'success') AS successful, count(*) FILTER (s = 'failed') AS failed,
              count(*) FILTER (s = 'skipped') AS skipped, count(*) AS total FROM o""")
QUERIES["u3_existing_and_new"] = (
    lambda spark, sf: _job_with_existing(spark, sf).entries.select("model_name", "error"),
    f"""WITH {MODELS_SQL} SELECT model_name, CASE WHEN ord % 3 <> 0 AND ord % 13 = 5 THEN 'config unreadable' END
        AS error FROM models""")


def _catalog_file(spark, sf):
    """A catalog with repeated names, written as documents and read back."""
    path = scratch_path(spark, "catalog")
    entries = settle(catalog.classify(models(spark, sf)), "entries")
    twice = entries.withColumn("pos", F.lit(0)).unionByName(entries.where("organization = 'Google'").withColumn(
        "organization", F.lit("Second")).withColumn("pos", F.lit(1)))
    # documents of about 500 models
    block = F.floor(F.regexp_extract("model_name", r"-v(\d+)$", 1).cast("bigint") / 500)
    fields = [c for c in entries.columns]
    documents = twice.groupBy(block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "pos", "model_name", F.struct(*fields).alias("m")))), lambda x: x["m"]).alias("models"))
    documents.select("models").write.option("maxRecordsPerFile", 1).json(path)
    return catalog_files.read_catalog(spark, path)


QUERIES["s2_catalog_last_entry"] = (
    lambda spark, sf: catalog_files.last_entries(_catalog_file(spark, sf)).select(
        "model_name", "organization", F.col("size.size_category").alias("size_category")),
    f"""WITH {CATALOG_CTE} SELECT model_name, CASE WHEN organization = 'Google' THEN 'Second' ELSE organization END
        AS organization, size_category FROM classified""")
QUERIES["s3_chat_flags"] = (
    lambda spark, sf: catalog_files.chat_flags(
        models(spark, sf).select("model_name").unionByName(models(spark, sf).select(
            F.concat("model_name", F.lit("-unlisted")).alias("model_name"))), _catalog_file(spark, sf)),
    f"""WITH {CATALOG_CTE} SELECT model_name, is_chat_model FROM classified
        UNION ALL SELECT model_name || '-unlisted', false FROM classified""")


def _catalog_tables(spark, sf):
    path = scratch_path(spark, "catalog")
    job = catalog_job.build_catalog(_catalog_input(spark, sf))
    catalog_files.write_catalog(job.entries, job.outcomes, path)
    return spark.read.schema("kind string, value string, n bigint").json(f"{path}/statistics")


QUERIES["s16_catalog_report"] = (
    _catalog_tables,
    f"WITH {CATALOG_CTE}, good AS (SELECT * FROM classified WHERE error IS NULL) {ROLLUP_SQL.format('good')}")


def _export(spark, sf):
    path = scratch_path(spark, "export")
    chosen = filters.most_downloaded(models(spark, sf).withColumn("task", F.expr(_TASK)))
    catalog_files.write_catalog_export(catalog_files.provider_export(chosen, "huggingface"), path)
    return spark.read.schema("model_id string, provider string, task string, downloads bigint").json(path)


QUERIES["s17_catalog_export"] = (_export, f"""
    WITH {MODELS_SQL} SELECT model_name AS model_id, 'huggingface' AS provider, {_TASK} AS task, downloads FROM models
    WHERE {_TASK} IN ('text-generation', 'text2text-generation') ORDER BY downloads DESC, model_name LIMIT 12000""")
QUERIES["k3_default_metadata"] = (
    lambda spark, sf: catalog.default_metadata(models(spark, sf)),
    f"""WITH {MODELS_SQL}, d AS (SELECT *, coalesce({FAMILY_ARCH_SQL}, 'decoder_only') AS a FROM models)
        SELECT model_name, a AS architecture_type, a IN ('decoder_only', 'encoder_decoder') AS is_generative,
               {NAME_COUNT_SQL} AS parameter_count, {NAME_BILLIONS_SQL} AS parameter_count_billions,
               {CHAT_NAME_SQL} AS is_chat_model FROM d""")
