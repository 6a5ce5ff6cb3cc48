"""Registered queries on texts: cleaning, statistics, coverage, order, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.functions import text as fn
from quillprint.operators import filters, ordering, probes as probe_ops, textstats
from quillprint.plans.registry.inputs import (MODELS_SQL, case_sql, contains_any_sql, heavy_table, models, probes, quoted,
                                              r6, strip_sql, word_count_sql, words_sql, W)

QUERIES = {}
DOCS = "documents"


def _docs(spark, sf):
    return heavy_table(spark, sf, DOCS)


def _rounded(df, names):
    return df.select(*[r6(c).alias(c) if kind == "double" else F.col(c).cast("bigint").alias(c)
                       if kind in ("int", "bigint") else F.col(c) for c, kind in df.select(*names).dtypes])


# --- A1 to A7, G10 ---

_A1 = ["count", "total_characters", "total_words", "unique_words", "avg_length", "avg_word_count", "min_length",
       "max_length", "length_std", "word_count_std", "vocabulary_size", "type_token_ratio"]


def _a1_sql(by=""):
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    join = f"JOIN vocab USING ({by})" if by else ", vocab"
    return f"""
    WITH sized AS (SELECT {keys}length(text) AS c, {word_count_sql('text')} AS w FROM documents),
    vocab AS (SELECT {keys}count(DISTINCT word) AS unique_words
              FROM (SELECT {keys}unnest({words_sql('text')}) AS word FROM documents) {group}),
    figures AS (SELECT {keys}count(*) AS count, CAST(sum(c) AS BIGINT) AS total_characters,
        CAST(sum(w) AS BIGINT) AS total_words, round(avg(c), 6) + 0.0 AS avg_length,
        round(avg(w), 6) + 0.0 AS avg_word_count, CAST(min(c) AS BIGINT) AS min_length,
        CAST(max(c) AS BIGINT) AS max_length, round(stddev_pop(c), 6) + 0.0 AS length_std,
        round(stddev_pop(w), 6) + 0.0 AS word_count_std FROM sized {group})
    SELECT figures.*, unique_words, unique_words AS vocabulary_size,
           round(unique_words / total_words, 6) + 0.0 AS type_token_ratio FROM figures {join}"""


QUERIES["a1_corpus_statistics"] = (
    lambda spark, sf: _rounded(textstats.corpus_statistics(_docs(spark, sf)), _A1), _a1_sql())
QUERIES["a1_statistics_by_language"] = (
    lambda spark, sf: _rounded(textstats.corpus_statistics(_docs(spark, sf), by=["lang"]), ["lang", *_A1]),
    _a1_sql("lang"))
QUERIES["a2_dataset_info"] = (
    lambda spark, sf: _rounded(textstats.dataset_info(probes(spark, sf)).withColumn(
        "sample_texts", F.md5(F.array_join("sample_texts", "\n").cast("binary"))),
        ["dataset", "num_samples", "avg_length", "std_length", "min_length", "max_length", "sample_texts"]),
    f"""WITH sized AS (SELECT lang AS dataset, {word_count_sql('text')} AS w FROM documents),
        ranked AS (SELECT lang AS dataset, text, doc_id,
                          row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
        shown AS (SELECT dataset, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS sample_texts FROM ranked
                  WHERE r <= 5 GROUP BY dataset)
        SELECT dataset, count(*) AS num_samples, round(avg(w), 6) + 0.0 AS avg_length,
               round(stddev_pop(w), 6) + 0.0 AS std_length, CAST(min(w) AS BIGINT) AS min_length,
               CAST(max(w) AS BIGINT) AS max_length, any_value(sample_texts) AS sample_texts
        FROM sized JOIN shown USING (dataset) GROUP BY dataset""")

_DOMAIN_SQL = ", ".join(
    f"round(avg(CASE WHEN {contains_any_sql('lower(text)', words)} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS domain_{d}"
    for d, words in fixed.DOMAIN_KEYWORDS.items())
_COMPLEXITY = ("(length(text) + 2 * (length(text) - length(replace(text, ',', ''))) "
               "+ 3 * (length(text) - length(replace(text, ';', ''))))")
_QUESTION = f"(CASE WHEN {strip_sql('text')} LIKE '%?' THEN 1.0 ELSE 0.0 END)"
_WORDS = word_count_sql("text")
_COVERAGE_SQL = {
    "length_diversity": f"""round(avg({_WORDS}), 6) + 0.0 AS length_mean,
        round(stddev_pop({_WORDS}), 6) + 0.0 AS length_std, CAST(min({_WORDS}) AS BIGINT) AS length_min,
        CAST(max({_WORDS}) AS BIGINT) AS length_max,
        round(stddev_pop({_WORDS}) / avg({_WORDS}), 6) + 0.0 AS length_cv""",
    "lexical_diversity": f"""CAST(sum({_WORDS}) AS BIGINT) AS total_words, any_value(unique_words) AS unique_words,
        round(any_value(unique_words) / sum({_WORDS}), 6) + 0.0 AS ttr""",
    "syntactic_diversity": f"""round(avg({_QUESTION}), 6) + 0.0 AS question_ratio,
        round(1 - avg({_QUESTION}), 6) + 0.0 AS statement_ratio, round(avg({_WORDS}), 6) + 0.0 AS avg_sentence_length""",
    "domain_coverage": _DOMAIN_SQL,
    "complexity_range": f"""CAST(min({_COMPLEXITY}) AS BIGINT) AS min_complexity,
        CAST(max({_COMPLEXITY}) AS BIGINT) AS max_complexity, round(avg({_COMPLEXITY}), 6) + 0.0 AS mean_complexity,
        CAST(max({_COMPLEXITY}) - min({_COMPLEXITY}) AS BIGINT) AS complexity_range""",
}


def _coverage_sql(metrics):
    return f"""
    WITH vocab AS (SELECT source, count(DISTINCT word) AS unique_words
                   FROM (SELECT source, unnest({words_sql('text')}) AS word FROM documents) GROUP BY source)
    SELECT source, {', '.join(_COVERAGE_SQL[m] for m in metrics)} FROM documents JOIN vocab USING (source)
    GROUP BY source"""


def _coverage(metrics):
    def run(spark, sf):
        report = textstats.coverage(_docs(spark, sf), metrics, by=["source"])
        return _rounded(report, report.columns)
    return run


for _id, _metric in zip(("a3", "a4", "a5", "a6", "a7"), textstats.COVERAGE_METRICS):
    QUERIES[f"{_id}_{_metric}"] = (_coverage([_metric]), _coverage_sql([_metric]))
QUERIES["g10_coverage_report"] = (_coverage(None), _coverage_sql(textstats.COVERAGE_METRICS))

# --- C: cleaning and names ---

QUERIES["c1_clean_text"] = (
    lambda spark, sf: _docs(spark, sf).select("doc_id", fn.clean_text(F.concat(
        F.lit(" \x01\t"), F.translate("text", "n", "\x02"), F.lit("　 \x1f "))).alias("t")).select(
        "doc_id", F.md5(F.col("t").cast("binary")).alias("cleaned"), F.length("t").cast("bigint").alias("chars")),
    f"""WITH dirty AS (SELECT doc_id, ' ' || chr(1) || chr(9) || replace(text, 'n', chr(2)) || chr(12288) || ' '
                              || chr(31) || ' ' AS t FROM documents),
        cleaned AS (SELECT doc_id, regexp_replace({strip_sql(f"regexp_replace(t, '[{W}]+', ' ', 'g')")},
                                                  '[\\x00-\\x1f]', '', 'g') AS t FROM dirty)
        SELECT doc_id, md5(t) AS cleaned, CAST(length(t) AS BIGINT) AS chars FROM cleaned""")

QUERIES["c2_normalize_model_name"] = (
    lambda spark, sf: models(spark, sf).select("ord", fn.normalize_model_name(F.concat(
        F.col("model_name"), F.lit(": a\\b"))).alias("name")),
    f"""WITH {MODELS_SQL} SELECT ord, lower(translate(model_name || ': a\\b', '/\\: -', '_____')) AS name FROM models""")
QUERIES["c3_safe_filename"] = (
    lambda spark, sf: models(spark, sf).select("ord", fn.safe_filename(F.when(
        F.col("ord") % 9 == 0, F.lit("//..__")).otherwise(F.concat(F.lit('.<"'), F.col("model_name"), F.lit('?*|_.'))))
        .alias("file")),
    f"""WITH {MODELS_SQL},
        raw AS (SELECT ord, CASE WHEN ord % 9 = 0 THEN '//..__' ELSE '.<"' || model_name || '?*|_.' END AS f
                FROM models),
        safe AS (SELECT ord, trim(regexp_replace(regexp_replace(f, '[<>:"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), '_.')
                 AS f FROM raw)
        SELECT ord, CASE WHEN f = '' THEN 'unnamed' ELSE f END AS file FROM safe""")
QUERIES["c4_output_paths"] = (
    lambda spark, sf: models(spark, sf).select(
        "ord", fn.signature_file("out", F.lit("squad,arc"), F.col("model_name")).alias("signature_path"),
        fn.response_file("out", F.lit("squad,arc"), F.col("model_name")).alias("response_path")),
    f"""WITH {MODELS_SQL}, keyed AS (SELECT ord, translate(model_name, '/:', '__') AS k FROM models)
        SELECT ord, 'out/squad_arc/' || k || '/' || k || '_dna.json' AS signature_path,
               'out/squad_arc/' || k || '/responses.json' AS response_path FROM keyed""")
QUERIES["c5_probe_cache_key"] = (
    lambda spark, sf: models(spark, sf).select("ord", fn.probe_cache_key(F.concat(
        F.lit(" "), F.col("model_name"), F.lit(", x ")), F.col("p_size"), F.col("ord")).alias("cache_key")),
    f"""WITH {MODELS_SQL} SELECT ord, 'dataset_' || regexp_replace(trim(' ' || model_name || ', x '),
        '[^A-Za-z0-9_-]+', '_', 'g') || '_n' || p_size || '_seed' || ord AS cache_key FROM models""")
QUERIES["c6_identifiers"] = (
    lambda spark, sf: models(spark, sf).select(
        "ord", fn.probe_set_id(F.lit("rand"), F.col("p_size")).alias("probe_set_id"),
        fn.extraction_method(F.lower("p_type"), F.lit("concat")).alias("method"),
        fn.normalized_method(fn.extraction_method(F.lower("p_type"), F.lit("max")), "l2").alias("normalized")),
    f"""WITH {MODELS_SQL} SELECT ord, 'rand_' || p_size AS probe_set_id,
        'text_response_embeddings_' || lower(p_type) || '_concat' AS method,
        'text_response_embeddings_' || lower(p_type) || '_max_normalized_l2' AS normalized FROM models""")
_STEM = "CASE ord % 7 WHEN 0 THEN 'my_LLM_list' WHEN 1 THEN 'Foo-List' WHEN 2 THEN 'names_list' WHEN 3 THEN 'wishlist' " \
        "WHEN 4 THEN 'metadata_x' WHEN 5 THEN '' ELSE p_brand END"
QUERIES["c7_catalog_file_name"] = (
    lambda spark, sf: models(spark, sf).select("ord", fn.catalog_file_stem(F.expr(_STEM)).alias("stem")),
    f"""WITH {MODELS_SQL}, s AS (SELECT ord, {_STEM} AS stem FROM models)
        SELECT ord, CASE WHEN contains(lower(stem), 'llm_list') THEN regexp_replace(stem, '(?i)llm_list', 'llm_metadata')
            WHEN lower(stem) LIKE '%\\_list' ESCAPE '\\' THEN left(stem, length(stem) - 5) || '_metadata'
            WHEN lower(stem) LIKE '%-list' THEN left(stem, length(stem) - 5) || '-metadata'
            WHEN lower(stem) LIKE '%list' THEN left(stem, length(stem) - 4) || 'metadata'
            WHEN stem <> '' AND NOT contains(lower(stem), 'metadata') THEN stem || '_metadata'
            ELSE 'llm_metadata' END AS stem FROM s""")
QUERIES["c8_meaningful_length"] = (
    lambda spark, sf: _docs(spark, sf).select("doc_id", fn.meaningful_length(F.translate("text", ".,e", "。，；"))
                                              .cast("bigint").alias("chars")),
    """SELECT doc_id, CAST(length(regexp_replace(text, '[.,e]', '', 'g')) AS BIGINT) AS chars FROM documents""")
QUERIES["c9_third_person"] = (
    lambda spark, sf: textstats.vocabulary(_docs(spark, sf)).select("word", fn.third_person(F.col("word"))
                                                                    .alias("verb")),
    f"""WITH v AS (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents)
        SELECT word, CASE WHEN regexp_matches(word, '(s|sh|ch|x|z|o)$') THEN word || 'es'
            WHEN word LIKE '%y' AND right(word, 2) NOT IN ('ay', 'ey', 'oy', 'uy')
                THEN left(word, length(word) - 1) || 'ies' ELSE word || 's' END AS verb FROM v""")
_SPEC = "split_part('squad, cqa;hs;wg,arc ,mmlu;embed;syn;other;rand,rand_chinese', ';', CAST(p_size % 7 + 1 AS INT))"
_ALIAS_SQL = case_sql([(f"trim(part) = '{k}'", f"'{v}'") for k, v in fixed.DATASET_ALIASES.items()], "trim(part)")
QUERIES["c10_dataset_spec"] = (
    lambda spark, sf: models(spark, sf).select("ord", F.posexplode(fn.dataset_names(F.expr(_SPEC))).alias(
        "place", "dataset")).select("ord", F.col("place").cast("bigint").alias("place"), "dataset"),
    f"""WITH {MODELS_SQL}, specs AS (SELECT ord, string_split({_SPEC}, ',') AS parts FROM models),
        split AS (SELECT ord, i - 1 AS place, parts[i] AS part FROM specs, range(1, len(parts) + 1) t(i))
        SELECT ord, CAST(place AS BIGINT) AS place, {_ALIAS_SQL} AS dataset FROM split""")

# --- F and T: filters, prefixes, shuffles, samples ---

_BLANKED = "CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN chr(9) || ' ' WHEN doc_id % 10 = 2 THEN '' " \
           "ELSE text END"
QUERIES["f1_non_blank_probes"] = (
    lambda spark, sf: filters.non_blank_probes(_docs(spark, sf).select("doc_id", F.expr(_BLANKED).alias("text")))
    .select("doc_id"),
    f"""SELECT doc_id FROM (SELECT doc_id, {_BLANKED} AS text FROM documents) WHERE {strip_sql('text')} <> ''""")

_RUNS = contains_any_sql("lower(line)", [c * 4 for c in "abcdefghijklmnopqrstuvwxyz"])
QUERIES["f7_valid_probes"] = (
    lambda spark, sf: _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    .select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), fn.is_valid_probe(F.col("line"))
            .alias("valid")),
    f"""WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
        each AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM lines, range(1, len(l) + 1) t(i))
        SELECT doc_id, CAST(line_no AS BIGINT) AS line_no,
               coalesce(length({strip_sql('line')}) >= 3 AND {word_count_sql('line')} BETWEEN 2 AND 100
                        AND NOT {_RUNS}
                        AND length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / nullif(length(line), 0) >= 0.7,
                        false) AS valid FROM each""")

QUERIES["f8_first_per_dataset"] = (
    lambda spark, sf: ordering.first_per_group(probes(spark, sf), ["dataset"], ["probe_idx"], 12).select(
        "dataset", "probe_idx"),
    """SELECT dataset, probe_idx FROM (SELECT lang AS dataset, doc_id AS probe_idx,
       row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 12""")
QUERIES["t2_first_by_position"] = (
    lambda spark, sf: filters.first_by_position(probes(spark, sf), 100).select("probe_idx", F.length("text")
                                                                               .cast("bigint").alias("chars")),
    "SELECT doc_id AS probe_idx, CAST(length(text) AS BIGINT) AS chars FROM documents ORDER BY doc_id LIMIT 100")
_HASH = "md5('42|' || lang || '|' || doc_id)"
QUERIES["t3_seeded_shuffle"] = (
    lambda spark, sf: ordering.shuffle_positions(probes(spark, sf).drop("text"), 42, ["dataset", "probe_idx"]).select(
        "dataset", "probe_idx", "position"),
    f"""SELECT lang AS dataset, doc_id AS probe_idx, row_number() OVER (ORDER BY {_HASH}, lang, doc_id) - 1 AS position
        FROM documents""")
QUERIES["t4_seeded_sample"] = (
    lambda spark, sf: ordering.sample_per_group(probes(spark, sf).drop("text"), ["dataset"], ["probe_idx"], 15, 42)
    .select("dataset", "probe_idx"),
    f"""SELECT dataset, probe_idx FROM (SELECT lang AS dataset, doc_id AS probe_idx,
        row_number() OVER (PARTITION BY lang ORDER BY {_HASH}, doc_id) AS r FROM documents) WHERE r <= 15""")


def _two_sources(spark, sf):
    from quillprint.sources.datasets import read_dataset, union_datasets
    union, skipped = union_datasets({
        "benchmark": lambda: read_dataset(spark, f"{sf}/benchmark.parquet", "text", "item_id"),
        "documents": lambda: read_dataset(spark, f"{sf}/documents.parquet", "text", "doc_id"),
        "broken": lambda: read_dataset(spark, f"{sf}/documents.parquet", "no_such_column", "doc_id"),
    })
    assert list(skipped) == ["broken"]
    return union


QUERIES["u1_union_datasets"] = (
    lambda spark, sf: _two_sources(spark, sf).select("dataset", "probe_idx", F.length("text").cast("bigint")
                                                     .alias("chars")),
    """SELECT 'benchmark' AS dataset, item_id AS probe_idx, CAST(length(text) AS BIGINT) AS chars FROM benchmark
       UNION ALL SELECT 'documents', doc_id, CAST(length(text) AS BIGINT) FROM documents""")
QUERIES["u2_vocabulary"] = (
    lambda spark, sf: textstats.vocabulary(_docs(spark, sf)),
    f"SELECT DISTINCT unnest({words_sql('text')}) AS word FROM documents")
QUERIES["g8_mixed_probes"] = (
    lambda spark, sf: probe_ops.mixed_probes(_two_sources(spark, sf), 30, 42).select(
        "dataset", "source_idx", "position"),
    """WITH two AS (SELECT 'benchmark' AS dataset, item_id AS id FROM benchmark
                     UNION ALL SELECT 'documents', doc_id FROM documents),
       first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY id) AS r FROM two)
                 WHERE r <= 30)
       SELECT dataset, id AS source_idx,
              row_number() OVER (ORDER BY md5('42|' || dataset || '|' || id), dataset, id) - 1 AS position FROM first""")
