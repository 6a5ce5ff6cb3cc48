"""Registered queries that build probe sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.operators import grammar, ordering, probes as ops
from quillprint.plans.registry.inputs import case_sql, probes, quoted, table, vocabulary
from quillprint.session import scratch_path
from quillprint.sources import probe_cache

QUERIES = {}


def _requests(spark, sf):
    """One request per supplier, of different sizes and seeds."""
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("set-"), F.col("s_suppkey").cast("string")).alias("set_id"),
        (F.col("s_suppkey") % 40).alias("count"), F.col("s_suppkey").alias("seed"))


_REQUESTS_SQL = ("req AS (SELECT 'set-' || s_suppkey AS set_id, s_suppkey % 40 AS count, s_suppkey AS seed "
                 "FROM supplier)")


def _list_sql(values):
    return "[" + ", ".join(quoted(v) for v in values) + "]"


_TEMPLATES_SQL = case_sql([(f"domain = '{d}'", _list_sql(t)) for d, t in fixed.PROBE_TEMPLATES.items()], "NULL")
_NUMBERS_SQL = case_sql([(f"domain = '{d}'", str(ops.domain_number(d))) for d in fixed.PROBE_DOMAINS], "NULL")
QUERIES["g1_template_probes"] = (
    lambda spark, sf: ops.template_probes(_requests(spark, sf)).select("set_id", "domain", "i", "text"),
    f"""WITH {_REQUESTS_SQL},
        places AS (SELECT set_id, seed, i, unnest({_list_sql(fixed.PROBE_DOMAINS)}) AS domain
                   FROM req, range(0, 8) t(i) WHERE i < count // 5),
        chosen AS (SELECT set_id, domain, i, {_TEMPLATES_SQL}[CAST((i + {_NUMBERS_SQL} + seed) % 5 + 1 AS INT)] AS t,
                          {_list_sql(fixed.PROBE_ENTITIES)}[CAST((i + seed) % 20 + 1 AS INT)] AS e1,
                          {_list_sql(fixed.PROBE_ENTITIES)}[CAST((i + seed + 1) % 20 + 1 AS INT)] AS e2 FROM places)
        SELECT set_id, domain, i, CASE len(string_split(t, '{{}}')) WHEN 1 THEN t
               WHEN 2 THEN split_part(t, '{{}}', 1) || e1 || split_part(t, '{{}}', 2)
               ELSE split_part(t, '{{}}', 1) || e1 || split_part(t, '{{}}', 2) || e2 || split_part(t, '{{}}', 3) END
               AS text FROM chosen""")
QUERIES["j10_template_fill"] = (
    lambda spark, sf: ops.template_probes(_requests(spark, sf), ["reasoning", "nowhere", "creative"]).groupBy(
        "domain").agg(F.count(F.lit(1)).alias("probes"), F.sum(F.length("text")).alias("chars")),
    f"""WITH {_REQUESTS_SQL},
        places AS (SELECT seed, i, unnest(['reasoning', 'creative']) AS domain
                   FROM req, range(0, 13) t(i) WHERE i < count // 3),
        chosen AS (SELECT domain, {_TEMPLATES_SQL}[CAST((i + {_NUMBERS_SQL} + seed) % 5 + 1 AS INT)] AS t,
                          {_list_sql(fixed.PROBE_ENTITIES)}[CAST((i + seed) % 20 + 1 AS INT)] AS e1,
                          {_list_sql(fixed.PROBE_ENTITIES)}[CAST((i + seed + 1) % 20 + 1 AS INT)] AS e2 FROM places)
        SELECT domain, count(*) AS probes, CAST(sum(length(t) - 2 * (len(string_split(t, '{{}}')) - 1)
               + CASE WHEN len(string_split(t, '{{}}')) > 1 THEN length(e1) ELSE 0 END
               + CASE WHEN len(string_split(t, '{{}}')) > 2 THEN length(e2) ELSE 0 END) AS BIGINT) AS chars
        FROM chosen GROUP BY domain""")

_SETS = list(fixed.STANDARD_PROBES)


def _standard(spark, sf):
    """Every conversation gets one of the standard sets."""
    sets = F.array(*[F.lit(s) for s in _SETS])
    wanted = table(spark, sf, "conversations").select("conv_id").distinct().withColumn(
        "probe_set", F.element_at(sets, (F.col("conv_id") % len(_SETS) + 1).cast("int")))
    # seven sets of at most twenty texts
    return wanted.join(F.broadcast(ops.standard_probes(spark)), "probe_set").select(
        "conv_id", "probe_set", F.col("probe_idx").cast("bigint").alias("probe_idx"), "text")


QUERIES["g2_standard_sets"] = (_standard, f"""
    WITH wanted AS (SELECT DISTINCT conv_id, {_list_sql(_SETS)}[CAST(conv_id % {len(_SETS)} + 1 AS INT)] AS probe_set
                    FROM conversations),
    texts AS (SELECT conv_id, probe_set, {case_sql([(f"probe_set = '{s}'", _list_sql(t))
                                                    for s, t in fixed.STANDARD_PROBES.items()], "NULL")} AS t
              FROM wanted)
    SELECT conv_id, probe_set, CAST(i - 1 AS BIGINT) AS probe_idx, t[i] AS text
    FROM texts, range(1, 21) u(i) WHERE i <= len(t)""")


def _sources(spark, sf):
    """Every document is a text of one of two datasets, English ones of the first; a third has no rows."""
    name = F.when(F.col("dataset") == "en", "squad").otherwise("commonsense_qa")
    return probes(spark, sf).withColumn("dataset", name)


_SOURCES_SQL = """src AS (SELECT CASE lang WHEN 'en' THEN 'squad' ELSE 'commonsense_qa' END AS dataset,
                                 doc_id AS probe_idx, text FROM documents)"""
_FALLBACK = fixed.FALLBACK_PROBES["writing_prompts"]
QUERIES["g3_dataset_samples"] = (
    lambda spark, sf: ops.dataset_samples(_sources(spark, sf), ["squad", "commonsense_qa", "writing_prompts"], 13, 42)
    .select("dataset", "probe_idx", F.md5(F.col("text").cast("binary")).alias("text")),
    f"""WITH {_SOURCES_SQL},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset
                   ORDER BY md5('42|' || dataset || '|' || probe_idx), probe_idx) AS r FROM src)
        SELECT dataset, probe_idx, md5(trim(text, ' ' || chr(10) || chr(9))) AS text FROM ranked WHERE r <= 4
        UNION ALL SELECT 'writing_prompts', CAST(i - 1 AS BIGINT), md5({_list_sql(_FALLBACK)}[i])
        FROM range(1, 5) t(i)""")
QUERIES["g4_filler_probes"] = (
    lambda spark, sf: ops.filler_probes(_requests(spark, sf)),
    f"""WITH {_REQUESTS_SQL}
        SELECT set_id, i, {_list_sql(fixed.FILLER_PROBES)}[CAST((i + seed) % 10 + 1 AS INT)] AS text
        FROM req, range(0, 40) t(i) WHERE i < count""")
QUERIES["g5_diverse_set"] = (
    lambda spark, sf: ops.diverse_probes(_sources(spark, sf), 60).groupBy("set_id", "origin").agg(
        F.count(F.lit(1)).alias("probes")),
    """SELECT 'diverse_60_general-reasoning-creative-factual-conversational' AS set_id, origin, n AS probes
       FROM (VALUES ('template', 30), ('dataset', 25), ('filler', 5)) v(origin, n)
       WHERE (SELECT count(*) FROM documents WHERE lang = 'en') >= 10
         AND (SELECT count(*) FROM documents WHERE lang IS DISTINCT FROM 'en') >= 10""")


def _samples(spark, sf, make, classes, measure):
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"))
    made = make(ids, vocabulary(spark, sf, sorted(set(classes.values()))))
    return made.select("sample_id", (measure(F.col("text")) >= 100).alias("long_enough"),
                       (F.substring("text", 1, 1) == F.upper(F.substring("text", 1, 1))).alias("starts_upper"),
                       F.col("text").rlike("[.。]$").alias("ends_closed"), F.contains("text", F.lit("{"))
                       .alias("has_slots"))


_SAMPLES_SQL = """SELECT s_suppkey AS sample_id, true AS long_enough, true AS starts_upper, true AS ends_closed,
                         false AS has_slots FROM supplier"""


def _english(spark, sf):
    from quillprint.functions.text import word_count
    return _samples(spark, sf, grammar.english_samples, fixed.ENGLISH_WORD_CLASSES, word_count)


def _chinese(spark, sf):
    from quillprint.functions.text import meaningful_length
    # Latin words stand for the characters here, so only length and form can be checked
    return _samples(spark, sf, grammar.chinese_samples, fixed.CHINESE_WORD_CLASSES, meaningful_length).withColumn(
        "starts_upper", F.lit(True))


QUERIES["g6_english_samples"] = (_english, _SAMPLES_SQL)
QUERIES["g7_chinese_samples"] = (_chinese, _SAMPLES_SQL)


def _dispatch(spark, sf):
    """The same sources through a single dataset, a miss that is saved and then found, a list of two."""
    sources = _sources(spark, sf)
    path = scratch_path(spark, "probes")
    cache = {"cached": lambda: probe_cache.cached_probes(spark, path, "cqa", 20, 42),
             "save": lambda made: probe_cache.save_probes(made, path, "cqa", 20, 42)}
    single = ops.probe_texts(sources, "cqa", "general", 20, 42, **cache)
    cached = ops.probe_texts(sources.limit(0), "cqa", "general", 20, 42, **cache)
    several = ops.probe_texts(sources, "squad, cqa", "general", 15, 42)
    parts = [df.select(F.lit(n).alias("path"), "dataset", "probe_idx", F.md5(F.col("text").cast("binary"))
                       .alias("text"))
             for n, df in (("single", single), ("cached", cached), ("several", several))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES["g9_probe_dispatch"] = (_dispatch, f"""
    WITH {_SOURCES_SQL},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY probe_idx) AS r FROM src),
    one AS (SELECT 'cqa' AS dataset, probe_idx, md5(text) AS text FROM ranked
            WHERE dataset = 'commonsense_qa' AND r <= 20)
    SELECT 'single' AS path, * FROM one UNION ALL SELECT 'cached', * FROM one
    UNION ALL SELECT 'several', 'squad, cqa', row_number() OVER (ORDER BY md5('42|' || dataset || '|' || probe_idx),
        dataset, probe_idx) - 1, md5(text) FROM ranked WHERE r <= 15""")


def _cache_round_trip(spark, sf):
    """The first 50 texts of every language, saved under a key each; a second set for the first key changes nothing."""
    path = scratch_path(spark, "probes")
    texts = probes(spark, sf)
    first = ordering.first_per_group(texts, ["dataset"], ["probe_idx"], 50)
    languages = [r.dataset for r in texts.where("dataset IS NOT NULL").select("dataset").distinct().orderBy("dataset").collect()]
    for name in languages:
        probe_cache.save_probes(first.where(F.col("dataset") == name), path, name, 50, 42)
    probe_cache.save_probes(texts, path, languages[0], 50, 42)
    return probe_cache.read_probe_cache(spark, path).select(
        "dataset_id", "max_samples", "random_seed", "probe_idx", F.md5(F.col("text").cast("binary")).alias("text"))


QUERIES["s6_probe_cache"] = (_cache_round_trip, """
    SELECT lang AS dataset_id, 50 AS max_samples, 42 AS random_seed, doc_id AS probe_idx, md5(text) AS text
    FROM documents WHERE lang IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50""")


def _set_round_trip(spark, sf):
    path = scratch_path(spark, "sets")
    sets = table(spark, sf, "documents").select(
        F.concat(F.lit("set-"), (F.col("doc_id") % 50).cast("string")).alias("set_id"),
        F.floor(F.col("doc_id") / 50).alias("probe_idx"), "text")
    # eight texts to a document, so that sets are cut
    probe_cache.write_probe_sets(probe_cache.probe_set_documents(sets, "documents", "mixed", 8), path)
    return probe_cache.read_probe_sets(spark, path).select(
        "set_id", F.col("probe_idx").cast("bigint").alias("probe_idx"), F.md5(F.col("text").cast("binary"))
        .alias("text"))


QUERIES["s15_probe_sets"] = (_set_round_trip, """
    SELECT 'set-' || (doc_id % 50) AS set_id, doc_id // 50 AS probe_idx, md5(text) AS text FROM documents""")
