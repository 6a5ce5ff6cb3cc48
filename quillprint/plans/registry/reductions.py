"""Registered queries on embeddings: moments, projections, merges and whole runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillprint.config import RunConfig
from quillprint.functions.encoders import encode_texts, register_encoder
from quillprint.operators import pooling, reduce
from quillprint.plans import fingerprint, run
from quillprint.plans.registry.inputs import (EMBEDDINGS_SQL, TURNS_SQL, W, concat_sql, embeddings,
                                              long_signature, matrix_sql, r6, reduced_sql, strip_sql, table, turns,
                                              word_count_sql, words_sql)
from quillprint.session import scratch_path

QUERIES = {}
WIDTH = 64


def _filled(df, *keys):
    """Long signatures without the zero padding."""
    return long_signature(df, *keys, "probe_count", "components").where(
        F.col("pos") < F.col("probe_count") * F.col("components")).select(*keys, "pos", "value")


QUERIES["a12_moments"] = (
    lambda spark, sf: reduce.moments(embeddings(spark, sf), ["model_name"]).select(
        "model_name", "probe_count", F.posexplode(F.arrays_zip("mean", "scale")).alias("pos", "v")).select(
        "model_name", "probe_count", F.col("pos").cast("bigint").alias("pos"), r6("v.mean").alias("mean"),
        r6("v.scale").alias("std")),
    f"""WITH {EMBEDDINGS_SQL}
        SELECT model_name, count(*) AS probe_count, CAST(i - 1 AS BIGINT) AS pos, round(avg(e[i]), 6) + 0.0 AS mean,
               round(stddev_pop(e[i]), 6) + 0.0 AS std
        FROM emb, range(1, {WIDTH} + 1) t(i) GROUP BY model_name, i""")

QUERIES["r3_standardize"] = (
    lambda spark, sf: reduce.standardize(embeddings(spark, sf), ["model_name"]).select(
        "model_name", "probe_idx", F.posexplode("standardized").alias("pos", "value")).select(
        "model_name", "probe_idx", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value")),
    f"""WITH {EMBEDDINGS_SQL},
        long AS (SELECT model_name, probe_idx, i, e[i] AS x FROM emb, range(1, {WIDTH} + 1) t(i)),
        mom AS (SELECT model_name, i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY model_name, i)
        SELECT model_name, probe_idx, CAST(i - 1 AS BIGINT) AS pos, round((x - m) / s, 6) + 0.0 AS value
        FROM long JOIN mom USING (model_name, i)""")

QUERIES["r4_random_projection"] = (
    lambda spark, sf: reduce.projected_rows(embeddings(spark, sf), 16).select(
        "model_name", "probe_idx", F.posexplode("projected").alias("pos", "value")).select(
        "model_name", "probe_idx", F.col("pos").cast("bigint").alias("pos"), r6("value").alias("value")),
    f"""WITH {EMBEDDINGS_SQL}, {reduced_sql('emb', 'model_name', 16, WIDTH)}
        SELECT model_name, probe_idx, CAST(c AS BIGINT) AS pos, round(y, 6) + 0.0 AS value FROM proj""")


def _signature_query(dim, merge="concat"):
    return lambda spark, sf: _filled(reduce.signatures(embeddings(spark, sf), dim, merge=merge), "model_name")


def concat_query_sql(dim):
    return f"""WITH {EMBEDDINGS_SQL}, {reduced_sql('emb', 'model_name', dim, WIDTH)}
               {concat_sql('model_name', dim)}"""


QUERIES["r8_signature_concat_16"] = (_signature_query(16), concat_query_sql(16))
QUERIES["a14_concat_128"] = (_signature_query(128), concat_query_sql(128))
QUERIES["a13_max_16"] = (
    _signature_query(16, "max"),
    f"""WITH {EMBEDDINGS_SQL}, {reduced_sql('emb', 'model_name', 16, WIDTH)}
        SELECT model_name, CAST(c AS BIGINT) AS pos, round(max(y), 6) + 0.0 AS value
        FROM proj GROUP BY model_name, c""")


def _degenerate(spark, sf):
    parts = [reduce.signatures(embeddings(spark, sf), 16, merge=m).select(
        "model_name", F.lit(m).alias("merge"), "probe_count", "status", F.col("signature").isNull().alias("rejected"))
        for m in ("sum", "mean")]
    return parts[0].unionByName(parts[1])


QUERIES["a13_degenerate_merges"] = (_degenerate, f"""
    WITH {EMBEDDINGS_SQL}, {reduced_sql('emb', 'model_name', 16, WIDTH)},
    merged AS (SELECT model_name, c, any_value(n) AS n, sum(y) AS total, avg(y) AS mean FROM proj
               GROUP BY model_name, c)
    SELECT model_name, merge, max(n) AS probe_count,
           CASE WHEN max(abs(CASE merge WHEN 'sum' THEN total ELSE mean END)) < 1e-8 THEN 'degenerate_merge'
                ELSE 'ok' END AS status, true AS rejected
    FROM merged, (SELECT unnest(['sum', 'mean']) AS merge) GROUP BY model_name, merge""")


def _with_singles(spark, sf):
    e = embeddings(spark, sf)
    return e.withColumn("model_name", F.when(F.col("probe_idx") % 50 == 0, F.concat(
        F.lit("single-"), F.col("probe_idx").cast("string"))).otherwise(F.col("model_name"))).withColumn(
        "embedding", F.when(F.col("model_name") == "model-9", F.array().cast("array<float>"))
        .otherwise(F.col("embedding")))


QUERIES["r2_input_checks"] = (
    lambda spark, sf: reduce.shapes(_with_singles(spark, sf), ["model_name"], 16).select(
        "model_name", "probe_count", F.col("width").cast("bigint").alias("width"), "components", "status"),
    f"""WITH {EMBEDDINGS_SQL},
        named AS (SELECT CASE WHEN probe_idx % 50 = 0 THEN 'single-' || probe_idx ELSE model_name END AS model_name, e
                  FROM emb),
        sized AS (SELECT model_name, count(*) AS n,
                         max(CASE WHEN model_name = 'model-9' THEN 0 ELSE len(e) END) AS w FROM named
                  GROUP BY model_name)
        SELECT model_name, n AS probe_count, CAST(w AS BIGINT) AS width,
               CASE WHEN w = 0 OR n < 2 THEN 0 ELSE least(n - 1, w, 16) END AS components,
               CASE WHEN w = 0 THEN 'zero_width' WHEN n < 2 THEN 'too_few_probes' ELSE 'ok' END AS status
        FROM sized""")


def _malformed(spark, sf):
    """A null vector in one model and a short one in another; the rest are to come through."""
    e = embeddings(spark, sf)
    first = F.min("probe_idx").over(Window.partitionBy("model_name")) == F.col("probe_idx")
    bad = F.when(first & (F.col("model_name") == "model-1"), F.lit(None)).when(
        first & (F.col("model_name") == "model-2"), F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    outcome = fingerprint.from_embeddings(e.withColumn("embedding", bad), RunConfig(dim=16))
    return outcome.signatures.select("model_name", F.lit("ok").alias("outcome")).unionByName(
        outcome.rejects.select("model_name", F.col("error").alias("outcome")))


QUERIES["r2_malformed_vectors"] = (_malformed, f"""
    WITH {EMBEDDINGS_SQL} SELECT DISTINCT model_name, CASE model_name WHEN 'model-1' THEN 'null_vector'
    WHEN 'model-2' THEN 'ragged_width' ELSE 'ok' END AS outcome FROM emb""")


def _row_norms(reduction):
    def run(spark, sf):
        rows = reduce.projected_rows(embeddings(spark, sf), WIDTH, reduction)
        return rows.select("model_name", "probe_idx", r6(F.aggregate(
            "projected", F.lit(0.0), lambda a, x: a + x * x)).alias("squared_norm"))
    return run


# at full rank a principal projection keeps the length of every standardized row
_ROW_NORMS_SQL = f"""
    WITH {EMBEDDINGS_SQL},
    long AS (SELECT model_name, probe_idx, i, e[i] AS x FROM emb, range(1, {WIDTH} + 1) t(i)),
    mom AS (SELECT model_name, i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY model_name, i)
    SELECT model_name, probe_idx, round(sum(((x - m) / s) * ((x - m) / s)), 6) + 0.0 AS squared_norm
    FROM long JOIN mom USING (model_name, i) GROUP BY model_name, probe_idx"""
for _id, _reduction in (("r5_pca", "pca"), ("r6_svd", "svd"), ("r7_umap_fallback", "umap")):
    QUERIES[f"{_id}_row_norms"] = (_row_norms(_reduction), _ROW_NORMS_SQL)


def _principal_signature(spark, sf):
    out = reduce.signatures(embeddings(spark, sf), WIDTH, "pca", "concat")
    first = F.slice("signature", F.lit(1), F.col("components").cast("int"))
    return out.select("model_name", "components", r6(F.aggregate(first, F.lit(0.0), lambda a, x: a + x * x))
                      .alias("first_probe_norm"))


QUERIES["r8_signature_pca_concat"] = (_principal_signature, f"""
    WITH norms AS ({_ROW_NORMS_SQL}),
    first AS (SELECT model_name, count(*) AS n, arg_min(squared_norm, probe_idx) AS first_probe_norm FROM norms
              GROUP BY model_name)
    SELECT model_name, least(n - 1, {WIDTH}) AS components, first_probe_norm FROM first""")

# three columns below full rank: the components of a 3 x 3 correlation matrix have a closed form
_TRIPLE_SQL = f"""
    {EMBEDDINGS_SQL},
    triple AS (SELECT model_name, probe_idx, e[1] AS x1, e[2] AS x2, e[3] AS x3 FROM emb),
    facts AS (SELECT model_name, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, stddev_pop(x1) AS s1,
                     stddev_pop(x2) AS s2, stddev_pop(x3) AS s3, corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c
              FROM triple GROUP BY model_name),
    spread AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM facts),
    angle AS (SELECT *, acos(greatest(-1, least(1, a * b * c / (p * p * p)))) / 3 AS phi FROM spread),
    largest AS (SELECT *, 1 + 2 * p * cos(phi) AS l1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM angle),
    roots AS (SELECT * EXCLUDE (l1, l3), r.comp, r.l FROM largest, unnest([
                  {{'comp': 0, 'l': l1}}, {{'comp': 1, 'l': 3 - l1 - l3}}]) AS t(r)),
    raw AS (SELECT *, a * c - b * (1 - l) AS u1, b * a - c * (1 - l) AS u2, (1 - l) * (1 - l) - a * a AS u3 FROM roots),
    signed AS (SELECT *, sqrt(u1 * u1 + u2 * u2 + u3 * u3) * sign(CASE
                   WHEN abs(u1) >= abs(u2) AND abs(u1) >= abs(u3) THEN u1 WHEN abs(u2) >= abs(u3) THEN u2 ELSE u3 END) AS len
               FROM raw),
    turned AS (SELECT model_name, probe_idx, comp, n, (u1 * (x1 - m1) / s1 + u2 * (x2 - m2) / s2 + u3 * (x3 - m3) / s3) / len
                      AS y FROM triple JOIN signed USING (model_name))"""


def _triples(spark, sf):
    return embeddings(spark, sf).withColumn("embedding", F.slice("embedding", 1, 3))


def _turned(reduction):
    def run(spark, sf):
        return reduce.projected_rows(_triples(spark, sf), 2, reduction).select(
            "model_name", "probe_idx", F.posexplode("projected").alias("comp", "y")).select(
            "model_name", "probe_idx", F.col("comp").cast("bigint").alias("comp"), r6("y").alias("y"))
    return run


for _id, _reduction in (("r5_pca", "pca"), ("r6_svd", "svd"), ("r7_umap_fallback", "umap")):
    QUERIES[f"{_id}_components"] = (_turned(_reduction), f"""
        WITH {_TRIPLE_SQL}
        SELECT model_name, probe_idx, CAST(comp AS BIGINT) AS comp, round(y, 6) + 0.0 AS y FROM turned WHERE comp < n - 1""")

QUERIES["r8_signature_svd_max"] = (
    lambda spark, sf: long_signature(reduce.signatures(_triples(spark, sf), 2, "svd", "max"), "model_name"), f"""
    WITH {_TRIPLE_SQL}
    SELECT model_name, CAST(comp AS BIGINT) AS pos, round(max(y), 6) + 0.0 AS value FROM turned GROUP BY model_name, comp""")

QUERIES["r9_probe_sets"] = (
    lambda spark, sf: _filled(reduce.signatures(embeddings(spark, sf).withColumn(
        "probe_set_id", F.concat(F.lit("set-"), (F.col("probe_idx") % 2).cast("string"))), 16,
        keys=["model_name", "probe_set_id"]), "model_name", "probe_set_id"),
    f"""WITH {EMBEDDINGS_SQL},
        sets AS (SELECT model_name, 'set-' || (probe_idx % 2) AS probe_set_id, probe_idx, e FROM emb),
        {reduced_sql('sets', 'model_name, probe_set_id', 16, WIDTH)}
        {concat_sql('model_name, probe_set_id', 16)}""")

# --- whole runs ---

CHAT = RunConfig(dataset="chat", dim=16, encoder_width=32)
ENCODED_SQL = f"""
    {TURNS_SQL},
    said AS (SELECT 'bot-' || (conv_id % 7) AS model_name, conv_id * 1000 + probe_idx AS probe_idx,
                    coalesce(response, '') AS response FROM turns),
    word_rows AS (SELECT model_name, probe_idx, unnest({words_sql('response')}) AS w FROM said),
    hits AS (SELECT model_name, probe_idx, CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % 32 AS b, count(*) AS c
             FROM word_rows GROUP BY ALL),
    cells AS (SELECT s.model_name, s.probe_idx, j, coalesce(c, 0)::DOUBLE AS c FROM said s CROSS JOIN range(0, 32) t(j)
              LEFT JOIN hits h ON h.model_name = s.model_name AND h.probe_idx = s.probe_idx AND h.b = j),
    emb AS (SELECT model_name, probe_idx, list(c ORDER BY j) AS e FROM cells GROUP BY model_name, probe_idx)
"""


def _said(spark, sf):
    return turns(spark, sf).select(
        F.concat(F.lit("bot-"), (F.col("conv_id") % 7).cast("string")).alias("model_name"),
        (F.col("conv_id") * 1000 + F.col("probe_idx")).alias("probe_idx"), F.coalesce("response", F.lit(""))
        .alias("response"))


QUERIES["r1_encode_responses"] = (
    lambda spark, sf: encode_texts(_said(spark, sf), "response", width=32, once_per_text=True).select(
        "model_name", "probe_idx", F.posexplode("embedding").alias("pos", "value")).where("value > 0").select(
        "model_name", "probe_idx", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double")
        .alias("value")),
    f"""WITH {ENCODED_SQL} SELECT model_name, probe_idx, CAST(b AS BIGINT) AS pos, c::DOUBLE AS value FROM hits""")
QUERIES["e2_many_models"] = (
    lambda spark, sf: _filled(fingerprint.from_responses(_said(spark, sf), CHAT).signatures, "model_name"),
    f"""WITH {ENCODED_SQL}, {reduced_sql('emb', 'model_name', 16, 32)} {concat_sql('model_name', 16)}""")
QUERIES["e1_one_model"] = (
    lambda spark, sf: _filled(fingerprint.for_model(_said(spark, sf), "bot-3", CHAT).signatures, "model_name"),
    f"""WITH {ENCODED_SQL}, {reduced_sql('emb', 'model_name', 16, 32)} {concat_sql('model_name', 16)}
        AND model_name = 'bot-3'""")

LISTED = RunConfig(dataset="chat", dim=16, encoder_width=32, max_samples=3, continue_on_error=True)


def _full_run(spark, sf):
    """Two runs below one root, the second with the whole list: cached, generated, failing, silent, short and repeated."""
    t = turns(spark, sf).withColumn("model_name", F.concat(F.lit("lab/"), F.col("model_name")))
    probes = t.groupBy("dataset", "probe_idx").agg(F.min("prompt").alias("text"))
    ids = t.select("conv_id", "model_name").distinct()
    listed = ids.select(F.col("conv_id").alias("ord"), "model_name").unionByName(
        ids.where("conv_id % 11 = 0").select((-1 - F.col("conv_id")).alias("ord"), "model_name"))
    caches = t.where("conv_id % 3 = 0").select(
        "model_name", "dataset", (F.col("conv_id") % 9 != 0).alias("complete"), "probe_idx",
        F.coalesce("response", F.lit("")).alias("response"))
    generated = t.where("conv_id % 3 = 1 AND response IS NOT NULL").select("model_name", "probe_idx", "response")
    failures = ids.where("conv_id % 10 = 7").select("model_name", F.lit("generation failed").alias("error"))
    root = scratch_path(spark, "runs")
    run.full_run(spark, listed.where("ord % 2 = 0"), probes, LISTED, root, generated, caches, failures)
    last = run.full_run(spark, listed, probes, LISTED, root, generated, caches, failures)
    good = last.results.select("ord", "model_name", "source", F.posexplode("signature").alias("pos", "value")).select(
        "ord", "model_name", F.col("source").alias("outcome"), F.col("pos").cast("bigint").alias("pos"),
        r6("value").alias("value"))
    asked = last.requests.groupBy("model_name").agg(F.count(F.lit(1)).alias("asked"))
    bad = listed.join(last.rejects, "model_name").join(asked, "model_name", "left").select(
        "ord", "model_name", F.col("error").alias("outcome"), F.coalesce("asked", F.lit(0)).alias("pos"),
        F.lit(0.0).alias("value"))
    return good.unionByName(bad)


QUERIES["e2_full_run"] = (_full_run, f"""
    WITH {TURNS_SQL},
    ids AS (SELECT DISTINCT conv_id FROM turns),
    listed AS (SELECT conv_id AS ord, conv_id FROM ids
               UNION ALL SELECT -1 - conv_id, conv_id FROM ids WHERE conv_id % 11 = 0),
    places AS (SELECT probe_idx, row_number() OVER (ORDER BY probe_idx) - 1 AS place
               FROM (SELECT DISTINCT probe_idx FROM turns) QUALIFY place < 3),
    cached AS (SELECT conv_id FROM turns WHERE conv_id % 3 = 0 AND conv_id % 9 <> 0 GROUP BY conv_id
               HAVING bool_or({strip_sql("coalesce(response, '')")} <> '')),
    answers AS (SELECT conv_id, probe_idx, coalesce(response, '') AS response, 'cache' AS source
                FROM turns JOIN cached USING (conv_id)
                UNION ALL SELECT conv_id, probe_idx, response, 'generated' FROM turns
                WHERE conv_id % 3 = 1 AND response IS NOT NULL),
    known AS (SELECT conv_id, any_value(source) AS source FROM answers WHERE conv_id % 10 <> 7 GROUP BY conv_id),
    said AS (SELECT conv_id, place, coalesce(response, '') AS response
             FROM known CROSS JOIN places LEFT JOIN answers USING (conv_id, probe_idx)),
    word_rows AS (SELECT conv_id, place, unnest({words_sql('response')}) AS w FROM said),
    hits AS (SELECT conv_id, place, CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % 32 AS b, count(*) AS c
             FROM word_rows GROUP BY ALL),
    cells AS (SELECT s.conv_id, s.place, j, coalesce(c, 0)::DOUBLE AS c FROM said s CROSS JOIN range(0, 32) t(j)
              LEFT JOIN hits h ON h.conv_id = s.conv_id AND h.place = s.place AND h.b = j),
    emb AS (SELECT conv_id, place AS probe_idx, list(c ORDER BY j) AS e FROM cells GROUP BY conv_id, place),
    {reduced_sql('emb', 'conv_id', 16, 32)},
    filled AS ({concat_sql('conv_id', 16)}),
    padded AS (SELECT k.conv_id, k.source, CAST(i AS BIGINT) AS pos, coalesce(value, 0.0) AS value
               FROM known k CROSS JOIN range(0, 16) t(i) LEFT JOIN filled f ON f.conv_id = k.conv_id AND f.pos = i),
    blank AS (SELECT conv_id FROM padded GROUP BY conv_id HAVING bool_and(value = 0))
    SELECT ord, 'lab/conv-' || conv_id AS model_name, source AS outcome, pos, value
    FROM listed JOIN padded USING (conv_id) WHERE conv_id NOT IN (SELECT conv_id FROM blank)
    UNION ALL SELECT ord, 'lab/conv-' || conv_id, CASE WHEN conv_id % 10 = 7 THEN 'generation failed'
        WHEN conv_id IN (SELECT conv_id FROM blank) THEN 'all-zero signature' ELSE 'no responses' END,
        CASE WHEN conv_id % 10 = 7 OR conv_id IN (SELECT conv_id FROM blank) THEN 0
             ELSE (SELECT count(*) FROM places) END, 0.0
    FROM listed WHERE conv_id IN (SELECT conv_id FROM blank) OR conv_id NOT IN (SELECT conv_id FROM known)""")

SETTINGS = {"narrow": RunConfig(dim=8), "wide": RunConfig(dim=32, seed=7), "peak": RunConfig(dim=8, merge="max")}


def _settings(spark, sf):
    e = embeddings(spark, sf)
    chosen = e.select("model_name").distinct().withColumn("setting", F.explode(F.when(
        F.substring("model_name", -1, 1).cast("int") % 2 == 0, F.array(F.lit("narrow"), F.lit("peak")))
        .otherwise(F.array(F.lit("wide")))))
    return _filled(fingerprint.with_settings(e, chosen, SETTINGS), "setting", "model_name")


QUERIES["e3_settings_per_model"] = (_settings, f"""
    WITH {EMBEDDINGS_SQL},
    even AS (SELECT * FROM emb WHERE CAST(right(model_name, 1) AS INT) % 2 = 0),
    odd AS (SELECT * FROM emb WHERE CAST(right(model_name, 1) AS INT) % 2 = 1),
    {reduced_sql('even', 'model_name', 8, WIDTH, name='n_')},
    {reduced_sql('odd', 'model_name', 32, WIDTH, 7, name='w_')}
    SELECT 'narrow' AS setting, * FROM ({concat_sql('model_name', 8, 'n_')})
    UNION ALL SELECT 'wide', * FROM ({concat_sql('model_name', 32, 'w_')})
    UNION ALL SELECT 'peak', model_name, CAST(c AS BIGINT), round(max(y), 6) + 0.0 FROM n_proj GROUP BY model_name, c
    """)


#: Fifty settings: widths from 3 to 14, two seeds, both merges.
MANY_SETTINGS = "3 + i % 12 AS dim, CASE WHEN i % 5 = 0 THEN 'max' ELSE 'concat' END AS merge, 42 - 35 * (i % 2) AS seed"


def _many_settings(spark, sf):
    e = embeddings(spark, sf)
    settings = spark.range(50).withColumnRenamed("id", "i").selectExpr(
        "concat('setting-', i) AS setting", "'random_projection' AS reduction", *MANY_SETTINGS.split(", "))
    names = e.select("model_name").distinct().crossJoin(settings.select("setting"))
    return _filled(fingerprint.with_settings(e, names, settings), "setting", "model_name")


QUERIES["e3_many_settings"] = (_many_settings, f"""
    WITH {EMBEDDINGS_SQL},
    settings AS (SELECT 'setting-' || i AS setting, {MANY_SETTINGS} FROM range(0, 50) t(i)),
    long AS (SELECT model_name, probe_idx, j, e[j] AS x FROM emb, range(1, {WIDTH} + 1) t(j)),
    mom AS (SELECT model_name, j, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY model_name, j),
    std AS (SELECT model_name, probe_idx, j, n, (x - m) / s AS z FROM long JOIN mom USING (model_name, j)),
    mat AS (SELECT 42 AS seed, {matrix_sql(14, WIDTH, 42)} AS g UNION ALL SELECT 7, {matrix_sql(14, WIDTH, 7)}),
    raw AS (SELECT model_name, probe_idx, seed, c - 1 AS c, any_value(n) AS n, sum(z * g[c][j]) AS y
            FROM std, mat, range(1, 15) u(c) GROUP BY model_name, probe_idx, seed, c),
    ranked AS (SELECT model_name, probe_idx, row_number() OVER (PARTITION BY model_name ORDER BY probe_idx) - 1 AS rank
               FROM emb),
    cut AS (SELECT setting, merge, dim, model_name, rank, c, least(n - 1, {WIDTH}, dim) AS k, y / sqrt(least(n - 1, {WIDTH}, dim))
                   AS y FROM raw JOIN settings USING (seed) JOIN ranked USING (model_name, probe_idx))
    SELECT setting, model_name, CAST(rank * k + c AS BIGINT) AS pos, round(y, 6) + 0.0 AS value
    FROM cut WHERE merge = 'concat' AND c < k AND rank * k + c < dim
    UNION ALL SELECT setting, model_name, CAST(c AS BIGINT), round(max(y), 6) + 0.0
    FROM cut WHERE merge = 'max' AND c < k GROUP BY setting, model_name, c""")


def _policy(spark, sf):
    failures = _said(spark, sf).select("model_name").distinct().where("model_name = 'bot-6'").withColumn(
        "error", F.lit("generation failed"))
    usable = _said(spark, sf).where("model_name <> 'bot-6'")
    single = usable.where("model_name = 'bot-5'").groupBy("model_name").agg(
        F.min("probe_idx").alias("probe_idx"), F.min_by("response", "probe_idx").alias("response"))
    rows = usable.where("model_name <> 'bot-5'").unionByName(single)
    outcome = fingerprint.from_responses(rows, CHAT, failures)
    good = fingerprint.apply_failure_policy(outcome, continue_on_error=True)
    return good.select("model_name", F.lit("ok").alias("outcome")).unionByName(
        outcome.rejects.select("model_name", F.col("error").alias("outcome")))


QUERIES["e4_failure_policy"] = (_policy, f"""
    WITH {TURNS_SQL} SELECT DISTINCT 'bot-' || (conv_id % 7) AS model_name,
    CASE conv_id % 7 WHEN 6 THEN 'generation failed' WHEN 5 THEN 'too_few_probes' ELSE 'ok' END AS outcome
    FROM turns""")


def _states(spark, sf):
    """Token states: vec_id // 40 numbers the probe of a model, vec_id % 40 // 4 the token."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("m-"), (F.col("vec_id") % 4).cast("string")).alias("model_name"),
        F.floor(F.col("vec_id") / 40).alias("probe_idx"), F.floor(F.col("vec_id") % 40 / 4).alias("tok_idx"),
        F.when(F.floor(F.col("vec_id") % 40 / 4) < F.floor(F.col("vec_id") / 40) % 10, 1).otherwise(0).alias("mask"),
        F.col("embedding").alias("state"))


_STATES_SQL = """
    states AS (SELECT 'm-' || (vec_id % 4) AS model_name, vec_id // 40 AS probe_idx, vec_id % 40 // 4 AS tok_idx,
                      CASE WHEN vec_id % 40 // 4 < vec_id // 40 % 10 THEN 1 ELSE 0 END AS mask,
                      CAST(embedding AS DOUBLE[]) AS state FROM embeddings),
    place AS (SELECT model_name, probe_idx, CASE WHEN sum(mask) > 0 THEN sum(mask) - 1 ELSE max(tok_idx) END AS tok_idx
              FROM states GROUP BY model_name, probe_idx),
    emb AS (SELECT model_name, probe_idx, state AS e FROM states JOIN place USING (model_name, probe_idx, tok_idx))
"""


def _long_embedding(df):
    return df.select("model_name", "probe_idx", F.posexplode("embedding").alias("pos", "value")).select(
        "model_name", "probe_idx", F.col("pos").cast("bigint").alias("pos"),
        r6(F.col("value").cast("double")).alias("value"))


QUERIES["a15_last_token"] = (
    lambda spark, sf: _long_embedding(pooling.last_token(_states(spark, sf))),
    f"""WITH {_STATES_SQL} SELECT model_name, probe_idx, CAST(i - 1 AS BIGINT) AS pos, round(e[i], 6) + 0.0 AS value
        FROM emb, range(1, {WIDTH} + 1) t(i)""")
QUERIES["a16_masked_mean"] = (
    lambda spark, sf: _long_embedding(pooling.masked_mean(_states(spark, sf))),
    f"""WITH {_STATES_SQL} SELECT model_name, probe_idx, CAST(i - 1 AS BIGINT) AS pos,
        round(sum(state[i] * mask) / greatest(sum(mask), 1e-9), 6) + 0.0 AS value
        FROM states, range(1, {WIDTH} + 1) t(i) GROUP BY model_name, probe_idx, i""")
QUERIES["e5_hidden_states"] = (
    lambda spark, sf: _filled(fingerprint.from_token_states(
        _states(spark, sf), "last_token", 16, "random_projection", "concat").signatures, "model_name"),
    f"""WITH {_STATES_SQL}, {reduced_sql('emb', 'model_name', 16, WIDTH)} {concat_sql('model_name', 16)}""")


def _lookup(spark, sf):
    """Documents as token ids: their words' hashes in a space a little larger than the table of vectors."""
    words = table(spark, sf, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")
    size = words.agg(F.max("token_id")).first()[0] + 1
    space = size + size // 8
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), F.transform(
        F.regexp_extract_all(F.lower("text"), F.lit(f"[^{W}]+"), F.lit(0)),
        lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("bigint") % space).alias("token_ids"))
    found = pooling.token_embeddings(docs, words, size)
    return found.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.max("pos").cast("bigint").alias("last_pos"),
        (F.round(F.sum(F.col("embedding")[0].cast("double") * (F.col("pos") % 100 + 1)), 3) + F.lit(0.0)).alias("weighted"))


QUERIES["j5_token_embeddings"] = (_lookup, f"""
    WITH size AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
    ids AS (SELECT doc_id AS text_id, list_filter(list_transform({words_sql('text')}, lambda w:
                CAST(('0x' || substr(md5(w), 1, 7)) AS BIGINT) % (n + n // 8)), lambda t: t < n) AS t FROM documents, size),
    toks AS (SELECT text_id, i - 1 AS pos, t[i] AS token_id FROM ids, unnest(range(1, len(t) + 1)) u(i))
    SELECT text_id, count(*) AS tokens, CAST(max(pos) AS BIGINT) AS last_pos,
           round(sum(CAST(embedding[1] AS DOUBLE) * (pos % 100 + 1)), 3) + 0.0 AS weighted
    FROM toks JOIN embeddings ON vec_id = token_id GROUP BY text_id""")

# --- choices by name ---


def _text_profile(width):
    """An encoder of plain figures: characters, words, lines."""
    import numpy as np
    return lambda texts: np.array([[len(t), len(t.split()), t.count("\n")][:width] for t in texts], dtype=float)


def _own_encoder(spark, sf):
    register_encoder("text_profile", _text_profile)
    encoded = encode_texts(table(spark, sf, "documents"), "text", "text_profile", 3)
    return encoded.select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(n)
                                      for i, n in enumerate(("chars", "words", "line_breaks"))])


QUERIES["x2_encoder_by_name"] = (_own_encoder, f"""
    SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST({word_count_sql('text')} AS BIGINT) AS words,
           CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS line_breaks FROM documents""")


def _own_extractor(spark, sf):
    def widest(df, config):
        return fingerprint.from_embeddings(df, config, ["model_name"])

    fingerprint.register_extractor("widest", widest)
    made = [fingerprint.extract(kind, embeddings(spark, sf), RunConfig(dim=16)).signatures.select(
        F.lit(kind).alias("kind"), "*") for kind in ("embeddings", "widest")]
    return _filled(made[0].unionByName(made[1]), "kind", "model_name")


QUERIES["x1_extractor_by_name"] = (_own_extractor, f"""
    WITH {EMBEDDINGS_SQL}, {reduced_sql('emb', 'model_name', 16, WIDTH)}
    SELECT kind, s.* FROM ({concat_sql('model_name', 16)}) s, (SELECT unnest(['embeddings', 'widest']) AS kind)""")
