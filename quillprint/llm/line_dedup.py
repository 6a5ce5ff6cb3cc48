"""Line dedup by distinct-site spread.

A line that many sites carry is boilerplate. Every line gets a HyperLogLog sketch of its sites; partial sketches are
merged by the aggregation, so a line that half of all documents carry is no special case. Estimates clearly off the
threshold decide at once; lines near it get an exact distinct count. A boilerplate line stays in its first document and
goes from all others, so that copied documents leave one whole copy behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillprint.functions.binding import let
from quillprint.llm.common import free_name, text_key
from quillprint.session import settle

#: Sketch of 2^10 registers: relative error about 3 %, exact below some dozens. An estimate within NEAR of the threshold
#: is counted exactly; that is more than six standard errors.
SKETCH_BITS = 10
NEAR = 0.25
MIN_SITES = 5
SPACE = " \t\r\f\x0b"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normal_form(line: Column) -> Column:
    """What makes two lines equal: everything but white space at both ends."""
    return F.trim(line, F.lit(SPACE))


def _positions(docs: DataFrame, text: str, site: str, key: str) -> DataFrame:
    """``text_id, site, key, pos, line``: one row per line that is not blank."""
    rows = docs.select(F.col(text).alias("text"), F.col(site).cast("string").alias("site"), F.col(key).alias("key"))
    exploded = rows.where("text IS NOT NULL").select(
        text_key(F.col("text")).alias("text_id"), "site", "key", F.posexplode(lines_of(F.col("text"))).alias("pos", "l"))
    return exploded.withColumn("l", normal_form(F.col("l"))).where("l <> ''").select(
        "text_id", "site", "key", "pos", text_key(F.col("l")).alias("line"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source",
                key: str = "doc_id") -> DataFrame:
    """``line, first_key``: 128-bit hash of every line on at least ``min_sites`` sites, and the smallest key that
    carries it (null only if all keys are). A null site is no site."""
    rows = _positions(docs, text, site, key)
    sketches = settle(rows.groupBy("line").agg(F.hll_sketch_agg("site", SKETCH_BITS).alias("sketch"),
                                               F.min("key").alias("first_key"), F.count("site").alias("n"))
                      .where(F.col("n") >= min_sites)
                      .select("line", "first_key", F.hll_sketch_estimate("sketch").alias("sites")), "line-sketches")
    sure = sketches.where(F.col("sites") > min_sites * (1 + NEAR))
    near = sketches.where((F.col("sites") <= min_sites * (1 + NEAR)) & (F.col("sites") >= min_sites * (1 - NEAR)))
    exact = (rows.where("site IS NOT NULL").select("line", "site").join(near.select("line"), "line", "left_semi")
             .groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("site").alias("sites"))
             .where(F.col("sites") >= min_sites))
    return sure.select("line", "first_key").unionByName(
        near.select("line", "first_key").join(exact.select("line"), "line", "left_semi"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source",
                       key: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, the text without boilerplate lines, with ``n_lines`` and ``n_dropped``.

    Lines are what newlines separate; equal lines differ in white space at their ends at most; blank lines stay. A
    boilerplate line stays wherever it stands in the document of its smallest key (rows of equal key and text are treated
    alike) and goes from the others; a null key is never the first one unless all are null. A null text has no lines and
    stays null. Input columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    found = settle(boilerplate(docs, min_sites, text, site, key), "boilerplate-lines")
    rows = _positions(docs, text, site, key).select("text_id", "key", "pos", "line")
    cut = (rows.join(found, "line").where(~F.col("key").eqNullSafe(F.col("first_key")))
           .groupBy(F.col("text_id").alias("_text_id"), F.col("key").alias("_key"))
           .agg(F.collect_set("pos").alias("_cut")))
    id_name = free_name(docs, "_id")
    met = docs.withColumn(id_name, text_key(F.col(text))).join(
        cut, (F.col(id_name) == F.col("_text_id")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    kept = let(F.struct(lines_of(F.col(text)).alias("l"), F.col("_cut").alias("c")), lambda s: F.array_join(
        F.filter(s["l"], lambda line, i: ~F.array_contains(s["c"], i)), "\n"))
    return met.select(
        *[F.when(F.col("_cut").isNull(), F.col(text)).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`")
          for c in docs.columns],
        F.coalesce(F.size(lines_of(F.col(text))), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("bigint").alias("n_dropped")).withColumn(
            "n_lines", F.greatest("n_lines", F.lit(0))).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))


def digest(cleaned: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text_sha256`` of the cleaned texts (null where the text is)."""
    return cleaned.select("doc_id", "n_lines", "n_dropped",
                          F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def digest_sql(docs: str = "documents", min_sites: int = MIN_SITES) -> str:
    trim = f"trim(l, '{SPACE[0]}' || chr(9) || chr(13) || chr(12) || chr(11))"
    return f"""
    WITH rows AS (SELECT doc_id, source, text, i AS pos, string_split(text, chr(10))[i] AS l
                  FROM {docs}, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
    normal AS (SELECT *, {trim} AS line FROM rows),
    found AS (SELECT line, min(doc_id) AS first_id FROM normal WHERE line <> '' GROUP BY line
              HAVING count(DISTINCT source) >= {min_sites}),
    kept AS (SELECT n.*, f.line IS NOT NULL AND n.doc_id IS DISTINCT FROM f.first_id AS cut
             FROM normal n LEFT JOIN found f USING (line)),
    joined AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_dropped,
                      coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT cut), '') AS kept_text
               FROM kept GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
           CASE WHEN d.text IS NULL THEN NULL ELSE sha256(kept_text) END AS text_sha256
    FROM {docs} d LEFT JOIN joined j USING (doc_id)"""
