"""Cached probe texts and saved probe sets."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.session import any_path, delete_path, write_whole

CACHE_SCHEMA = "probe_idx bigint, text string, dataset_id string, max_samples int, random_seed int"
SET_SCHEMA = ("probes array<string>, set_id string, description string, domain string, creation_time string, "
              "metadata map<string,string>, offset bigint")
DOCUMENT_TEXTS = 50_000


def _claims(spark: SparkSession, path: str) -> DataFrame:
    """Key and set of every claim, with the one that counts: the earliest, of equally early ones the smaller name."""
    schema = "dataset_id string, max_samples int, random_seed int, set string"
    if not any_path(spark, f"{path}/claims/*.json"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(f"{path}/claims/*.json").select(
        "*", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("set").alias("name")).alias("order"))
    return rows.groupBy("dataset_id", "max_samples", "random_seed").agg(F.min_by("set", "order").alias("set"))


def read_probe_cache(spark: SparkSession, path: str) -> DataFrame:
    """All cached probe texts, one set per key."""
    if not any_path(spark, f"{path}/sets/*"):
        return spark.createDataFrame([], CACHE_SCHEMA)
    texts = spark.read.schema("probe_idx bigint, text string").parquet(f"{path}/sets/*").select(
        "probe_idx", "text", F.regexp_extract(F.col("_metadata.file_path"), r"/sets/([0-9a-f]+)/[^/]+$", 1).alias("set"))
    return texts.join(_claims(spark, path), "set").select(*[f.split()[0] for f in CACHE_SCHEMA.split(", ")])


def lookup(cache: DataFrame, dataset: str, n: int, seed: int) -> DataFrame:
    return cache.where((F.col("dataset_id") == dataset) & (F.col("max_samples") == n)
                       & (F.col("random_seed") == seed)).select("probe_idx", "text")


def _set_of(spark: SparkSession, path: str, dataset: str, n: int, seed: int) -> str | None:
    found = _claims(spark, path).where((F.col("dataset_id") == dataset) & (F.col("max_samples") == n)
                                       & (F.col("random_seed") == seed)).first()
    return found.set if found else None


def cached_probes(spark: SparkSession, path: str, dataset: str, n: int, seed: int) -> DataFrame | None:
    """The set of one key, read from its folder alone; None where there is none."""
    name = _set_of(spark, path, dataset, n, seed)
    return None if name is None else spark.read.schema("probe_idx bigint, text string").parquet(f"{path}/sets/{name}")


def save_probes(probes: DataFrame, path: str, dataset: str, n: int, seed: int) -> bool:
    """Save under the key unless it is there already. Returns whether this set is the one that counts.

    The set is written aside under a name of its own; then a small file claims the key for it. The earliest claim counts, so
    of two writers at the same time one finds the other's before its own and takes its set away again; readers never see
    two sets of a key, nor half of one.
    """
    spark = probes.sparkSession
    if _set_of(spark, path, dataset, n, seed) is not None:
        return False
    name = uuid.uuid4().hex
    probes.select(F.col("probe_idx").cast("bigint").alias("probe_idx"), "text").write.parquet(f"{path}/sets/{name}")
    write_whole(spark, f"{path}/claims/{name}.json", json.dumps(
        {"dataset_id": dataset, "max_samples": n, "random_seed": seed, "set": name}))
    if _set_of(spark, path, dataset, n, seed) == name:
        return True
    for loser in (f"{path}/claims/{name}.json", f"{path}/sets/{name}"):
        delete_path(spark, loser)
    return False


def probe_set_documents(probes: DataFrame, description: str, domain: str,
                        texts_per_document: int = DOCUMENT_TEXTS) -> DataFrame:
    """Probe sets as JSON text: ``set_id, document``. A set of more than ``texts_per_document`` texts is cut into
    several documents, each with the position of its first text."""
    block = F.floor(F.col("probe_idx") / texts_per_document)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("probe_idx", "text"))), lambda r: r["text"])
    sets = probes.groupBy("set_id", block.alias("block")).agg(
        texts.alias("probes"), F.min("probe_idx").cast("bigint").alias("offset"))
    document = F.to_json(F.struct(
        "probes", "set_id", F.lit(description).alias("description"), F.lit(domain).alias("domain"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("creation_time"), "offset",
        F.create_map(F.lit("size"), F.size("probes").cast("string")).alias("metadata")))
    return sets.select("set_id", document.alias("document"))


def write_probe_sets(documents: DataFrame, path: str) -> None:
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def read_probe_sets(spark: SparkSession, path: str) -> DataFrame:
    """``set_id, probe_idx, text`` of saved probe sets."""
    parsed = spark.read.text(path).select(F.from_json("value", SET_SCHEMA).alias("s"))
    rows = parsed.select("s.set_id", "s.offset", F.posexplode("s.probes").alias("_pos", "text"))
    first = F.coalesce("offset", F.lit(0).cast("bigint"))
    return rows.select("set_id", (first + F.col("_pos")).alias("probe_idx"), "text")
