"""Probe texts from dataset files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.functions import fixed_values as fixed
from quillprint.session import path_exists, settle
from quillprint.sources import quoted


def text_column(df: DataFrame, wanted: str, fallbacks: list[str] | None = None) -> str:
    """The wanted column, else the first fallback that exists, else an error."""
    for name in [wanted, *(fallbacks or [])]:
        if name in df.columns:
            return name
    raise ValueError(f"Text column '{wanted}' not found. Available: {df.columns}")


def read_dataset(spark: SparkSession, path: str, column: str, order: str, n: int | None = None,
                 fmt: str = "parquet", dataset: str | None = None, **options) -> DataFrame:
    """``dataset, probe_idx, text`` of a dataset table: only text and order columns are read, first n rows kept."""
    table = spark.read.format(fmt).options(**options).load(path)
    texts = table.select(F.lit(dataset or path).alias("dataset"), F.col(order).cast("bigint").alias("probe_idx"),
                         F.col(text_column(table, column)).alias("text"))
    return texts.orderBy("probe_idx").limit(n) if n else texts


def read_named_dataset(spark: SparkSession, name: str, path: str, order: str, n: int | None = None,
                       fmt: str = "parquet", **options) -> DataFrame:
    """A known dataset (or alias) from its files at ``path``: its text column, or a usual one where that is missing, and
    its limit of rows unless ``n`` says otherwise. A ``subset`` and a ``split`` column, where the files have one, are held
    to the dataset's settings."""
    known = fixed.DATASET_ALIASES.get(name, name)
    if known not in fixed.DATASETS:
        raise ValueError(f"Unknown dataset: {name}. Known: {', '.join(fixed.DATASETS)}")
    _, subset, split, column, limit = fixed.DATASETS[known]
    table = spark.read.format(fmt).options(**options).load(path)
    for setting, value in (("subset", subset), ("split", split)):
        if value is not None and setting in table.columns:
            table = table.where(F.col(setting) == value)
    texts = table.select(F.lit(known).alias("dataset"), F.col(order).cast("bigint").alias("probe_idx"),
                         F.col(text_column(table, column, fixed.TEXT_COLUMN_FALLBACKS)).alias("text"))
    rows = limit if n is None else n
    return texts if rows is None else texts.orderBy("probe_idx").limit(rows)


def union_datasets(readers: dict[str, callable], settled: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Union of the datasets that can be read, and the reason for each that cannot.

    A dataset may also fail after it was opened, at a row far into it. With ``settled`` each is written to the shared
    folder once and its failure is its reason; without, that failure is the failure of whoever reads the union.
    """
    frames, skipped = [], {}
    for name, read in readers.items():
        try:
            frame = read().select(F.lit(name).alias("dataset"), "probe_idx", "text")
            frames.append(settle(frame, "dataset") if settled else frame)
        except Exception as error:  # a dataset that fails is left out, as a warning
            skipped[name] = str(error)
    if not frames:
        raise ValueError(f"No dataset could be read: {skipped}")
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union, skipped


def read_prompt_csv(spark: SparkSession, path: str, column: str = "prompt", n: int | None = None,
                    dataset: str = "embedllm") -> DataFrame:
    """Prompts of a CSV file with a header; every value is text, a missing one is the word nan.

    Quoted values may span lines; a large file is still read by many tasks. A quote that nothing closes fails the job.
    """
    columns = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    chosen = columns.columns.index(text_column(columns, column, fixed.TEXT_COLUMN_FALLBACKS))
    schema = ", ".join(f"c{i} string" for i in range(len(columns.columns)))
    cell = F.from_csv("value", F.lit(schema), {"escape": '"'})[f"c{chosen}"]
    rows = quoted.csv_records(spark, path).select(
        F.lit(dataset).alias("dataset"), F.col("position").alias("probe_idx"),
        F.coalesce(cell, F.lit("nan")).alias("text"))
    return rows.where(F.col("probe_idx") < n) if n else rows


def read_string_array(spark: SparkSession, path: str, dataset: str, n: int | None = None,
                      generate: callable | None = None) -> DataFrame:
    """Texts of JSON arrays of strings; a large file is read by many tasks. Where the path is missing, ``generate()``
    supplies the rows and they are saved first, one array per file."""
    if not path_exists(spark, path):
        if generate is None:
            raise FileNotFoundError(path)
        made = generate().select(F.col("sample_id").alias("probe_idx"), "text")
        write_string_array(made, path)
    rows = quoted.json_strings(spark, path).select(
        F.lit(dataset).alias("dataset"), F.col("position").alias("probe_idx"), "text")
    return rows.where(F.col("probe_idx") < n) if n else rows


def write_string_array(texts: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Texts as JSON arrays of strings, in position order, ``per_file`` texts to a file."""
    block = F.floor(F.col("probe_idx") / per_file)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("probe_idx", "text"))), lambda r: r["text"])
    arrays = texts.groupBy(block.alias("block")).agg(F.to_json(ordered).alias("value"))
    files = arrays.repartitionByRange(F.col("block")).sortWithinPartitions("block")
    files.select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def cached_embeddings(texts: DataFrame, path: str, encode: callable, keys: list[str],
                      force: bool = False) -> DataFrame:
    """Embeddings of texts, from a Parquet cache; only rows the cache lacks are encoded and appended."""
    spark = texts.sparkSession
    have = path_exists(spark, path) and not force
    missing = texts.join(spark.read.parquet(path).select(*keys), keys, "left_anti") if have else texts
    encoded = encode(missing).select(*keys, "embedding")
    encoded.write.mode("append" if have else "overwrite").parquet(path)
    return texts.join(spark.read.parquet(path), keys)
