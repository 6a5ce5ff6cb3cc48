"""Signatures on disk: JSON lines, wide and long CSV, folders of single files, run summaries."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import groupby, zip_longest

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillprint.functions import fixed_values as fixed
from quillprint.functions import text as fn
from quillprint.functions import vectors
from quillprint.session import any_path, empty_files, is_mounted, listed_by_cores, ship_package, write_folder_aside

METADATA_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()), T.StructField("extraction_method", T.StringType()),
    T.StructField("probe_set_id", T.StringType()), T.StructField("probe_count", T.LongType()),
    T.StructField("dna_dimension", T.LongType()), T.StructField("embedding_dimension", T.LongType()),
    T.StructField("reduction_method", T.StringType()), T.StructField("extraction_time", T.StringType()),
    T.StructField("computation_time_seconds", T.DoubleType()),
    T.StructField("model_metadata", T.StringType()), T.StructField("extractor_config", T.StringType()),
    T.StructField("aggregation_method", T.StringType()),
])
DOCUMENT_SCHEMA = T.StructType([T.StructField("signature", T.ArrayType(T.DoubleType())),
                                T.StructField("metadata", METADATA_SCHEMA)])


def checked(signature: Column) -> Column:
    """The signature; a NaN or infinite value fails the job, because JSON has no form for it."""
    bad = F.exists(signature, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(bad, F.raise_error(F.lit("Signature holds values that JSON cannot express"))
                  .cast("array<double>")).otherwise(signature)


def with_metadata(signatures: DataFrame, extraction_method: str = "unknown", probe_set_id: str = "unknown",
                  reduction: str = "unknown", merge: str | None = None, embedding_dimension: int = 768) -> DataFrame:
    """``model_name, signature`` with a metadata struct; columns of the same name take the place of the defaults."""
    have = set(signatures.columns)

    def field(name: str, default, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(default)).cast(kind).alias(name)

    fields = [
        F.col("model_name"), field("extraction_method", extraction_method, "string"),
        field("probe_set_id", probe_set_id, "string"), field("probe_count", 1, "bigint"),
        F.size("signature").cast("bigint").alias("dna_dimension"),
        field("embedding_dimension", embedding_dimension, "bigint"), field("reduction_method", reduction, "string"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("extraction_time"),
        field("computation_time_seconds", 0.0, "double"), field("model_metadata", None, "string"),
        field("extractor_config", None, "string"), field("aggregation_method", merge, "string")]
    return signatures.withColumn("metadata", F.struct(*fields))


def write_json(signatures: DataFrame, path: str) -> None:
    """One document ``{signature, metadata}`` per line and model."""
    documents = signatures.select(checked(F.col("signature")).alias("signature"), "metadata")
    documents.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    documents = spark.read.schema(DOCUMENT_SCHEMA).json(path)
    return documents.select(F.col("metadata.model_name").alias("model_name"), "signature", "metadata")


def write_wide_csv(signatures: DataFrame, path: str, width: int) -> None:
    """One row per model: its name and one column per dimension. A signature longer than ``width`` fails the job."""
    message = F.concat(F.lit(f"Signature longer than {width} values: "), F.col("model_name"))
    whole = F.when(F.size("signature") <= width, F.col("signature")).otherwise(
        F.raise_error(message).cast(signatures.schema["signature"].dataType))
    signatures = signatures.withColumn("signature", whole)
    columns = [F.get("signature", F.lit(i)).alias(f"{fixed.SIGNATURE_COLUMN_PREFIX}{i}") for i in range(width)]
    signatures.select("model_name", *columns).write.mode("overwrite").option("header", True).csv(path)


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of a wide CSV: every column with the value prefix, in file order; an empty cell is NaN."""
    table = spark.read.option("header", True).csv(path)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in table.columns
              if c.startswith(fixed.SIGNATURE_COLUMN_PREFIX)]
    return table.select("model_name", F.array(*values).alias("signature"),
                        F.lit("csv_loaded").alias("extraction_method"))


def write_value_csv(signatures: DataFrame, path: str) -> None:
    """One folder per model with a single column of values, in order. Folders carry the model's name as it is, escaped by
    the writer, so that no two models share one; rows of one name share its folder. On a file system that is mounted, tasks
    write the files themselves (Hadoop starts processes for every file there); other stores get Spark's writer."""
    name = F.concat(F.col("model_name"), F.lit(f"{fixed.SIGNATURE_FILE_SUFFIX}.csv")).alias("file")
    plain = isinstance(signatures.schema["signature"].dataType.elementType, (T.DoubleType, T.FloatType))
    if plain and is_mounted(signatures.sparkSession, path):
        values = F.transform("signature", lambda x: F.coalesce(x.cast("string"), F.lit("")))
        lines = signatures.where(F.size("signature") > 0).select(name, F.concat_ws("\n", values).alias("lines"))
        return _write_value_files(lines, path)
    values = signatures.select(name, F.posexplode("signature").alias("pos", fixed.SIGNATURE_VALUE_COLUMN))
    ordered = values.repartition("file").sortWithinPartitions("file", "pos")
    (ordered.select("file", fixed.SIGNATURE_VALUE_COLUMN).write.mode("overwrite").option("header", True)
     .partitionBy("file").csv(path))


#: What the partitioned writer escapes in folder names, and its name of a null.
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _write_value_files(lines: DataFrame, path: str) -> None:
    """``file, lines`` as folders of the partitioned writer, put in the place of ``path`` when all are written."""
    spark = lines.sparkSession
    ship_package(spark)
    # a JVM of another encoding cannot open names of other letters
    ascii_only = spark._jvm.System.getProperty("sun.jnu.encoding") != "UTF-8"
    label = uuid.uuid4().hex

    def folder(file: str | None) -> bytes:
        escaped = _NO_NAME if file is None else file.translate(_ESCAPED)
        kept = "".join(c if c < "\x80" else "".join(f"%{b:02X}" for b in c.encode()) for c in escaped)
        return f"file={kept if ascii_only else escaped}".encode()

    def write(aside: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = f"part-{TaskContext.get().partitionId():05d}-{label}.c000.csv"
            attempt = f".{part}.{uuid.uuid4().hex}".encode()
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            files = 0
            for file, same in groupby(rows, lambda row: row[0]):
                # values of one place come one after the other, and a null has no line
                places = zip_longest(*(text.split("\n") for _, text in same))
                values = [fixed.SIGNATURE_VALUE_COLUMN, *(value for place in places for value in place if value)]
                into = os.path.join(aside.encode(), folder(file))
                os.makedirs(into, exist_ok=True)
                with open(os.path.join(into, attempt), "w", encoding="utf-8", newline="") as out:
                    out.writelines(f"{value}\n" for value in values)
                os.replace(os.path.join(into, attempt), os.path.join(into, part.encode()))
                files += 1
            yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

        ordered = lines.repartition("file").sortWithinPartitions("file")
        ordered.mapInArrow(run, "files bigint").write.format("noop").mode("overwrite").save()

    write_folder_aside(spark, path, write)


def _name_of(file: Column) -> Column:
    """Model name of a signature file: the last path step that carries the file suffix, without it."""
    path = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    plain = F.regexp_extract(path, r"([^/=]+)\.(?:csv|json)(?:/[^/]*)?$", 1)
    # a folder of the partitioned writer holds the name once more escaped
    folder = F.regexp_extract(path, r"/file=([^/]+)\.(?:csv|json)/[^/]*$", 1)
    escaped = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.when(folder != "", escaped).otherwise(plain), f"{fixed.SIGNATURE_FILE_SUFFIX}$", "")


def _value_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, signature`` of single-column CSV files; a file without a number has an empty signature."""
    # a place in order: splits by their start, lines of a split as they are read
    with listed_by_cores(spark):
        files = spark.read.option("recursiveFileLookup", True).text(path)
    raw = files.select(
        F.col("_metadata.file_path").alias("file"), F.col("value").try_cast("double").alias("v"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"))
    numbers = F.collect_list(F.when(F.col("v").isNotNull(), F.struct("place", "v")))
    return raw.groupBy("file").agg(F.transform(F.array_sort(numbers), lambda r: r["v"]).alias("signature"))


def read_value_csv(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of single-column CSV files; the name comes from the file. Lines that are no numbers drop out."""
    return _value_files(spark, path).where(F.size("signature") > 0).select(
        _name_of(F.col("file")).alias("model_name"), "signature", F.lit("unknown").alias("extraction_method"))


def read_folder_report(spark: SparkSession, path: str) -> DataFrame:
    """``file, model_name, signature, extraction_method, reason`` of a folder of single files, CSV and JSON: every signature
    with a null reason, and a row with a reason for what is none (``no values``, ``no signature``, ``malformed JSON`` or
    ``empty file``), found by the same read."""
    values = f"{path}/*{fixed.SIGNATURE_FILE_SUFFIX}.csv"
    documents = f"{path}/*{fixed.SIGNATURE_FILE_SUFFIX}.json"
    present = [p for p in (values, documents) if any_path(spark, p)]
    if not present:
        raise ValueError(f"No signature files in {path}")
    # readers pass over files of no bytes; a part of a written table may be one, a file that stands for a signature not
    empty = [(name,) for p in present for name in empty_files(spark, p)]
    report = spark.createDataFrame(empty, "file string").select(
        "file", _name_of(F.col("file")).alias("model_name"), F.lit(None).cast("array<double>").alias("signature"),
        F.lit(None).cast("string").alias("extraction_method"), F.lit("empty file").alias("reason"))
    if values in present:
        some = F.size("signature") > 0
        report = report.unionByName(_value_files(spark, values).select(
            "file", _name_of(F.col("file")).alias("model_name"), F.when(some, F.col("signature")).alias("signature"),
            F.when(some, F.lit("unknown")).alias("extraction_method"),
            F.when(~some, F.lit("no values")).alias("reason")))
    if documents in present:
        schema = T.StructType([*DOCUMENT_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
        read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(documents)
        reason = F.when(F.col("_corrupt").isNotNull() & F.col("signature").isNull(), F.lit("malformed JSON")).when(
            F.col("signature").isNull(), F.lit("no signature"))
        file = F.col("_metadata.file_path")
        report = report.unionByName(read.select(
            file.alias("file"), F.coalesce("metadata.model_name", _name_of(file)).alias("model_name"), "signature",
            F.col("metadata.extraction_method").alias("extraction_method"), reason.alias("reason")))
    return report


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of a folder of single files, CSV and JSON; :func:`read_folder_report` tells what was left out."""
    return read_folder_report(spark, path).where(F.col("reason").isNull()).select(
        "model_name", "signature", "extraction_method")


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """``model_name, signature, extraction_method`` by the kind of the path: a JSON file, a CSV file (wide, or one column
    of values), or a folder of single files."""
    if path.endswith(".json"):
        documents = read_json(spark, path)
        return documents.select("model_name", "signature", F.col("metadata.extraction_method").alias("extraction_method"))
    if not path.endswith(".csv"):
        return read_folder(spark, path)
    header = spark.read.option("recursiveFileLookup", True).option("header", True).csv(path).columns
    wide = "model_name" in header
    return read_wide_csv(spark, path) if wide else read_value_csv(spark, path)


def summaries(signatures: DataFrame, dataset: str, dim: int, reduction: str, seconds: Column | None = None,
              root: str = "out") -> DataFrame:
    """Run summary per model: settings, statistics and where the signature goes below ``root``."""
    stats = vectors.statistics(F.col("signature"))
    known = fixed.DATASET_ALIASES.get(dataset, dataset)
    return signatures.select(
        "model_name", F.lit(dataset).alias("dataset"), F.lit(known).alias("dataset_full"),
        F.lit("embedding").alias("extractor_type"), F.lit(dim).alias("dna_dimension"),
        F.lit(reduction).alias("reduction_method"), F.col("probe_count").alias("num_probes"),
        (F.lit(0.0) if seconds is None else seconds).alias("total_time_seconds"), stats.alias("signature_stats"),
        fn.signature_file(root, F.lit(dataset), F.col("model_name")).alias("output_file"))


def write_summaries(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
