"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPREAD = "spark.quillprint.spread.partitions"


def build_session(app: str = "quillprint", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with AQE on, UTC timestamps and Arrow transfer.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave both to the submit command.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = (builder.master(master)
                   .config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", os.environ.get("QUILLPRINT_DRIVER_MEMORY", "8g")))
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, wherever the job was started from."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillprint-package-")
    archive = shutil.make_archive(os.path.join(folder, "quillprint"), "zip", os.path.dirname(package),
                                  os.path.basename(package))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a local one where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="quillprint-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, one per call."""
    return f"{shared_folder(spark)}/quillprint/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For results that several later steps use: they are computed once, survive lost executors, and their real size is
    known when joins are planned.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled._settled_path = path
    return settled


def discard(*settled: DataFrame) -> None:
    """Delete tables made by :func:`settle` that nothing will read again."""
    for df in settled:
        delete_path(df.sparkSession, df._settled_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all it holds."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def write_whole(spark: SparkSession, path: str, content: str) -> None:
    """A small file that is there with all its content or not at all: written under a hidden name and renamed. Something
    of that name already is an error."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    final = paths(path)
    aside = paths(final.getParent(), f"_{final.getName()}-{uuid.uuid4().hex}")
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(final.getParent())
    out = files.create(aside)
    out.write(bytearray(content.encode()))
    out.close()
    if files.exists(final) or not files.rename(aside, final):
        files.delete(aside, False)
        raise FileExistsError(path)


def is_mounted(spark: SparkSession, path: str) -> bool:
    """Whether a path lies on a file system that processes reach without Hadoop."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def write_folder_aside(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """A folder on a mounted file system in the place of ``path``, with all its content or not at all: ``write`` gets the
    local path of a hidden folder beside it, which is renamed. A folder whose writing fails goes."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    final = files.makeQualified(paths(path))
    aside = paths(final.getParent(), f"_{final.getName()}-{uuid.uuid4().hex}")
    files.mkdirs(aside)
    try:
        write(aside.toUri().getPath())
        files.create(paths(aside, "_SUCCESS")).close()
    except BaseException:
        files.delete(aside, True)
        raise
    files.delete(final, True)
    if not files.rename(aside, final):
        raise OSError(f"Cannot rename {aside} to {final}")


@contextmanager
def listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """Files that a reader lists meanwhile are listed by a few tasks a core; by default by up to 10 000, of a folder each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, min(int(before or 10_000), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def any_path(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern names anything."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def empty_files(spark: SparkSession, pattern: str) -> list[str]:
    """The files of no bytes that a pattern names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return [f.getPath().toString() for f in found or [] if f.getLen() == 0 and f.isFile()]


def path_bytes(spark: SparkSession, path: str) -> int:
    """Size of everything below a path."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as it lies; where the caller sets ``SPREAD`` in the session, its rows are dealt out to so many
    partitions (for tables of few row groups and work that is heavy per row)."""
    table = spark.read.parquet(path)
    parts = spark.conf.get(SPREAD, None)
    return table.repartition(int(parts)) if parts else table


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to as many tasks as a shuffle has: for work that is heavy per row on tables of few row groups."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
