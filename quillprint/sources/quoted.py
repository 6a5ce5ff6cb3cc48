"""Files whose quoted values may hold the separator, read by many tasks.

A file is read in pieces between separators. Whether a piece begins within quotes depends on all pieces before it, so each
piece says how it would end if entered outside and if entered inside quotes. Splits are summed up in the same two flags,
the chain over one row per split tells every split how it is entered, and its pieces follow from that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ["file", "_start"]
_FIELDS = r'(?:(?:"(?:[^"]|"")*+"[^,]*+|(?!")[^,]*+),)*+"(?:[^"]|"")*+$'
#: A CSV line that leaves a quote open: entered outside quotes, and entered within.
OPENS, STAYS_OPEN = f"(?s)^{_FIELDS}", f'(?s)^(?:[^"]|"")*+(?:$|"[^,]*+,{_FIELDS})'
#: What stands between the strings of a JSON array, other than its punctuation.
BARE = r"[^\s,\[\]]+"
#: Signs of values within values.
NESTED = r"[\[,]\s*\[|[{}:]"


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, _start, _row, value``: the pieces between separators, with the split they stand in and their order there."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), "value")


def _entered(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """``_s0, _s1``: whether each row is entered within quotes (1) or not (0), if the first row of its group is entered
    outside or inside. ``_out`` and ``_in`` say how a row ends if entered outside and inside."""
    ordered = Window.partitionBy(*by).orderBy(order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when((F.col("_out") == 1) & (F.col("_in") == 0), 1).otherwise(0)
    df = df.withColumn("_turns", F.sum(turn).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    known = F.when(F.col("_out") == F.col("_in"), F.col("_out").bitwiseXOR(F.col("_turns") % 2))
    df = df.withColumn("_known", F.last(known, ignorenulls=True).over(before))
    turned = (F.col("_turns") - turn) % 2
    for name, first in (("_s0", 0), ("_s1", 1)):
        df = df.withColumn(name, F.coalesce("_known", F.lit(first)).bitwiseXOR(turned))
    return df.drop("_turns", "_known")


def _left(state: str) -> Column:
    return F.when(F.col(state) == 1, F.col("_in")).otherwise(F.col("_out"))


def in_records(pieces: DataFrame, out: Column, kept: Column, ends: Callable[[Column], Column], at_end: int = 0,
               header: int = 0) -> DataFrame:
    """``file, _start, _row, value, inside, position``: every piece with whether it begins within quotes and the number of
    records before it, over all files in name order. The first ``header`` records of every file drop out.

    ``out`` and ``kept`` say whether a piece ends within quotes if it is entered outside and inside; ``ends(inside)`` counts the
    records that end in it. A file that does not end in the state ``at_end`` fails the job.
    """
    rows = pieces.withColumn("_out", out.cast("int")).withColumn("_in", kept.cast("int"))
    rows = _entered(rows, PLACE, "_row")
    rows = rows.withColumn("_e0", ends(F.col("_s0") == 1)).withColumn("_e1", ends(F.col("_s1") == 1))

    splits = rows.groupBy(*PLACE).agg(
        F.max_by(_left("_s0"), "_row").alias("_out"), F.max_by(_left("_s1"), "_row").alias("_in"),
        F.sum("_e0").alias("_e0"), F.sum("_e1").alias("_e1"))
    splits = _entered(splits, ["file"], "_start")
    splits = splits.withColumn("_ends", F.when(F.col("_s0") == 1, F.col("_e1")).otherwise(F.col("_e0")))
    whole = Window.partitionBy("file")
    chain = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    unfinished = F.max_by(_left("_s0"), "_start").over(whole) != at_end
    skipped = F.least(F.sum("_ends").over(whole), F.lit(header))
    splits = (splits.withColumn("_unfinished", unfinished)
              .withColumn("_inner", F.coalesce(F.sum("_ends").over(chain), F.lit(0)))
              .withColumn("_skips", F.when(F.col("_start") == F.min("_start").over(whole), skipped).otherwise(0)))
    # one row per split
    files = Window.orderBy(*PLACE)
    earlier = F.coalesce(F.sum("_ends").over(files.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_before", earlier - F.sum("_skips").over(
        files.rowsBetween(Window.unboundedPreceding, 0)))
    broken = F.raise_error(F.concat(F.lit("A quoted value or array without its end in "), F.col("file")))
    splits = splits.select(
        *PLACE, F.col("_s0").alias("_entry"), "_inner",
        F.when(F.col("_unfinished"), broken.cast("bigint")).otherwise(F.col("_before")).alias("_before"))

    before = Window.partitionBy(*PLACE).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("_n0", F.coalesce(F.sum("_e0").over(before), F.lit(0)))
            .withColumn("_n1", F.coalesce(F.sum("_e1").over(before), F.lit(0))))
    within = F.col("_entry") == 1
    number = F.when(within, F.col("_n1")).otherwise(F.col("_n0"))
    placed = rows.join(splits, PLACE).select(
        *PLACE, "_row", "value", (F.when(within, F.col("_s1")).otherwise(F.col("_s0")) == 1).alias("inside"),
        (F.col("_before") + number).alias("position"), (F.col("_inner") + number).alias("_number"))
    return placed.where(F.col("_number") >= header).drop("_number")


def _joined(pieces: DataFrame, separator: str) -> DataFrame:
    """``position, value``: the pieces of one record put together again."""
    parts = F.array_sort(F.collect_list(F.struct(*PLACE, "_row", "value")))
    return pieces.groupBy("position").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), separator).alias("value"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``position, value``: the records of CSV files below their header line, each as text. A quote opens a value only where
    the value begins and is doubled within; blank lines between records drop out. Only records of several lines are
    put together by a shuffle."""
    value = F.col("value")
    blank = value.isin("", "\r")
    out, kept = value.rlike(OPENS), value.rlike(STAYS_OPEN)

    def ends(inside: Column) -> Column:
        return F.when(inside, (~kept).cast("bigint")).otherwise((~out & ~blank).cast("bigint"))

    lines = in_records(read_pieces(spark, path, "\n"), out, kept, ends, header=1)
    lines = lines.where(F.col("inside") | ~blank)
    single = ~F.col("inside") & ~out
    records = lines.where(single).select("position", "value").unionByName(_joined(lines.where(~single), "\n"))
    return records.withColumn("value", F.regexp_replace("value", "\r$", ""))


def json_strings(spark: SparkSession, path: str) -> DataFrame:
    """``position, text``: the elements of JSON arrays of strings. Pieces lie between quotes, and one that ends in an odd
    number of backslashes goes on behind its quote. A bare word or number is its text, ``null`` is null; nested values and
    text that is no JSON fail the job."""
    value = F.col("value")
    escaped = F.length(F.regexp_extract(value, r"(\\*)$", 1)) % 2 == 1

    def ends(inside: Column) -> Column:
        return F.when(inside, (~escaped).cast("bigint")).otherwise(F.regexp_count(value, F.lit(BARE)).cast("bigint"))

    # the last piece has no quote behind it: it has to be entered outside
    pieces = in_records(read_pieces(spark, path, '"'), F.lit(True), escaped, ends, at_end=1)
    parsed = F.from_json(F.concat(F.lit('["'), value, F.lit('"]')), "array<string>")[0]
    wrong = F.raise_error(F.concat(F.lit("Not an array of strings: "), F.substring("value", 1, 80))).cast("string")
    quoted = _joined(pieces.where("inside"), '"').select("position", F.coalesce(parsed, wrong).alias("text"))
    nested = value.rlike(NESTED)
    between = pieces.where(~F.col("inside") & (value.rlike(BARE) | nested))
    found = F.when(nested, F.array(wrong)).otherwise(F.regexp_extract_all(value, F.lit(BARE), F.lit(0)))
    words = between.select("position", F.posexplode(found).alias("_at", "_word")).select(
        (F.col("position") + F.col("_at")).alias("position"),
        F.when(F.col("_word") != "null", F.col("_word")).alias("text"))
    return quoted.unionByName(words)
