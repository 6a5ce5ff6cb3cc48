"""WARC archives: written record by record, read back by boundary-chain verification.

An archive is a sequence of records; each says how long it is. Reading splits archives wherever the record magic stands,
also within payloads. A task emits, for every place of the magic that begins a well-formed header, a candidate: its offset
and the offset where its record would end. Pointer jumping from the start of each file then finds which candidates are
reached, and only these are records. Nothing depends on how files are split among tasks, and no file is held whole.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillprint.session import path_bytes, scratch_path, settle, ship_package

# Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EMPTY_DATE = "1970-01-01T00:00:00Z"

#: Payloads of at least so many bytes are written once; equal ones revisit the record that holds them.
MIN_REVISIT = 0
#: Bytes of the table of repeated payloads up to which it is sent to every task.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Jumps are doubled so often at most: 2^40 records in a file.
ROUNDS = 40


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hexadecimal digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(value, shift).bitwiseAND(31) + 1
            parts.append(F.substring(F.lit(BASE32), place, F.lit(1)))
    return F.concat(*parts)


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT, key: str = "page_id",
                 payload: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, record_type, refers_to`` of every row.

    Of equal payloads the one of the largest key is the response (of several rows with that key all are); a null key comes
    before all others. Only the table of repeated payloads (digest and largest key) is joined.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col("url"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn(
        "size", F.octet_length("payload"))
    same = rows.where(F.col("size") >= min_revisit).groupBy("digest", "size").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first"))
    path = scratch_path(pages.sparkSession, "warc-repeated")
    same.where("n > 1").select(F.col("digest").alias("_digest"), "first").write.parquet(path)
    repeated = pages.sparkSession.read.schema("_digest string, first " + rows.schema["page_id"].dataType.simpleString()
                                              ).parquet(path)
    if path_bytes(pages.sparkSession, path) <= BROADCAST_BYTES:
        repeated = F.broadcast(repeated)
    met = rows.join(repeated, (F.col("digest") == F.col("_digest")) & (F.col("size") >= min_revisit), "left")
    revisit = F.col("_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select("page_id", "url", "payload", "digest",
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("first")).alias("refers_to"))


def _header_value(column: Column) -> Column:
    """A value that keeps to its line."""
    return F.regexp_replace(column, r"[\x00-\x1f\x7f]", " ")


def write(records: DataFrame, path: str) -> None:
    """Write planned records as WARC files below ``path``.

    Spark's text writer ends every row with the bytes that end a record, so files are committed as any table's are.
    A revisit holds no payload, as its profile says. Null keys and addresses have no header line.
    """
    def line(name, column):
        return F.coalesce(F.concat(F.lit(f"{name}: "), _header_value(column.cast("string")), F.lit("\r\n")), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        F.lit(f"WARC-Date: {EMPTY_DATE}\r\n"), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END)), block)
    records.select(record.alias("value")).write.option("lineSep", END).text(path)


_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.I)
_FIELD = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)")
FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, value``: what stands between two places of the magic, in the order of the file within a split."""
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"))


def _parse(piece: bytes) -> tuple[int, dict[bytes, bytes], int] | None:
    """Bytes from the magic to the end of the record, its fields, and where the block begins in the piece."""
    head = piece.find(b"\r\n\r\n")
    if head < 0:
        return None
    length = _LENGTH.search(piece[:head + 2])
    if not length:
        return None
    fields = {k.strip().lower(): v.strip() for k, v in _FIELD.findall(piece[:head])}
    return len(MAGIC) + head + 4 + int(length[1]) + 4, fields, head + 4


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, next`` with the header's fields, of every candidate; payload size and digest where the whole block
    stands in its piece (else null, which means that the magic stands in the payload).
    """
    step = len(MAGIC)
    sizes = _pieces(spark, path).groupBy("file", "split").agg(F.sum(F.length("value") + step).alias("bytes"))
    sizes = settle(sizes, "warc-splits")  # one row per split
    order = "PARTITION BY file ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    begins = sizes.withColumn("begin", F.expr(f"coalesce(sum(bytes) OVER ({order}), 0)")).select("file", "split", "begin")

    def parse(batches):
        now, at = None, 0
        for batch in batches:
            rows = {k: [] for k in ("file", "split", "at", "bytes", "size", "digest", *FIELDS)}
            for file, split, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, split) != now:
                    now, at = (file, split), 0
                # A piece follows the magic that ended the one before; the first of a file follows the file's start.
                found = _parse(value)
                if found:
                    total, fields, body = found
                    block_size = total - step - body - 4
                    whole = len(value) >= body + block_size
                    block = value[body:body + block_size]
                    payload = block[block.find(b"\r\n\r\n") + 4:] if block.startswith(b"HTTP/") else block
                    rows["file"].append(file)
                    rows["split"].append(split)
                    rows["at"].append(at - step)
                    rows["bytes"].append(total)
                    rows["size"].append(len(payload) if whole else None)
                    rows["digest"].append(base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None)
                    for name in FIELDS:
                        rows[name].append(fields.get(name.encode(), b"").decode("utf-8", "replace") or None)
                at += len(value) + step
            yield pa.RecordBatch.from_pydict(rows, schema)

    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("at", pa.int64()), ("bytes", pa.int64()),
                        ("size", pa.int64()), ("digest", pa.string()), *[(f, pa.string()) for f in FIELDS]])
    named = ", ".join(f"`{f}` string" for f in FIELDS)
    found = _pieces(spark, path).mapInArrow(
        parse, f"file string, split bigint, at bigint, bytes bigint, size bigint, digest string, {named}")
    placed = found.join(begins, ["file", "split"]).withColumn("at", F.col("at") + F.col("begin"))
    return placed.select("file", "at", (F.col("at") + F.col("bytes")).alias("next"), "size", "digest",
                         *[F.col(f"`{f}`").alias(f.removeprefix("warc-").replace("-", "_")) for f in FIELDS])


def reachable(found: DataFrame) -> DataFrame:
    """``file, at`` of the candidates that a chain from the file's start reaches, by pointer jumping.

    In round k the reached ones also reach what lies 2^k records ahead, and all jumps are doubled.
    """
    jumps = settle(found.select("file", "at", "next"), "warc-jumps")
    nodes = jumps.select("file", "at")
    reached = settle(jumps.where("at = 0").select("file", "at"), "warc-reached")
    for _ in range(ROUNDS):
        ahead = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        more = settle(reached.union(ahead.join(nodes, ["file", "at"], "left_semi")).distinct(), "warc-reached")
        further = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jumps = settle(jumps.join(further, ["file", "next"]).select("file", "at", F.col("then").alias("next")),
                       "warc-jumps")
        reached = more
        if jumps.isEmpty():
            return reached
    raise RuntimeError("a file has more records than can be followed")


#: Reassembly meets pieces and records by file and stretch of so many bytes.
STRETCH = 64 * 1024 * 1024


def payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """``file, at, payload`` of the given records (``file, at, next``), put together from all pieces they span."""
    step = len(MAGIC)
    sizes = _pieces(spark, path).groupBy("file", "split").agg(F.sum(F.length("value") + step).alias("bytes"))
    order = "PARTITION BY file ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    begins = settle(sizes.withColumn("begin", F.expr(f"coalesce(sum(bytes) OVER ({order}), 0)"))
                    .select("file", "split", "begin"), "warc-splits")

    def place(batches):
        now, at = None, 0
        for batch in batches:
            places = []
            for file, split, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, split) != now:
                    now, at = (file, split), 0
                places.append(at)
                at += len(value) + step
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())],
                                             ["file", "split", "value", "pos"])

    placed = _pieces(spark, path).mapInArrow(place, "file string, split bigint, value binary, pos bigint")
    placed = placed.join(begins, ["file", "split"]).select("file", (F.col("pos") + F.col("begin")).alias("pos"), "value")
    placed = placed.withColumn("stretch", F.floor(F.col("pos") / STRETCH))
    wanted = records.select("file", "at", "next").withColumn("stretch", F.explode(F.sequence(
        F.floor(F.col("at") / STRETCH), F.floor(F.col("next") / STRETCH))))
    met = wanted.join(placed, ["file", "stretch"]).where((F.col("pos") > F.col("at")) & (F.col("pos") < F.col("next")))
    # Several pieces of one record have the magic between them; the record ends where its header says.
    whole = met.groupBy("file", "at", "next").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("parts"))

    def cut(batches):
        for batch in batches:
            found = []
            for parts in batch.column(2).to_pylist():
                data = MAGIC.join(p["value"] for p in parts)
                total, _, body = _parse(data)
                block = data[body:total - step - 4]
                found.append(block[block.find(b"\r\n\r\n") + 4:] if block.startswith(b"HTTP/") else block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())],
                                             ["file", "at", "payload"])

    return whole.select("file", "at", "parts").mapInArrow(cut, "file string, at bigint, payload binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, next, record_type, record_id, target_uri, payload_bytes, payload_digest, refers_to, intact`` of every
    record of the archives below ``path``.

    Size and digest are those of the payload found (of a revisit: the digest that it states, and the size of the record of
    that digest; null if there is none). ``intact`` says whether the stated digest is the one found. A file that does not
    begin with a record has none; what follows a broken record is not reached.
    """
    ship_package(spark)
    found = settle(candidates(spark, path), "warc-candidates")
    records = settle(found.join(reachable(found), ["file", "at"], "left_semi"), "warc-records")
    open_ = records.where("size IS NULL")
    if not open_.isEmpty():
        whole = payloads(spark, path, open_).select(
            "file", "at", F.length("payload").cast("bigint").alias("_size"), sha1_base32(F.col("payload")).alias("_digest"))
        records = records.join(whole, ["file", "at"], "left").withColumn(
            "size", F.coalesce("size", "_size")).withColumn("digest", F.coalesce("digest", "_digest"))
    stated = F.upper(F.regexp_replace("payload_digest", "^sha1:", ""))
    records = records.withColumn("stated", stated)
    held = records.where("type <> 'revisit'").groupBy("digest").agg(F.max("size").alias("held")).withColumnRenamed("digest", "stated")
    plain = records.where("type <> 'revisit'").withColumn("held", F.col("size"))
    again = records.where("type = 'revisit'").join(held, "stated", "left")
    columns = ["file", "at", "next", F.col("type").alias("record_type"), "record_id", "target_uri",
               F.col("held").alias("payload_bytes")]
    return plain.select(*columns, F.col("digest").alias("payload_digest"), "refers_to",
                        F.coalesce(F.col("stated") == F.col("digest"), F.lit(True)).alias("intact")).unionByName(
        again.select(*columns, F.col("stated").alias("payload_digest"), "refers_to",
                     F.col("held").isNotNull().alias("intact")))


def digest(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` as archives, read them back, and give ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` of every record."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(plan_records(pages, min_revisit), path)
    kind = pages.schema["page_id"].dataType.simpleString()

    def named(column):
        return F.regexp_extract(column, "^<urn:page:(.*)>$", 1)

    return read(spark, path).select(
        F.when(F.col("record_id").isNotNull(), named("record_id")).cast(kind).alias("page_id"),
        F.col("payload_bytes").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), named("refers_to")).cast(kind).alias("refers_to"))


def digest_sql(min_revisit: int = MIN_REVISIT) -> str:
    digits = " || ".join(
        f"substr('{BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {shift}) & 31) + 1, 1)"
        for i in range(8) for shift in (15, 10, 5, 0))
    return f"""
    WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    named AS (SELECT page_id, payload_bytes, {digits} AS payload_digest,
                     max(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM hashed)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first <> page_id AND payload_bytes >= {min_revisit} THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first <> page_id AND payload_bytes >= {min_revisit} THEN first END AS refers_to FROM named"""
