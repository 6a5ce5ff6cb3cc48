import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from quillprint.llm import warc
from quillprint.session import scratch_path

SCHEMA = "page_id bigint, url string, html string"


def _sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def _expected(rows, least=0):
    found = []
    for page, _, html in rows:
        text = html or ""
        same = [p for p, _, h in rows if (h or "") == text and p is not None]
        first = max(same, default=None)
        again = page != first and len(text.encode()) >= least
        found.append((page, len(text.encode()), _sha(text), "revisit" if again else "response", first if again else None))
    return sorted(found, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


NASTY = "x WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def _rows():
    rows = [(i, f"http://a.example/{i}", f"<p>page {i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, "http://b.example/\r\nWARC-Type: x", NASTY), (101, None, NASTY), (102, "", None), (103, "u", ""),
             (104, "u", "é" * 3000 + "WARC/1.0\r\n"), (105, "u", "WARC/1.0\r\n" * 40), (106, "u", "\r\n\r\n"),
             (107, "u", "z" * 300_000)]
    return rows


@pytest.mark.parametrize("split", ["128m", "97b"])
def test_round_trip(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = _rows() if split == "128m" else [(i, "u", "p" * i) for i in range(4)] + [(9, "u", NASTY), (10, "u", NASTY)]
        pages = spark.createDataFrame(rows, SCHEMA).coalesce(1 if split == "97b" else 2)
        least = 0 if split == "97b" else 20
        assert _got(warc.digest(pages, least)) == _expected(rows, least)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_payloads_and_broken_files(spark):
    rows = _rows()
    path = scratch_path(spark, "warc-test")
    warc.write(warc.plan_records(spark.createDataFrame(rows, SCHEMA).coalesce(1)), path)
    records = warc.read(spark, path)
    assert records.where("NOT intact").count() == 0
    held = records.where("record_type = 'response'").join(warc.payloads(spark, path, records), ["file", "at"])
    texts = {r["record_id"]: bytes(r["payload"]).decode() for r in held.collect()}
    wanted = {f"<urn:page:{p}>": h or "" for p, _, h in rows}
    assert texts and all(wanted[k] == v for k, v in texts.items())
    broken = scratch_path(spark, "warc-broken")
    spark.createDataFrame([("junk before any record",)], "value string").coalesce(1).write.text(broken)
    assert warc.read(spark, broken).count() == 0


def test_empty_repeated_and_clashing(spark):
    assert _got(warc.digest(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("payload", F.lit(1)).withColumn("digest", F.lit("x"))
    assert _got(warc.digest(frame)) == sorted(
        [(1, 1, _sha("a"), "response", None)] * 2 + [(None, 1, _sha("a"), "revisit", 1),
                                                    (None, 0, _sha(""), "response", None)], key=str)
