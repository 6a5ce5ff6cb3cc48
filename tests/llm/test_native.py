"""Line dedup, decontamination and mixing: edge cases against plain Python, and the queries against SQL."""

import hashlib
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillprint.llm import decontamination, line_dedup, mixing
from quillprint.llm.queries import QUERIES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def docs_of(spark, rows):
    """``doc_id, text, source`` with the other columns of documents."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_against_sql(spark, small, name):
    run, sql = QUERIES[name]
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = run(spark, small)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df, *names) == sorted((tuple(r) for r in cursor.fetchall()), key=str)


# --- line dedup ---

def test_line_dedup(spark):
    rows = [(i, f"own line {i}\n  shared notice \nsecond {i}\n", f"s{i}") for i in range(6)]
    rows += [(10, "shared notice", "s1"), (11, None, "s2"), (12, "", "s3"), (13, "four only", "s1"), (13, "four only", "s2"),
             (14, "four only", "s3"), (15, "four only\nx", "s4"), (16, "four only", None), (None, "shared notice\nz", "s9"),
             (17, "x" * 200_000 + "\nshared notice", "s1"), (10, "shared notice", "s1")]
    df = docs_of(spark, rows).withColumn("n_lines", F.lit("clash")).withColumn("_id", F.lit(1)).withColumn("line", F.lit(2))
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.remove_boilerplate(df).collect()}
    assert (0, "own line 0\n  shared notice \nsecond 0\n", 4, 0) in got
    assert {(i, f"own line {i}\nsecond {i}\n", 4, 1) for i in range(1, 6)} <= got
    assert {(10, "", 1, 1), (11, None, 0, 0), (12, "", 1, 0), (15, "four only\nx", 2, 0), (16, "four only", 1, 0),
            (None, "z", 2, 1), (17, "x" * 200_000, 2, 1)} <= got
    assert line_dedup.remove_boilerplate(df).count() == len(rows)
    assert line_dedup.remove_boilerplate(docs_of(spark, [])).count() == 0


def test_line_dedup_near_the_threshold(spark):
    rows = [(100 * k + j, f"line on {k} sites", f"site{j}") for k in range(1, 14) for j in range(k)] * 2
    got = {r["line"] for r in line_dedup.boilerplate(docs_of(spark, rows), 6).collect()}
    assert got == {hashlib.md5(f"line on {k} sites".encode()).digest() for k in range(6, 14)}


# --- decontamination ---

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _expected(docs, bench, window=10):
    windows = {}
    for item, text in bench:
        w = _words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(str(item))
    out = []
    for doc, text, _ in docs:
        w, hit, items = _words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                found = windows.get(tuple(w[i:i + k]))
                if found:
                    hit |= set(range(i, i + k))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                    bool(hit)))
    return sorted(out, key=str)


BENCH = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short ÉTÉ item"), (10, "short été item"),
         (3, None), (4, ""), (5, "!!"), (6, "two three four five six seven eight nine ten eleven"), (7, "İstanbul ΟΔΟΣ'α x")]
TEXTS = [(1, "ONE, two three four-five six seven eight nine ten eleven twelve one", "a"), (2, "short ÉTÉ item. Short", "a"),
         (3, "short été item", "b"), (4, None, "b"), (5, "", None), (6, "...", "c"), (7, "clean words only", "c"),
         (8, "x " * 3000 + "one two three four five six seven eight nine ten " + "y " * 3000, "d"), (7, "clean words only", "c"),
         (None, "SHORT ÉTÉ ITEM", "d"), (9, "İstanbul ΟΔΟΣ'α x ΟΔΟς", "d"), (11, "one two three four five six seven eight nine", "d")]


@pytest.mark.parametrize("limit", [decontamination.SET_WINDOWS, 0])
def test_decontamination(spark, limit):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    docs = docs_of(spark, TEXTS)
    assert rows_of(decontamination.digest(docs, bench, set_windows=limit)) == _expected(TEXTS, BENCH)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert rows_of(decontamination.digest(docs, none, set_windows=limit)) == _expected(TEXTS, [])
    assert decontamination.digest(docs_of(spark, []), bench, set_windows=limit).count() == 0


def test_decontaminate_documents_and_spans(spark):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    docs = docs_of(spark, TEXTS).withColumn("found", F.lit(1)).withColumn("items", F.lit("x"))
    kept = decontamination.decontaminate(docs.drop("found"), bench)
    assert kept.columns == docs.drop("found").columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7, 7, 11]
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs.drop("found"), bench, "spans").collect()}
    assert cut[1] == "one" and cut[2] == "Short" and cut[3] == "" and cut[4] is None and cut[7] == "clean words only"
    assert cut[8] == "x " * 3000 + "y " * 3000


# --- mixing ---

def test_mixing_rates_and_copies(spark):
    rows = [(i, f"t{i}", "big") for i in range(3000)] + [(10_000 + i, "u", "small") for i in range(30)]
    rows += [(20_000, None, None), (20_001, "", "single"), (20_001, "", "single")]
    docs = docs_of(spark, rows).withColumn("copy_no", F.lit("clash")).withColumn("_source", F.lit(0)).coalesce(3)
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("absent", 5.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights, size=1.0).cache()
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"big", "small"}
    for n in counts.values():  # both halves, within five standard deviations
        assert abs(n - 3033 / 2) < 5 * math.sqrt(3033 / 2)
    per = {r["doc_id"]: r["count"] for r in mixed.where("source = 'small'").groupBy("doc_id").count().collect()}
    assert len(per) == 30 and len(set(per.values())) > 5  # mean 50: several draws each
    assert mixed.groupBy("doc_id", "copy_no").count().where("count > 1").count() == 0
    again = mixing.mix(docs.repartition(7), weights).select("doc_id", "copy_no", "shuffle_key")
    assert rows_of(again) == rows_of(mixed, "doc_id", "copy_no", "shuffle_key")
    keys = [r["shuffle_key"] for r in mixed.select("shuffle_key").orderBy("shuffle_key").collect()]
    assert abs(sum(keys) / len(keys) / 2**52 - 0.5) < 0.05


def test_mixing_edges(spark, monkeypatch):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = [(i, "t", f"s{i % 40}" if i % 3 else None) for i in range(400)] + [(5, "t", "s5")] * 2 + [(None, None, None)]
    docs = docs_of(spark, rows)
    broadcast = rows_of(mixing.mix(docs), "doc_id", "source", "copy_no", "shuffle_key")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mixing.mix(docs), "doc_id", "source", "copy_no", "shuffle_key") == broadcast
    bad = spark.createDataFrame([("s5", -1.0)], "source string, weight double")
    with pytest.raises(Exception, match="negative"):
        mixing.mix(docs, bad).collect()
