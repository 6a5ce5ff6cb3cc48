"""The pipeline against the same steps in plain Python, and its behaviour on odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillprint.llm import language_id, mixing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = {"aa": "the and of to in that was with hat cat", "bb": "und der die das nicht ist ein mit auf zu"}


def _text(lang, seed, n=40):
    rng = random.Random(f"{lang}-{seed}")
    return " ".join(f"{rng.choice(VOCAB[lang].split())}{rng.choice('xyz')}{rng.randrange(60)}" for _ in range(n))


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(i, _text("ab"[i % 2] * 2, i), "ab"[i % 2] * 2, f"s{i % 6}") for i in range(60)]
    rows = [(i, t + "\nshared legal notice", k, s) if i % 5 == 0 else (i, t, k, s) for i, t, k, s in rows]
    rows += [(100, _text("aa", 1) + " more", "aa", "s1"), (101, _text("aa", 2), "aa", "s2"), (102, "12 34", "aa", "s1"),
             (103, None, None, None), (104, "", "aa", "s3"), (105, _text("bb", 7) + " " + _text("aa", "bench", 12), None, "s1"),
             (106, "shared legal notice", "aa", "s5")]
    bench = [(1, _text("aa", "bench", 12)), (2, None)]
    frame = spark.createDataFrame([(i, t, k, s, None if t is None else len(t)) for i, t, k, s in rows], DOCS)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, bench


def _words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def _plain(rows, bench):
    """Language, lines, near copies, benchmark: documents as ``id: text, source``."""
    docs = {i: (t, s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)}
    sites, first = {}, {}
    for i, (t, s) in sorted(docs.items()):
        for line in t.split("\n"):
            if line.strip():
                sites.setdefault(line.strip(), set()).add(s)
                first.setdefault(line.strip(), i)
    for i, (t, s) in list(docs.items()):
        kept = [x for x in t.split("\n") if len(sites.get(x.strip(), ())) < 5 or first[x.strip()] == i]
        if kept != t.split("\n"):
            docs[i] = ("\n".join(kept), s)
            if not docs[i][0].strip():
                del docs[i]
    grams = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, (t, _) in docs.items())}
    label = {i: i for i in docs}
    for _ in docs:
        for i in docs:
            for j in docs:
                both = len(grams[i] & grams[j])
                if i != j and both * 100 >= 75 * (len(grams[i]) + len(grams[j]) - both):
                    label[i] = min(label[i], label[j])
        if all(label[label[i]] == label[i] for i in docs):
            break
    docs = {i: x for i, x in docs.items() if label[i] == i}
    windows = {tuple(w[j:j + 10]) for w in (_words(t) for _, t in bench) for j in range(max(1, len(w) - 9)) if w}
    return {i: x for i, x in docs.items() if not windows & {tuple(_words(x[0])[j:j + 10]) for j in range(len(_words(x[0])))}}


def test_pipeline_equals_plain_steps(spark, tables):
    sf_dir, rows, bench = tables
    want = _plain(rows, bench)
    docs = spark.createDataFrame([(i, t, None, s, len(t)) for i, (t, s) in want.items()], DOCS)
    expected = sorted((r["doc_id"], r["text"], r["copy_no"], r["shuffle_key"]) for r in mixing.mix(docs).collect())
    made = corpus_pipeline.run(spark, sf_dir)
    assert made.columns == [*DOCS.replace(" bigint", "").replace(" string", "").split(", "), "copy_no", "shuffle_key"]
    assert sorted((r["doc_id"], r["text"], r["copy_no"], r["shuffle_key"]) for r in made.collect()) == expected
    assert {101, 102, 103, 104, 105, 106} & set(want) == set() and len(want) >= 55
    assert made.where("n_chars <> length(text)").count() == 0


def test_stages_on_odd_tables(spark, tables):
    sf_dir = tables[0]
    empty = spark.createDataFrame([], DOCS)
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "x y", None, None, 3)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        columns = stage(spark, odd, sf_dir).columns
        assert columns[:5] == odd.columns and (len(columns) == 5 or name == "mixing")
    assert corpus_pipeline.dedup_lines(spark, odd, sf_dir).count() == 3
    assert corpus_pipeline.keep_one_of_near_copies(spark, odd, sf_dir).count() == 3
    assert corpus_pipeline.remove_benchmark(spark, odd, sf_dir).count() == 3
    assert [r["text"] for r in corpus_pipeline.identify_language(spark, odd, sf_dir).collect()] == ["x y"]


def test_strange_texts_go(spark):
    learned = [(i, _text("aa", i, 80), "aa", "s", 1) for i in range(20)]
    docs = spark.createDataFrame([*learned, (50, "жщ" * 150, None, "s", 300), (51, "жщ", None, "s", 2)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert 50 not in kept and 51 in kept and set(range(20)) <= kept
    assert language_id.UNKNOWN not in {r["lang_pred"] for r in language_id.identify(docs, language_id.sample_texts(docs)).collect()}
    assert docs.where(F.col("doc_id") == 50).count() == 1
