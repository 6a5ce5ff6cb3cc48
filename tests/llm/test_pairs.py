"""N-gram Jaccard join, components and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillprint.llm import ann, ngram_join
from quillprint.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _set(text, n=5):
    words = re.findall(r"[^\x20\t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def _components(rows, percent=75):
    sets = [_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[top(i)] = top(j)
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(keys, default=None) if sets[i] else key))
    return sorted(out, key=str)


def _family(rng, base, copies, swaps):
    """Copies of one text with some words exchanged."""
    found = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(swaps + 1)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        found.append(" ".join(words))
    return found


def _corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage = fresh(40)
    texts = _family(rng, fresh(90), 60, 4) + _family(rng, fresh(300), 10, 8) + [" ".join(fresh(60))] * 25
    texts += [" ".join(fresh(rng.randrange(3, 60)) + passage + fresh(rng.randrange(3, 12))) for _ in range(40)]
    texts += [" ".join(fresh(rng.randrange(1, 80))) for _ in range(40)]
    texts += [None, "", "  \n", "one", "ONE", "one two three", "One two  three", "a b c d e", "A b c d e", "a b c d e f", " ".join(fresh(6000))]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[4]), (5000, None)]


@pytest.mark.parametrize("small,per_row", [(ngram_join.SMALL, ngram_join.PAIRS_PER_ROW), (2, 0)])
def test_join_equals_brute_force(spark, monkeypatch, small, per_row):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", per_row)
    monkeypatch.setattr(ngram_join, "BLOCK", 1000)
    monkeypatch.setattr(ngram_join, "STARS", 1)
    rows = _corpus(small)
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS).withColumn("component_id", F.lit("clash"))
    got = sorted((tuple(r) for r in ngram_join.join_documents(docs).collect()), key=str)
    assert got == _components(rows)


@pytest.mark.parametrize("stars", [0, 2])
def test_join_at_many_places_equals_brute_force(spark, monkeypatch, stars):
    for name, value in {"SMALL": 3, "PAIRS_PER_ROW": 0, "STARS": stars, "BLOCK": 1000, "PLACE": 300}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(stars)
    fresh = lambda n: [f"v{rng.randrange(10**5)}" for _ in range(n)]
    passage, base = fresh(70), fresh(200)
    texts = [" ".join(fresh(own) + passage) for own in range(1, 30)]  # both sides of the bound, a seventh of the set
    texts += [" ".join(base[:i] + fresh(1 + i % 9) + base[i:]) for i in range(0, 200, 5)] + _family(rng, base, 30, 5)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)
    assert sorted((tuple(r) for r in ngram_join.join_documents(docs).collect()), key=str) == _components(rows)


def test_a_common_passage_late_in_sets_opens_no_bucket(spark, monkeypatch):
    """Own n-grams are a quarter of each set and come first, so the passage's cannot be the first of a link."""
    made = {}

    def settle(df, label):
        table = _settle(df, label)
        made[label] = made.get(label, 0) + table.count()
        return table
    _settle = ngram_join.settle
    monkeypatch.setattr(ngram_join, "settle", settle)
    passage = [f"p{i}" for i in range(80)]
    texts = [" ".join([f"own{d}x{i}" for i in range(24)] + passage) for d in range(60)]
    rows = list(enumerate(texts + [texts[0] + " more"]))
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in ngram_join.join_documents(docs).collect()), key=str)
    assert got == _components(rows)
    assert made.get("join-open", 0) == 0 and made["join-pairs"] <= 2


def test_a_passage_opens_no_bucket_however_documents_are_dealt_out(spark, monkeypatch):
    """A task for each document: none meets the passage twice."""
    made = {}

    def settle(df, label):
        table = _settle(df, label)
        made[label] = made.get(label, 0) + table.count()
        return table
    _settle = ngram_join.settle
    monkeypatch.setattr(ngram_join, "settle", settle)
    passage = [f"p{i}" for i in range(60)]
    rows = list(enumerate(" ".join([f"own{d}x{i}" for i in range(60)] + passage) for d in range(40)))
    rows.append((40, rows[0][1] + " more"))
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(i, t, None, "s", 1) for i, t in rows], 41), DOCS)
    got = sorted((tuple(r) for r in ngram_join.join_documents(docs).collect()), key=str)
    assert got == _components(rows)
    assert made["join-buckets"] == 0


@pytest.mark.parametrize("counted", [1 << 20, 50])
def test_repeated_ngrams_are_counted_over_all_tasks(spark, monkeypatch, counted):
    monkeypatch.setattr(ngram_join, "COUNTED", counted)
    texts = {t for _, t in _corpus(3) if t}
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(13)
    cut, values, counts = ngram_join._repeated(docs, 5)
    sets = [v for _, v in ngram_join._sets(pa.array(sorted(texts)), 5)]
    every, times = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in {v.tobytes() for v in sets}]) >> np.uint64(cut),
                             return_counts=True)
    known, found = dict(zip(every.tolist(), times.tolist())), dict(zip(values.tolist(), counts.tolist()))
    assert {g for g, t in known.items() if t >= ngram_join.HOT} <= set(found)
    # a copy that another task holds (a text in capitals, other white space) counts again
    again, times = np.unique(np.concatenate(sets) >> np.uint64(cut), return_counts=True)
    most = dict(zip(again.tolist(), times.tolist()))
    assert all(known[g] <= t <= most[g] for g, t in found.items())


def test_places_hold_every_pair_once_and_members_of_a_star_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PLACE", 1000)
    name = lambda i: i.to_bytes(16, "big")
    pairs = [(name(0), name(i)) for i in range(1, 200)] + [(name(1000 + i), name(1001 + i)) for i in range(0, 40, 2)]
    sizes = spark.createDataFrame([(x, 50) for x in {x for p in pairs for x in p}], "class binary, size bigint")
    placed = ngram_join._placed(spark.createDataFrame(pairs, "a binary, b binary"), sizes).collect()
    assert sorted((bytes(r["a"]), bytes(r["b"])) for r in placed) == sorted(pairs)
    at = {}
    for r in placed:
        for x in (bytes(r["a"]), bytes(r["b"])):
            at.setdefault(x, set()).add(r["place"])
    assert len(at.pop(name(0))) > 3 and all(len(p) == 1 for p in at.values())


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (2, None), (4, ""), (5, "x y"), (5, "x y"), (6, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect()) == [1, 2, 4, 5, 5, 6]
    assert ngram_join.join_documents(docs.limit(0)).count() == 0


def test_signatures_never_rule_out_a_link():
    rng = np.random.RandomState(5)
    for _ in range(200):
        common = rng.randint(0, 2**62, rng.randint(1, 800)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.randint(0, 2**62, rng.randint(0, 200)).astype(np.uint64)])) for _ in "ab")
        bits = np.unpackbits((ngram_join._signature(a) ^ ngram_join._signature(b)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_chains_and_stars(spark, local):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"),
                                                             local_links=local).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert components(none, local_links=local).count() == 0


def test_components_of_a_shuffled_chain(spark):
    names = np.random.RandomState(3).permutation(2000).tolist()
    links = list(zip(names, names[1:])) + [(5000, 5001)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    for local in (0, 300):
        got = {r["node"]: r["component"] for r in components(frame, local_links=local).collect()}
        assert got == {**{i: 0 for i in range(2000)}, 5000: 5000, 5001: 5000}


# --- nearest neighbours ---

def _brute(rows, queries, top):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:top]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.RandomState(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] * (1 + i % 3) + rng.normal(size=16) * 0.4]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] + [1.0] * 15), (2004, [float("inf")] * 16),
             (None, rows[1][1]), (2020, [1.0, 2.0]), (2021, [2.0, 1.0]), (2040, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int").withColumn("dim", F.lit(1))
    index = ann.build_index(frame, shard_rows=400)
    found = ann.search(index, frame.where("vec_id % 20 = 0"), query_rows=30).collect()
    queries = {i for i, _ in rows if i is not None and i % 20 == 0}
    want = _brute(rows, queries, 20)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in found}
    exact = {(q, i): s for q, _, i, s in want}
    assert len(got) == len(found) == len(want)
    assert len(set(got) & set(exact)) >= 0.95 * len(exact)
    assert all(got[k] == pytest.approx(exact[k], abs=1e-12) for k in set(got) & set(exact))
    assert {(r["rank"], r["vec_id"]) for r in found if r["query_id"] == 2020} == {(1, 2021)}
    copies = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 1000)
    assert copies == sorted((r, i) for q, r, i, _ in want if q == 1000)  # ties go to the smaller key
    assert ann.search(ann.build_index(frame.limit(0)), frame.limit(0)).count() == 0


@pytest.mark.parametrize("factor", [1e4, 1e20])
def test_recall_beside_a_long_vector(spark, factor):
    rng = np.random.RandomState(4)
    x = rng.normal(size=(600, 16))
    x[7] *= factor
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = {(q, i) for q, _, i, _ in _brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in ann.digest(frame).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_recall_on_the_given_vectors(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in frame.collect()]
    want = {(q, i) for q, _, i, _ in _brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)}
    got = {(r["query_id"], r["vec_id"]) for r in ann.digest(frame).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
