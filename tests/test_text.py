import random

from pyspark.sql import functions as F

from quillprint.functions import text as fn
from quillprint.functions import fixed_values as fixed
from quillprint.operators import textstats

ALPHABET = "abAZé9?,;.\x01\x1c\x1f\t\n\r \x85\xa0 　aaaa文"


def _texts(n=400):
    rng = random.Random(1)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return made + ["", " ", "What is art?", "What is art? 　", "aaaa bb", "AAaa bb", "one", "a " * 101, "12 34 !!!! ????"]


def _valid(text):
    if len(text.strip()) < 3 or not 2 <= len(text.split()) <= 100:
        return False
    if any(c * 4 in text.lower() for c in "abcdefghijklmnopqrstuvwxyz"):
        return False
    return sum(c.isalnum() for c in text) / len(text) >= 0.7


def _cleaned(text):
    joined = " ".join(text.split())
    return "".join(c for c in joined if ord(c) >= 32)


def test_python_agrees_on_every_text_function(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    rows = df.select("i", fn.word_count(t).alias("n"), fn.words(t).alias("w"), fn.strip(t).alias("s"),
                     fn.clean_text(t).alias("c"), fn.is_valid_probe(t).alias("v"), fn.has_text(t).alias("h"),
                     fn.is_question(t).alias("q"), fn.complexity(t).alias("x")).collect()
    for r in rows:
        text = texts[r.i]
        assert r.n == len(text.split()) and r.w == text.split()
        assert r.s == text.strip()
        assert r.c == _cleaned(text)
        assert r.v == _valid(text), repr(text)
        assert r.h == bool(text.strip())
        assert r.q == text.strip().endswith("?")
        assert r.x == len(text) + 2 * text.count(",") + 3 * text.count(";")


def test_cleaning_drops_control_characters_last(spark):
    row = spark.createDataFrame([("a \x01 b",)], "t string").select(fn.clean_text(F.col("t")).alias("c")).first()
    assert row.c == "a  b"


def test_keyword_with_capitals_never_matches(spark):
    assert "AI" in fixed.DOMAIN_KEYWORDS["technology"]
    df = spark.createDataFrame([("AI is here",), ("a computer",)], "text string")
    assert textstats.coverage(df, ["domain_coverage"]).first().domain_technology == 0.5


def test_statistics_of_nothing_and_of_blank_texts(spark):
    empty = spark.createDataFrame([], "text string")
    assert textstats.corpus_statistics(empty).count() == 0
    blank = textstats.corpus_statistics(spark.createDataFrame([(" ",), ("",)], "text string")).first()
    assert (blank["count"], blank.total_words, blank.unique_words, blank.type_token_ratio) == (2, 0, 0, 0.0)


def test_unknown_coverage_metric(spark):
    import pytest
    with pytest.raises(ValueError, match="Unknown coverage"):
        textstats.coverage(spark.createDataFrame([("x",)], "text string"), ["nope"])


def test_third_person_and_names(spark):
    verbs = {"go": "goes", "try": "tries", "play": "plays", "fix": "fixes", "run": "runs", "y": "ies"}
    df = spark.createDataFrame([(v,) for v in verbs], "v string")
    assert {r.v: r.o for r in df.select("v", fn.third_person(F.col("v")).alias("o")).collect()} == verbs
    names = spark.createDataFrame([("a/B:c d-e\\f", "..<>__x??..", "squad,cqa")], "a string, b string, c string")
    row = names.select(fn.normalize_model_name(F.col("a")).alias("n"), fn.safe_filename(F.col("b")).alias("s"),
                       fn.dataset_names(F.col("c")).alias("d")).first()
    assert (row.n, row.s, row.d) == ("a_b_c_d_e_f", "x", ["squad", "commonsense_qa"])
