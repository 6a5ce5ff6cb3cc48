import csv
import io
import json
import random

import pytest

from quillprint.sources import datasets, quoted, signature_files

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN_COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def tiny_splits(spark):
    """Splits of 97 bytes, so that most records cross one."""
    before = {k: spark.conf.get(k) for k in (SPLIT, OPEN_COST)}
    spark.conf.set(SPLIT, "97")
    spark.conf.set(OPEN_COST, "0")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def _texts(n, seed):
    made = random.Random(seed)
    pieces = ["a", "word", "\n", "\n\n", '"', '""', ",", ", ", "\\", "\\\\", "\u00e9\u4e2d", " ", "[", "]", "x" * 60, "null"]
    return ["".join(made.choice(pieces) for _ in range(made.randrange(1, 9))) for _ in range(n)]


def _write_csv(path, texts, end):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "prompt"])
    for i, text in enumerate(texts):
        writer.writerow([i, text])
        if i % 7 == 0:
            out.write(end)  # blank lines are no records
    path.write_text(out.getvalue(), newline="")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_split_within_quoted_values(spark, tmp_path, tiny_splits, end):
    one, two = _texts(150, 1), _texts(90, 2)
    _write_csv(tmp_path / "a.csv", one, end)
    _write_csv(tmp_path / "b.csv", two, end)
    assert quoted.read_pieces(spark, str(tmp_path), "\n").select("file", "_start").distinct().count() > 20
    got = datasets.read_prompt_csv(spark, str(tmp_path)).orderBy("probe_idx").collect()
    assert [r.probe_idx for r in got] == list(range(240))
    assert [r.text for r in got] == one + two
    first = datasets.read_prompt_csv(spark, str(tmp_path), n=7).collect()
    assert sorted(r.probe_idx for r in first) == list(range(7))


def test_csv_quote_within_a_bare_value(spark, tmp_path, tiny_splits):
    (tmp_path / "t.csv").write_text('id,prompt\n1,5" pipe\n2,"a ""b""\n"\n3,x"y"\n4,\n5,""\n6,last')
    got = datasets.read_prompt_csv(spark, str(tmp_path / "t.csv")).orderBy("probe_idx").collect()
    assert [r.text for r in got] == ['5" pipe', 'a "b"\n', 'x"y"', "nan", "nan", "last"]


def test_unfinished_and_empty_csv(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('id,prompt\n1,a\n2,"open\n3,b\n')
    with pytest.raises(Exception, match="without its end"):
        datasets.read_prompt_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "head.csv").write_text("id,prompt\n")
    assert datasets.read_prompt_csv(spark, str(tmp_path / "head.csv")).count() == 0


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_split_within_strings(spark, tmp_path, tiny_splits, indent):
    one, two = _texts(150, 3) + ["", '"', "\\"], _texts(60, 4)
    (tmp_path / "a.json").write_text(json.dumps(one, indent=indent))
    (tmp_path / "b.json").write_text(json.dumps(two, indent=indent, ensure_ascii=False))
    (tmp_path / "c.json").write_text("[]")
    got = datasets.read_string_array(spark, str(tmp_path), "rand").orderBy("probe_idx").collect()
    assert [r.probe_idx for r in got] == list(range(len(one) + len(two)))
    assert [r.text for r in got] == one + two


def test_json_array_of_other_values(spark, tmp_path):
    (tmp_path / "a.json").write_text('[1, null, "x", true, 2.5, "y"]')
    got = datasets.read_string_array(spark, str(tmp_path / "a.json"), "rand").orderBy("probe_idx").collect()
    assert [r.text for r in got] == ["1", None, "x", "true", "2.5", "y"]
    for name, content, message in (("o", '["a", "b', "without its end"), ("n", '[["a"], ["b"]]', "array of strings"),
                                   ("d", '[{"a": "b"}]', "array of strings"), ("m", '["a", ["b"]]', "array of strings"), ("e", '["a\\q"]', "array of strings")):
        (tmp_path / f"{name}.json").write_text(content)
        with pytest.raises(Exception, match=message):
            datasets.read_string_array(spark, str(tmp_path / f"{name}.json"), "rand").collect()


def test_datasets_that_fail_while_they_are_read(spark, tmp_path):
    (tmp_path / "good.json").write_text('["a", "b"]')
    (tmp_path / "bad.json").write_text('["a", "b')
    read = lambda name: lambda: datasets.read_string_array(spark, str(tmp_path / name), "x")
    union, skipped = datasets.union_datasets({"good": read("good.json"), "bad": read("bad.json"),
                                              "none": read("none.json")}, settled=True)
    assert sorted(map(tuple, union.collect())) == [("good", 0, "a"), ("good", 1, "b")]
    assert set(skipped) == {"bad", "none"} and "without its end" in skipped["bad"]


def test_folder_report(spark, tmp_path):
    (tmp_path / "a_dna.csv").write_text("dna_value\n1.5\n-2\n")
    (tmp_path / "b_dna.csv").write_text("dna_value\nword\n")
    (tmp_path / "c_dna.csv").write_text("")
    (tmp_path / "d_dna.json").write_text(json.dumps({"signature": [4.0], "metadata": {"model_name": "d/x"}}))
    (tmp_path / "e_dna.json").write_text("broken")
    (tmp_path / "f_dna.json").write_text(json.dumps({"metadata": {"model_name": "f"}}))
    (tmp_path / "g_dna.json").write_text("")
    rows = signature_files.read_folder_report(spark, str(tmp_path)).collect()
    assert {r.model_name: (r.signature, r.reason) for r in rows} == {
        "a": ([1.5, -2.0], None), "b": (None, "no values"), "c": (None, "empty file"), "d/x": ([4.0], None),
        "e": (None, "malformed JSON"), "f": (None, "no signature"), "g": (None, "empty file")}
    assert len(rows) == 7 and all(r.file.startswith("file:") for r in rows)
    assert {r.model_name for r in signature_files.read_folder(spark, str(tmp_path)).collect()} == {"a", "d/x"}
