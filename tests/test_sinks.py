"""Sinks, columns found by name, and the outside service."""

import pytest
from pyspark.sql import functions as F

from annexa.functions import service
from annexa.operators import columns
from annexa.sources import sinks


def table(spark, path):
    return [tuple(r) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).collect()]


def test_append(spark, tmp_path):
    path = f"{tmp_path}/out"
    for part in ([(1, 'a "b", c\nd')], [(2, "e")]):
        sinks.append_rows(spark.createDataFrame(part, "k int, t string"), path)
    assert sorted(table(spark, path)) == [("1", 'a "b", c\nd'), ("2", "e")]


def test_update_replaces_in_order(spark, tmp_path):
    path = f"{tmp_path}/out"
    order = spark.createDataFrame([(0, "c"), (1, "a"), (2, "b"), (3, "a")], "place int, value string")
    sinks.update_table(spark, spark.createDataFrame([("a", 1), ("b", 2)], "k string, q1 int"), path, "k", order)
    assert table(spark, path) == [("a", "1"), ("b", "2")]
    new = spark.createDataFrame([("a", "x", 9), ("c", "y", 3), ("z", "n", 4)], "k string, extra string, q1 int")
    sinks.update_table(spark, new, path, "k", order, ["q1", "missing"])
    assert spark.read.option("header", True).csv(path).columns == ["k", "q1", "extra"]
    assert table(spark, path) == [("c", "3", "y"), ("a", "1", None), ("b", "2", None)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_replace_repairs_an_interrupted_swap(spark, tmp_path):
    path = f"{tmp_path}/out"
    sinks.replace_table(spark.createDataFrame([("old",)], "v string"), path)
    (tmp_path / "out").rename(tmp_path / "out._old")
    sinks.replace_table(spark.createDataFrame([("new",)], "v string"), path)
    assert table(spark, path) == [("new",)] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_wide_metrics(spark):
    facts = spark.createDataFrame([("m", "x", "f1", 0.5), ("m", "x", "recall", float("nan")), ("n", "y", "f1", 2.0), ("n", "w", "f1", 1.0)], "model string, feature string, metric string, value double")
    got = sinks.wide_metrics(facts, "model", "feature", "metric", "value", ["x", "y"], ["recall", "f1"])
    assert got.columns == ["model", "x_recall", "x_f1", "y_recall", "y_f1"]
    assert sorted(map(tuple, got.collect())) == [("m", "", "0.50", "", ""), ("n", "", "", "", "2.00")]


def test_columns_by_name(spark):
    names = ["file", "a", "justification_for_a", "answer_for_b", "justification_for_b", "justification_for_c", "start_time"]
    assert columns.columns_like(names, without=("justification", "time")) == ["file", "a", "answer_for_b"]
    assert columns.columns_like(names, pattern="_b$") == ["answer_for_b", "justification_for_b"]
    assert columns.column_pairs(names) == [("a", "a", "justification_for_a"), ("b", "answer_for_b", "justification_for_b")]
    df = spark.createDataFrame([("f", "yes", "since", None, "n")], "file string, a string, justification_for_a string, b_answer string, justification_for_b string")
    assert [tuple(r) for r in columns.unpivot_pairs(df, ["file"]).collect()] == [("f", "a", "yes", "since"), ("f", "b", None, "n")]
    with pytest.raises(ValueError):
        columns.unpivot_pairs(df.select("file"), ["file"])


def test_service(spark):
    def flaky(prompt):
        flaky.tries = getattr(flaky, "tries", 0) + 1
        if "bad" in prompt or flaky.tries % 2:
            raise RuntimeError
        return f' "{prompt.upper()}  {prompt}" '

    rows = spark.createDataFrame([("a", 2, "two"), ("a", 1, " one "), ("b", 1, "only"), ("c", 1, "bad"), ("c", 2, "luck"), ("d", 1, None), ("d", 2, "  ")], "k string, o int, t string").coalesce(1)
    ask = lambda parts: F.array_join(parts, "+")
    got = service.merge_texts(rows, "k", "o", "t", ask, flaky, at_once=1)
    assert {r["k"]: r["t"] for r in got.collect()} == {"a": "ONE+TWO one+two", "b": "only", "c": "bad || luck", "d": ""}
    plain = service.merge_texts(rows, "k", "o", "t", ask)
    assert {r["k"]: r["t"] for r in plain.collect()} == {"a": "one || two", "b": "only", "c": "bad || luck", "d": ""}
