"""Operators that refuse, and sinks: what their queries do not show."""

import json

import pytest
from pyspark.sql import functions as F

from annexa.functions import arrays, jsonx, text
from annexa.operators import annotation, filters, joins, records, rewards, rollup, scoring, splits
from annexa.sources import sinks


def fails(df, part):
    with pytest.raises(Exception, match=part):
        df.collect()


def test_refusals(spark):
    d = spark.createDataFrame([(1, "ES"), (2, " NES "), (3, "Sample"), (None, None)], "k int, l string")
    assert sorted(r["l"] for r in filters.labelled(d.where("k < 3"), "l", ["ES", "NES"]).collect()) == ["ES", "NES"]
    fails(filters.labelled(d, "l", ["ES", "NES"], ["Sample"]), "unknown label: null")
    few = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    assert filters.only_listed(d, few, "k", expected=2).count() == 2
    fails(filters.only_listed(d, few, "k", expected=3), "3 rows are expected, not 2")
    fails(joins.lookup(d.where("k IS NOT NULL"), spark.createDataFrame([(1, "x")], "k int, v string"), "k", "v"), "no entry for")
    fails(joins.checked(d, few.withColumn("v", F.lit(1)), ["k"]), "a key is repeated")
    assert sorted(map(tuple, joins.checked(d.where("k < 3"), spark.createDataFrame([(1, None, 5)], "k int, a string, b int"), ["k"]).collect())) == [(1, "ES", None, 5), (2, " NES ", None, None)]
    folds = spark.createDataFrame([("a", 0, True), ("a", 0, False), ("b", 1, True)], "g string, fold int, y boolean")
    assert splits.checked_folds(folds, "g", 2).count() == 3
    fails(splits.checked_folds(folds.union(spark.createDataFrame([("a", 1, True)], folds.schema)), "g", 2), "two")
    fails(splits.checked_folds(folds.union(spark.createDataFrame([("c", None, True)], folds.schema)), "g", 2), "no fold")
    with pytest.raises(ValueError, match="columns are missing: z"):
        filters.required(d, ["k", "z"])
    with pytest.raises(ValueError, match="after the last"):
        filters.row_range(d, ["k"], 3, 2)


def test_small_filters(spark):
    d = spark.createDataFrame([("a/X.MP4", 1), (None, 2), (".hid", 3)], "first string, n int")
    assert filters.keyed(d).columns == ["file_name", "n"] and filters.keyed(d).count() == 2
    assert [r["s"] for r in d.select(joins.stem("first").alias("s")).collect()] == ["x", "", ".hid"]
    assert [r["n"] for r in filters.first_rows(d, [F.desc("n")], 2).collect()] == [3, 2]
    assert [r["n"] for r in filters.row_range(d, ["n"], -5, 2301).orderBy("n").collect()] == [1, 2, 3]
    assert filters.row_range(d.limit(0), ["n"], 1, 2).count() == 0 and filters.worker_chunks(d.limit(0), ["n"]).count() == 0
    assert filters.naming_any(d, "first", d.select(F.lit("X.").alias("p")), "p").count() == 1
    assert joins.shared_questions(d, d, {"f": ["n", "z"], "g": ["y"]}) == {"f": ["n"]}
    kinds = spark.createDataFrame([(None, None), ("v", ["a", " ", None])], "one string, many array<string>")
    assert [r["x"] for r in kinds.select(records.media_list("one", "string").alias("x")).collect()] == [[], ["v"]]
    assert [r["x"] for r in kinds.select(records.media_list("many", "array<string>").alias("x")).collect()] == [[], ["a"]]


def test_annotation_ties_and_no_columns(spark):
    rows = [("Yes", "00:10", " yes", "00:10", "yes"), ("yes", None, "no", "x", "yes"), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "a string, start_time_for_a string, b string, start_time_for_b string, c string").withColumn("k", F.monotonically_increasing_id())
    got = annotation.event_sequence(d, ["k"], ["b", "a", "c"]).orderBy("k").collect()
    assert [r["sequence"] for r in got] == [["b", "a"], ["a", "c"], []]
    assert [(r["missing"], r["invalid"], r["by_column"]) for r in got] == [([], [], False), (["a"], [], True), ([], [], False)]
    assert [r["x"] for r in d.select(annotation.longest(["start_time_for_a", "start_time_for_b"]).alias("x")).collect()] == [10, None, None]


def test_answers_and_weights(spark):
    d = spark.createDataFrame([("a，b", "b,a"), ("a；c", "c;a"), ("a|b", "a : b"), ("a", "b")], "x string, y string")
    assert [r["e"] for r in d.select(text.same_answer("x", "y").alias("e")).collect()] == [True, True, True, False]
    long = spark.createDataFrame([(k, q, "yes", "yes" if q <= k else "no") for k in (5, 6, 7) for q in range(2, 8)], "k int, q int, t string, p string")
    got = {r["k"]: r["score"] for r in scoring.gated(long, ["k"], "q", "t", "p").collect()}
    assert got == {5: pytest.approx(4 / 6), 6: pytest.approx(5 / 6), 7: pytest.approx(1.0)}


def test_replies_read_by_scanner():
    cases = {
        '{"answer": "yes", "n": {"a": [1, {"b": 2}]}, "justification": "x"}': {"answer": "yes", "n": '{"a": [1, {"b": 2}]}', "justification": "x"},
        "{answer: no, 'justification': 'it\\'s he''re',}": {"answer": "no", "justification": "it's he re"},
        '{"answer": "a, b: c", "justification": "line\\nbreak \\u00e9"': {"answer": "a, b: c", "justification": "line\nbreak é"},
        "nothing": {}, "": {}, "{": {}, '{"answer"': {}, '{"answer": ': {}, "}{": {},
    }
    assert {t: jsonx.members(t) for t in cases} == cases
    assert len(jsonx.members('{"a": "' + "x" * 1_000_000 + '"}')["a"]) == 1_000_000


def test_calls_without_parameters(spark):
    c = lambda *x: "<tool_call>\n" + "\n".join(x) + "\n</tool_call>"
    f, g = '{"name": "f", "parameters": {}}', '{"name": "g", "parameters": {"a": "1"}}'
    rows = [(c(f, g), c(g, f)), (c('{"name": "g", "parameters": {"a": 1}}'), c(g)), (c("{"), c(f)), (None, c(f)), ("x", None)]
    got = [r["x"] for r in spark.createDataFrame(rows, "r string, s string").select(rewards.tool_calls("r", "s").alias("x")).collect()]
    assert got == [pytest.approx(3.0), pytest.approx(6 * 2 / 3 - 3), -3.0, -3.0, 0.0]


def test_edit_distance_of_many_tokens(spark):
    a, b = [f"t{i}" for i in range(3000)], [f"t{i}" for i in range(3000) if i % 3]
    d = spark.createDataFrame([(a, b), ([], a), ([], [])], "a array<string>, b array<string>")
    assert [r["x"] for r in d.select(arrays.edit_distance("a", "b").alias("x")).collect()] == [1000, 3000, 0]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    sinks.write_unquoted(d, f"{tmp_path}/bare")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/bare").collect()] == ["k,v", "1,x", "2,"]
    with pytest.raises(Exception, match="needs quotes"):
        sinks.write_unquoted(d.withColumn("v", F.lit("a,b")), f"{tmp_path}/bad")
    sinks.write_report({"summary": d, "diff": d.limit(1)}, f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report/diff").count() == 1
    sinks.write_json_lines(d, f"{tmp_path}/json", {"task": "t"})
    assert json.loads(spark.read.text(f"{tmp_path}/json/summary").first()[0]) == {"rows": 2, "task": "t"}
    sinks.copy_subset({"a": d, "b": d}, d.where("k = 1"), "k", f"{tmp_path}/some")
    assert spark.read.parquet(f"{tmp_path}/some/b").count() == 1
    done, lost = rollup.outcome(d.withColumn("e", F.when(F.col("k") == 2, "why")), "v", "e")
    assert sorted(map(tuple, done.collect())) == [(1, "x"), (2, "fail")] and lost.count() == 1
