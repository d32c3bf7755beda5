"""Kernels on the cases that matter: ties, blanks, malformed text, borders."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annexa.functions import arrays, clock, jsonx, numeric, text, textscore
from annexa.operators import joins, metrics, records, rewards, rollup, scoring, splits, templates
from annexa.sources import readers
from annexa.streaming.ingest import ingest_once


def values(spark, rows, f, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", f("c").alias("x")).orderBy("i").collect()]


def test_text(spark):
    assert values(spark, ["NES", "ES.", "YES", "seizures", "Sample", None], text.event_class) == ["NES", "ES", "ES", "ES", None, None]
    assert values(spark, ["YES", "an ES", None], lambda c: text.event_class(c, True)) == [None, "ES", None]
    assert values(spark, ["it turned Right, then left", "R", "none", " l "], text.direction) == ["left", "right", "fail", "left"]
    assert values(spark, ["a_segment_3.mp4", "a_segment_12", "b_7.mp4", "c"], text.segment_index) == [3, 12, 7, 1_000_000_000]
    assert values(spark, ["P1@2@x_segment_3.mp4"], text.parent_name) == ["P1@2@x.mp4"]
    assert values(spark, ["NA", "na", "", "x"], text.missing_to_null) == [None, "na", None, "x"]
    assert values(spark, ["fail", "Error ", None, "fine", " "], text.is_failure) == [True, True, True, False, True]
    assert values(spark, ["score 1.7", "0.25!", "no"], text.first_number) == [1.0, 0.25, None]
    pairs = spark.createDataFrame([("left, Right", "right;left"), ("a|b", "a : b"), (None, None), ("a", None)], "a string, b string")
    assert [r["x"] for r in pairs.select(text.same_answer("a", "b").alias("x")).collect()] == [True, True, True, False]


def test_clock(spark):
    t = ["5", "05:30", "05:30:00", "61:10", "00:75", "N/A", None]
    assert values(spark, t, clock.mmss) == [None, 330, 330, None, None, None, None]
    assert values(spark, t, lambda c: clock.mmss(c, False)) == [None, 330, 330, 3670, None, None, None]
    assert values(spark, ["5", "05:30", "1:02:03", "x"], clock.seconds) == [5, 330, 3723, None]
    assert values(spark, ["[01:05]", "at 1:05.7", "02:75", "N/A", None], clock.found) == ["01:05", "01:05", "03:15", "N/A", "N/A"]
    assert values(spark, [0, 59, 60, 6001], clock.to_mmss, "int") == ["00:00", "00:59", "01:00", "100:01"]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, up = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (x != y)))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        up, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(up[j - 1] + 1 if x == y else max(up[j], row[j - 1]))
    return row[-1]


def test_sequences(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(7))], [rng.choice("abc") for _ in range(rng.randrange(7))]) for _ in range(80)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    for r in df.select("a", "b", arrays.edit_distance("a", "b").alias("d"), arrays.common_length("a", "b").alias("l"), arrays.overlap_merge("array(a, b)").alias("m")).collect():
        k = max(k for k in range(min(len(r["a"]), len(r["b"])) + 1) if r["a"][len(r["a"]) - k :] == r["b"][:k])
        assert (r["d"], r["l"], r["m"]) == (lev(r["a"], r["b"]), lcs(r["a"], r["b"]), r["a"] + r["b"][k:])
    assert values(spark, ["['a', \"b\"]", "[a, b]", "a，b", "a b", "", "[]"], arrays.event_sequence) == [["a", "b"], ["a", "b"], ["a", "b"], ["a", "b"], [], []]
    assert values(spark, ["'a b', c.; ,D"], arrays.tokens) == [["a_b", "c", "D"]]
    ends = {d: w and [(x["s"], x["e"]) for x in w] for d, w in zip([0, 1, 30, 31, 55, 56], values(spark, [0, 1, 30, 31, 55, 56], lambda c: arrays.windows(c, 30, 25), "int"), strict=True)}
    assert ends == {0: None, 1: [(0, 1)], 30: [(0, 30)], 31: [(0, 30), (25, 31)], 55: [(0, 30), (25, 55)], 56: [(0, 30), (25, 55), (50, 56)]}


def test_json(spark):
    assert values(spark, ['```json\n{"timestamp": "01:02",}\n```', "so {'a': 1}", "none", None], lambda c: jsonx.field(c, "timestamp")) == ["01:02", "N/A", "N/A", "N/A"]
    assert values(spark, ["x {a: 'q'} y"], lambda c: jsonx.lenient(c, "a string")["a"]) == ["q"]


def test_metrics(spark):
    rows = [("f", "yes", "yes"), ("f", "no", "yes"), ("f", "yes", None), ("f", "maybe", "yes"), ("g", "x", "y")]
    got = {r["k"]: r for r in metrics.binary(spark.createDataFrame(rows, "k string, t string, p string"), ["k"], "t", "p", "yes", ["yes", "no"]).collect()}
    assert (got["f"]["n"], got["f"]["accuracy"], got["f"]["precision"], got["f"]["recall"]) == (2, 0.5, 0.5, 1.0) and got["g"]["n"] == 0 and got["g"]["f1"] is None
    m = metrics.macro(spark.createDataFrame([("left", "left"), ("right", "fail")], "t string, p string"), [], "t", "p").first()
    assert m["labels"] == 3 and m["macro_f1"] == pytest.approx(1 / 3)
    v = spark.createDataFrame([("a",), ("b",)], "k string")
    e = spark.createDataFrame([("a", 1, 4), ("a", 2, 1)], "k string, t int, p int")
    assert {r["k"]: r["mae"] for r in metrics.mean_absolute_error(e, v, "k", "t", "p").collect()} == {"a": 2.0, "b": None}
    assert {r["k"]: r["mae"] for r in metrics.mean_absolute_error(e, v, "k", "t", "p", True).collect()} == {"a": 2.0, "b": 0.0}


def test_rollup(spark):
    rows = [("v", 2, "yes", "b"), ("v", 10, "no", "z"), ("v", 1, "yes", "a"), ("v", 3, "yes", "b"), ("w", 1, "no", "n"), ("w", 2, "no", " ")]
    got = {r["k"]: (r["label"], r["state"], r["text"]) for r in rollup.segments(spark.createDataFrame(rows, "k string, i int, l string, t string"), ["k"], "i", "l", "t").collect()}
    assert got == {"v": ("yes", "mixed", "a || b"), "w": ("no", "all_no", "n")}
    c = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "p", "y"), (2, 1, None, None)], "k int, o int, a string, b string")
    assert sorted(map(tuple, rollup.coalesce_first(c, ["k"], "o", ["a", "b"]).collect())) == [(1, "p", "x"), (2, None, None)]


def test_joins(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(PySparkException):
        joins.checked(a, b, ["k"]).collect()
    assert joins.checked(b, a, ["k"]).count() == 2
    p = spark.createDataFrame([(1, 0, 5), (1, 30, 30), (1, 100, 400)], "k int, s int, e int")
    w = spark.createDataFrame([(1, 5, 30), (1, 31, 60), (1, 390, 410)], "k int, a int, b int")
    assert sorted((r["s"], r["a"]) for r in joins.overlapping(p, w, ["k"], "s", "e", "a", "b", 30).collect()) == [(0, 5), (30, 5), (100, 390)]


def test_scores(spark):
    rows = [(1, 0, "yes", "no"), (1, 1, "a", "a"), (2, 0, "yes", "yes"), (2, 1, "left, right", "right,left"), (2, 2, "x", "y"), (2, 3, None, None)]
    got = {r["k"]: r["score"] for r in scoring.gated(spark.createDataFrame(rows, "k int, q int, t string, p string"), ["k"], "q", "t", "p").collect()}
    assert got == {1: 0.0, 2: pytest.approx(0.85)}
    r = spark.sql("select array('s') ts, array('s') ps, array('a','b') te, array('a','c') pe, array('r=1') tl, array('r=2') pl, 99 x")
    score = scoring.report_quality(*(F.col(c) for c in ("ts", "ps", "te", "pe", "tl", "pl", "x")), F.lit(False), F.lit(False))
    assert r.select(score.alias("s")).first()["s"] == pytest.approx((100 + 50 + 50 + 0) / 4 - 1 - 1)


def test_folds(spark):
    rows = [(i, f"g{i % 23}", int(i % 23 < 6)) for i in range(400)]
    got = splits.group_folds(spark.createDataFrame(rows, "i int, g string, y int"), "g", "y").collect()
    assert len(got) == 400 and len({(r["g"], r["fold"]) for r in got}) == 23 and {r["fold"] for r in got} == set(range(5))
    with pytest.raises(PySparkException):
        splits.group_folds(spark.createDataFrame(rows[:2], "i int, g string, y int"), "g", "y").collect()


def test_records(spark):
    rows = [(1, 1, "assistant", "A"), (1, 0, "user", "Q <video>"), (1, 2, "user", None)]
    c = records.chats(spark.createDataFrame(rows, "k int, turn int, role string, text string"), ["k"], "turn")
    r = c.select(records.solution("messages").alias("s"), records.with_media_tokens("messages", F.lit(3)).alias("m")).first()
    assert r["s"] == "A" and r["m"][0]["content"] == "<video><video>Q <video>"


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('file_name,report\nv1,"says ""x"", twice"\nv2,one, two,three\n')
    assert sorted(map(tuple, readers.ragged_csv(spark, f"{tmp_path}/in/a.csv").collect())) == [("v1", "says x, twice"), ("v2", "one two three")]
    (tmp_path / "M_0-10.csv").write_text("file_name,x\na,1\n")
    (tmp_path / "M_10-20.csv").write_text("file_name,x\nb,\n")
    got = readers.sharded_csv(spark, f"{tmp_path}/M_*.csv", "file_name string, x int").orderBy("shard_from").collect()
    assert [(r["file_name"], r["x"], r["shard_to"]) for r in got] == [("a", 1, 10), ("b", None, 20)]
    (tmp_path / "s").mkdir()
    for n, rows in enumerate(('{"k":"a"}\n{"k":"b"}\n', '{"k":"b"}\n{"k":"c"}\n')):
        (tmp_path / f"s/{n}.json").write_text(rows)
        ingest_once(spark, f"{tmp_path}/s", "k string", f"{tmp_path}/out", f"{tmp_path}/cp", "k").awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


def test_stems():
    pairs = "caresses caress ponies poni ties tie cats cat feed feed agreed agre plastered plaster motoring motor conflated conflat sized size hopping hop falling fall filing file happy happi relational relat conditional condit vietnamization vietnam hopefulness hope electrical electr adoption adopt controll control dying die died die sky sky enjoy enjoy"
    w = pairs.split()
    assert [textscore.stem(x) for x in w[::2]] == w[1::2]


def test_rouge_and_bleu(spark):
    r = one(spark, textscore.rouge(L("The cats sat; the mat"), L("the cat sat on a mat")))
    assert r["rouge1"] == pytest.approx(2 * 4 / 11) and r["rouge_l"] == pytest.approx(2 * 4 / 11)
    assert tuple(one(spark, textscore.rouge(L(None).cast("string"), L("x")))) == (0.0, 0.0)
    assert one(spark, textscore.tokens_13a(L("He's 3,5 &amp; 5-6, (ok).\nEnd!"))) == ["He's", "3,5", "&", "5", "-", "6", ",", "(", "ok", ")", ".", "End", "!"]
    same = "the quick brown fox jumps"
    assert one(spark, textscore.sentence_bleu(L(same), L(same))) == pytest.approx(100)
    assert one(spark, textscore.sentence_bleu(L("the cat"), L("the cat sat down"))) == pytest.approx(100 * math.exp(-1))
    assert one(spark, textscore.sentence_bleu(L("a b c d e"), L("a x c y e"))) == pytest.approx(100 * (3 / 5 * 1 / 8 * 1 / 12 * 1 / 16) ** 0.25)
    assert one(spark, textscore.sentence_bleu(L("a"), L("b"))) == 0 and one(spark, textscore.sentence_bleu(L(""), L("b"))) == 0
    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (1, "e f g", "e f h"), (2, "a", "a")], "k int, p string, r string")
    got = {r["k"]: r["b"] for r in df.withColumn("c", textscore.bleu_counts("p", "r")).groupBy("k").agg(textscore.corpus_bleu("c").alias("b")).collect()}
    assert got[1] == pytest.approx(100 * (6 / 7 * 4 / 5 * 2 / 3 * 1) ** 0.25) and got[2] == 0


def test_edit_paths(spark):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        path = textscore.edit_path(a, b)
        assert sum(op != "equal" for op, _, _ in path) == lev(a, b) and textscore.lcs_length(a, b) == lcs(a, b)
        made = [a[i] if op == "equal" else b[j] for op, i, j in path if op != "delete"]
        assert made == b and [i for op, i, _ in path if op != "insert"] == list(range(len(a)))
    f1 = lambda a, b, compat=False: one(spark, textscore.aligned_f1(F.array(*map(L, a)).cast("array<string>"), F.array(*map(L, b)).cast("array<string>"), compat))
    assert (f1([], []), f1(["a"], []), f1(["a", "b"], ["a", "c"])) == (1.0, 0.0, 0.5)
    assert f1(["a", "b", "c"], ["a"]) == pytest.approx(1 / 3) and f1(["a", "b", "c"], ["a"], True) == 1.0


def test_greedy_cosine(spark):
    p, r = F.expr("array(array(1D, 0D), array(0D, 2D))"), F.expr("array(array(1D, 1D))")
    x = one(spark, textscore.greedy_cosine(p, r))
    assert x["precision"] == pytest.approx(0.5**0.5) and x["recall"] == pytest.approx(0.5**0.5)
    assert one(spark, textscore.greedy_cosine(p, F.expr("cast(array() as array<array<double>>)")))["f1"] == 0


def test_normalisers(spark):
    assert values(spark, ["bright", "Left arm", "the left leg, then EYES", None], text.region) == ["fail", "left arm", "eyes", "fail"]
    assert values(spark, ["bright light"], text.direction) == ["fail"]
    assert values(spark, ["yn: Yes ", "maybe", None, "L"], text.answer_yes_no) == ["yes", "no", "no", "no"]
    assert values(spark, ["yes", "maybe"], lambda c: text.answer_yes_no(c, True)) == ["yes", None]
    assert values(spark, ["L", "right", "both"], text.answer_side) == ["left", "right", "neither"]
    assert values(spark, ["B; a\nx，b", "", None], lambda c: text.answer_choices(c, ["a", "b"])) == ["a, b", "unknown", "unknown"]
    assert values(spark, ["A", "c"], lambda c: text.answer_choice(c, ["a"])) == ["a", "unknown"]
    assert values(spark, ["yes, it", "No way", "", None, "yes it"], text.first_word_flag) == ["NA", "0", "NA", "NA", "1"]
    assert values(spark, ["Misaligned!", "aligned", "?"], text.verdict) == ["misaligned", "aligned", "unclear"]
    assert values(spark, ["Head turn and tonic"], lambda c: text.keywords(c, ["tonic", "clonic", "head_turn"])) == [["tonic", "head_turn"]]
    assert values(spark, ["a ||  || nan|| b", None], text.joined_parts) == [["a", "b"], []]
    assert values(spark, ["x/Qwen2.5-VL-7B-Instruct_all.csv", "m/Foo/t.csv"], lambda c: text.model_name(c, ["Qwen", "InternVL"])) == ["Qwen2.5-VL-7B", "Foo"]
    assert values(spark, ["a:b/c"], text.sheet_name) == ["a_b_c"] and values(spark, ["Q-w_2.5"], text.model_key) == ["qw25"]
    assert values(spark, ["tonic", None], lambda c: text.filled('When does {f} start? {{"t": 1}}', f=c)) == ['When does tonic start? {"t": 1}', 'When does  start? {"t": 1}']
    assert values(spark, ["The thrusting."], lambda c: text.replaced(c, {"thrust(?:ing)?": "pushing"})) == ["The pushing."]


def test_clock_and_numbers(spark):
    assert values(spark, ["at 1:05.7", "02:75", "99:10", None], clock.strict) == ["01:05", "N/A", "N/A", "N/A"]
    assert values(spark, ["59.6", "61.5", "x"], clock.rounded) == ["01:00", "01:02", "N/A"]
    assert values(spark, ["75", "N/A", None], clock.from_frame) == ["01:15", "N/A", "N/A"]
    got = values(spark, ['```json\n{"start_time": 01:02, "end_time": "0:01:30"}\n```', "{'start_time': '1:02.5', 'end_time': null}", "none"], clock.span)
    assert [tuple(x) for x in got] == [("01:02", "01:30"), ("01:02", "N/A"), ("N/A", "N/A")]
    assert values(spark, [2.675, 0.125, 2.5, None], numeric.round_exact, "double") == [2.67, 0.12, 2.5, None]
    assert values(spark, [10, 0, 1], lambda c: numeric.even_indices(c, 4), "int") == [[0, 3, 6, 9], [], [0, 0, 0, 0]]
    assert values(spark, [99], lambda c: numeric.centre_indices(L(None), L(None), L(25.0), c, 4), "int") == [[12, 37, 62, 86]]
    assert values(spark, ["3.7", "x", None], numeric.whole_number) == [3, 0, 0]


def test_replies(spark):
    assert values(spark, ['a {"x": "}{", "y": {"z": 1}} b {', "{ {}", "no", None], jsonx.balanced_object) == ['{"x": "}{", "y": {"z": 1}}', None, None, None]
    r = ['```json\n{"answer": "Yes", "justification": "He \'said\' so",}\n```', "{'answer': True, 'justification': 'plain'}", 'bad {"answer": "no", "justification": "cut', "I think yes", None,
         '{"answer": "na", "justification": "{\\"reason\\": \\"inner\\"}"}']
    got = [tuple(x) for x in values(spark, r, jsonx.reply)]
    assert got[1:] == [("yes", "plain"), ("no", ""), ("fail", ""), ("fail", ""), ("na", "inner")]
    assert got[0][0] == "yes"
    assert values(spark, r[3:4], lambda c: jsonx.reply(c, free_text=True)["answer"]) == ["yes"]


def test_judged(spark):
    a = '```json\n{"structural_completeness": {"overall_score": 80}, "symptom_coverage": {"score": 60}, "key_localizing_features": {"score": 100}, "temporal_fidelity": {"score": 40}, "penalties": {"hallucination_count": 2, "has_safety_issues": %s, "includes_non_seizure": %s}}\n```'
    got = values(spark, [a % ("false", "false"), a % ("true", "true"), "sorry", None], scoring.judged_quality)
    assert got == [pytest.approx(56), pytest.approx(32), None, None]
    b = '{"structural_completeness": {"onset": {"gt": true, "vlm": true}, "postictal": {"gt": true, "vlm": false}}, "symptom_coverage": {"features_found_gt": ["a", "b"], "features_found_vlm": ["a"]}, "key_localizing_features": {"figure_4": {"gt": false, "vlm": true}}, "temporal_fidelity": {"vlm_event_sequence": ["a", "b"], "gt_event_sequence": ["a", "c"]}, "penalties": {"has_safety_issues": {"gt": false, "vlm": false}, "includes_non_seizure": {"gt": false, "vlm": false}}}'
    assert values(spark, [b, "{"], scoring.listed_quality) == [pytest.approx(37.5), None]
    assert values(spark, [b], lambda c: scoring.listed_quality(c, L(120), compat=True)) == [pytest.approx(37.5 * 0.8 * 0.9)]


def test_rewards(spark):
    rows = [
        ("task-3", "<think>t</think><answer>left</answer>", "left", 1.2), ("task-3", "right", "left", 0.0), ("task-4", '{"timestamp": "01:00"}', '{"timestamp": "01:30"}', 0.5),
        ("task-4", "soon", '{"timestamp": "01:30"}', 0.0), ("task-5", "<answer>a, b</answer>", "a, c", 2.5), ("task-6", "one two three four", "one two three four", 1.0),
        ("task-1-2", '{"answer": "yes", "justification": "a b c d"}', '{"answer": "yes", "justification": "a b c d"}', 1.5), ("task-1-2", '{"answer": "no"}', '{"answer": "yes"}', 0.0), ("other", "x", "x", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, r string, s string, x double").orderBy("i")
    assert [r["y"] for r in df.select("i", rewards.task_reward("r", "s", "t").alias("y")).orderBy("i").collect()] == [None if r[3] is None else pytest.approx(r[3]) for r in rows]
    call = lambda *c: "<think>a b</think><tool_call>" + "\n".join(c) + "</tool_call>"
    x, y = '{"name": "f", "parameters": {"a": 1, "b": 2}}', '{"name": "f", "parameters": {"a": 1, "c": 2}}'
    pairs = [(call(x), call(x), 3.0), (call(y), call(x), 6 * (1 + 1 / 3 + 1) / 4 - 3), ("none", call(x), -3.0), ("none", "text", 0.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, r string, s string, x double")
    got = df.select("i", rewards.tool_calls("r", "s").alias("c"), rewards.tool_format("r", "s").alias("f"), rewards.thought_length("r", 4).alias("l")).orderBy("i").collect()
    assert [r["c"] for r in got] == [pytest.approx(p[2]) for p in pairs]
    assert [r["f"] for r in got] == [1.0, 1.0, 0.0, 0.0] and [r["l"] for r in got] == [0.5, 0.5, 0.0, 0.0]
    bags = spark.createDataFrame([(["a", "a", "b"], ["a", "c"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r["x"] for r in bags.select(arrays.common_share("a", "b").alias("x")).collect()] == [0.25, 0.0, 1.0]


def test_templates(spark):
    t = spark.createDataFrame([("1",), ("2",), ("3",)], "k string")
    a, b = spark.createDataFrame([(1, None), (2, "p")], "k int, x string"), spark.createDataFrame([(1, "q", "r"), (9, "s", "t")], "k int, x string, y string")
    out = templates.align(t, "k", [a, b, t.withColumnRenamed("k", "z")], ["x", "y", "z"])
    assert sorted(map(tuple, out.collect())) == [("1", "q", "r", None), ("2", "p", None, None), ("3", None, None, None)]
    assert [r["k"] for r in templates.empty_rows(out, "k", ["x", "y", "z"]).collect()] == ["3"]
    assert [r["name"] for r in templates.empty_columns(out, ["x", "y", "z"]).collect()] == ["z"]
    assert templates.never_given([a, b], ["x", "y", "z"]) == ["z"]


def test_file_sources(spark, tmp_path):
    import zipfile

    (tmp_path / "u.txt").write_bytes("é中".encode())
    (tmp_path / "g.txt").write_bytes("中文".encode("gbk"))
    assert {r["file"]: r["text"] for r in readers.text_files(spark, str(tmp_path), pattern="*.txt").collect()} == {"u.txt": "é中", "g.txt": "中文"}
    (tmp_path / "m.csv").write_text("a,b\n1,2\n3,4\n")
    assert readers.second_row(spark, str(tmp_path)).first()["cells"] == {"a": "3", "b": "4"}
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert [r["cells"] for r in readers.first_sheet(spark, str(tmp_path)).orderBy("row").collect()] == [["head", None, "x"], ["7", "ab"]]
    assert sorted(r["file"] for r in readers.file_list(spark, str(tmp_path), "*.txt").collect()) == ["g.txt", "u.txt"]
    assert [r["key"] for r in readers.done_keys(spark, f"{tmp_path}/m.csv").orderBy("key").collect()] == ["1", "3", "a"]
    (tmp_path / "o.lst").write_text("b\n\na\n")
    assert [(r["place"], r["value"]) for r in readers.ordered_lines(spark, f"{tmp_path}/o.lst").collect()] == [(0, "b"), (1, "a")]
