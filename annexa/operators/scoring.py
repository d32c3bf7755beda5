"""Composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, jsonx, textscore
from ..functions.text import same_answer

#: Weights of a feature's questions by their number; more questions weigh the same.
WEIGHTS = {1: [1.0], 2: [0.7, 0.3], 3: [0.7, 0.15, 0.15], 4: [0.7, 0.1, 0.1, 0.1], 5: [0.7, 0.075, 0.075, 0.075, 0.075]}


def gated(answers: DataFrame, keys: list[str], number: str, truth: str, pred: str) -> DataFrame:
    """Weighted share of equal answers by keys; question 0 and 1 gate: both valid and different scores 0.

    Rows: question number (0 is the feature itself), truth and prediction.
    """
    valid = F.col(truth).isin("yes", "no") & F.col(pred).isin("yes", "no")
    shut = F.max((F.col(number).isin(0, 1) & valid & (F.col(truth) != F.col(pred))).cast("int"))
    hits = F.sort_array(F.collect_list(F.when(F.col(number) > 0, F.struct(F.col(number).alias("q"), same_answer(truth, pred).cast("double").alias("hit")))))
    weights = F.create_map(*[x for n, w in WEIGHTS.items() for x in (F.lit(n), F.array(*map(F.lit, w)))])
    by = answers.groupBy(*keys).agg(shut.alias("_shut"), hits.alias("_h"))
    total = F.aggregate(F.zip_with("_h", F.coalesce(weights[F.size("_h")], F.transform("_h", lambda h: 1.0 / F.size("_h"))), lambda h, w: h["hit"] * w), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return by.select(*keys, F.when(F.col("_shut") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).alias("score"))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def report_quality(truth_structure, pred_structure, truth_events, pred_events, truth_local, pred_local, extra_words, safety, off_topic, weight: float = 1.0) -> Column:
    """A report's index from 0 to 100: structure, coverage, set F1 and localisation in equal parts, less hallucinations and overlength.

    Columns: arrays of text for structure and events, arrays of (key=value)
    text for localisation, words over the allowed length, and two flags.
    """
    both = F.size(F.array_intersect(pred_events, truth_events)).cast("double")
    nt, np_ = F.size(F.array_distinct(truth_events)), F.size(F.array_distinct(pred_events))
    one_empty = lambda x: F.when((nt == 0) & (np_ == 0), 100.0).when((nt == 0) | (np_ == 0), 0.0).otherwise(x)
    structure = _share(F.size(F.array_intersect(truth_structure, pred_structure)), F.size(truth_structure))
    local = _share(F.size(F.array_intersect(truth_local, pred_local)), F.size(truth_local))
    coverage, f1 = one_empty(100.0 * both / nt), one_empty(200.0 * both / (nt + np_))
    invented = F.when((nt == 0) | (np_ == 0), 0).otherwise(F.size(F.array_except(pred_events, truth_events)))
    base = (structure + coverage + f1 + local) / 4 - weight * invented
    x = F.when(off_topic, base * 0.8).otherwise(base) - F.floor(F.greatest(F.lit(0), extra_words) / 50)
    x = F.when(safety, F.least(F.lit(50.0), x)).otherwise(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


#: The judge's JSON, scored (A) and listed (B).
JUDGED = """structural_completeness struct<overall_score: double>, symptom_coverage struct<score: double>, key_localizing_features struct<score: double>,
temporal_fidelity struct<score: double>, penalties struct<hallucination_count: double, has_safety_issues: boolean, includes_non_seizure: boolean>"""
STRUCTURE = ["onset", "propagation", "postictal"]
LOCALISING = ["head_version", "first_motor_laterality", "asymmetric_posturing", "figure_4"]
_FLAG = "struct<gt: boolean, vlm: boolean>"
LISTED = f"""structural_completeness struct<{", ".join(f"{k}: {_FLAG}" for k in STRUCTURE)}>, key_localizing_features struct<{", ".join(f"{k}: {_FLAG}" for k in LOCALISING)}>,
symptom_coverage struct<features_found_gt: array<string>, features_found_vlm: array<string>>, temporal_fidelity struct<vlm_event_sequence: array<string>, gt_event_sequence: array<string>>,
penalties struct<hallucination_count: double>"""
WEIGHT = 0.25


def _bounded(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def judged_quality(c) -> Column:
    """A judge's four scores in equal parts: at most 50 with safety issues, then 0.8 of it with other content, less a tenth a hallucination. Null if a score is missing."""
    j = F.from_json(jsonx.unfenced(c), JUDGED)
    p = j["penalties"]
    x = WEIGHT * (j["structural_completeness"]["overall_score"] + j["symptom_coverage"]["score"] + j["key_localizing_features"]["score"] + j["temporal_fidelity"]["score"])
    x = F.when(p["has_safety_issues"], F.least(F.lit(50.0), x)).otherwise(x)
    x = F.when(p["includes_non_seizure"], 0.8 * x).otherwise(x)
    return F.when(x.isNotNull() & p["hallucination_count"].isNotNull(), _bounded(x * F.greatest(F.lit(0.0), 1 - 0.1 * p["hallucination_count"])))


def listed_quality(c, extra_chars=None, compat: bool = False) -> Column:
    """The index from a judge's lists: flags and features of both reports and their event sequences.

    Coverage is features found over features of the truth, which can pass
    100; sequences score by their aligned F1. A safety flag (cap 50) and other
    content (0.8) count if the report has them; with ``compat`` any flag object
    counts, whatever it says. ``extra_chars`` (over the truth's length) cost a
    twentieth for every 50. Null if the reply is no such JSON.
    """
    text = jsonx.unfenced(c)
    j = F.from_json(text, LISTED)

    def share(part: str, names: list[str]) -> Column:
        gt = sum((F.coalesce(j[part][k]["gt"].cast("int"), F.lit(0)) for k in names), F.lit(0))
        both = sum((F.coalesce((j[part][k]["gt"] & j[part][k]["vlm"]).cast("int"), F.lit(0)) for k in names), F.lit(0))
        return _share(both, gt)

    none = F.array().cast("array<string>")
    count = lambda name: F.size(F.array_distinct(F.coalesce(j["symptom_coverage"][name], none)))
    events = lambda name: arrays.clean_tokens(F.coalesce(j["temporal_fidelity"][name], none))
    order = 100.0 * textscore.aligned_f1(events("vlm_event_sequence"), events("gt_event_sequence"), compat)
    x = WEIGHT * (share("structural_completeness", STRUCTURE) + _share(count("features_found_vlm"), count("features_found_gt")) + share("key_localizing_features", LOCALISING) + order)

    def flagged(name: str) -> Column:
        v = F.get_json_object(text, f"$.penalties.{name}")
        truthy = ~v.isin("false", "null", "0", "", "{}", "[]") if compat else (v == "true") | (F.get_json_object(text, f"$.penalties.{name}.vlm") == "true")
        return F.coalesce(truthy, F.lit(False))

    x = F.when(flagged("has_safety_issues"), F.least(F.lit(50.0), x)).otherwise(x)
    much = F.greatest(F.lit(0.0), 1 - 0.1 * F.coalesce(j["penalties"]["hallucination_count"], F.lit(0.0)))
    if extra_chars is not None:
        much = much * F.greatest(F.lit(0.0), 1 - 0.05 * F.floor(F.greatest(F.lit(0), extra_chars) / 50))
    other = F.when(flagged("includes_non_seizure"), 0.8).otherwise(1.0)
    return F.when(j["structural_completeness"].isNotNull() & j["penalties"].isNotNull(), _bounded(x * other * much))
