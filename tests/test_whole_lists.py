"""Queries over users' event lists use every event, not the first ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from annexa.functions import textscore
from annexa.plans import catalog
from tests.conftest import SF


@pytest.fixture(scope="module")
def lists(spark):
    own = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").collect():
        own.setdefault(r["user_id"], []).append((r["ts"], r["event_id"], r["event_type"]))
    own = {u: [x[2] for x in sorted(rows)] for u, rows in own.items()}
    assert max(map(len, own.values())) > 10
    return {u: (a, own[u + 1]) for u, a in own.items() if u + 1 in own}


def table(a, b):
    """Edit distance and length of the longest common subsequence."""
    d, l = list(range(len(b) + 1)), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        e, k = [i + 1], [0]
        for j, y in enumerate(b):
            e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
            k.append(l[j] + 1 if x == y else max(l[j + 1], k[j]))
        d, l = e, k
    return d[-1], l[-1]


def rows(spark, name):
    return {r["user_id"]: r for r in catalog.QUERIES[name](spark, SF).collect()}


def test_sequence_metrics(spark, lists):
    got = rows(spark, "sequence_metrics")
    assert got.keys() == lists.keys()
    for u, (a, b) in lists.items():
        n = table(a, b)[1]
        assert (got[u]["lcs"], got[u]["pred_len"], got[u]["gt_len"]) == (n, len(a), len(b))
        assert got[u]["lcs_precision"] == pytest.approx(n / len(a)) and got[u]["lcs_recall"] == pytest.approx(n / len(b))


def test_aligned_f1(spark, lists):
    got = rows(spark, "aligned_f1")
    df = spark.createDataFrame([(u, a, b) for u, (a, b) in lists.items()], "u long, a array<string>, b array<string>")
    want = {r["u"]: r for r in df.select("u", *(F.round(textscore.aligned_f1("a", "b", compat=c), 6).alias(str(c)) for c in (False, True))).collect()}
    assert {u: (r["f1"], r["f1_compat"]) for u, r in got.items()} == {u: (r["False"], r["True"]) for u, r in want.items()}


def test_whole_queries(spark, lists):
    distance, share = rows(spark, "edit_distance"), rows(spark, "bag_overlap")
    assert distance.keys() == share.keys() == lists.keys()
    for u, (a, b) in lists.items():
        both = sum((Counter(a) & Counter(b)).values())
        assert distance[u]["distance"] == table(a, b)[0]
        assert share[u]["share"] == pytest.approx(both / (len(a) + len(b) - both), abs=1e-6)
