"""The classifier learns from few texts, and from the whole of long ones."""

import random

import zstandard

from annexa.llm import quality


def texts(seed):
    rng = random.Random(seed)
    good = lambda n: " ".join(rng.choice(["the", "river", "stone", "walks", "under", "bright", "evening"]) + rng.choice(["", "s", "ly"]) for _ in range(n))
    bad = lambda n: " ".join("".join(rng.choice("xqzkj$%#") for _ in range(3)) for _ in range(n))
    return good, bad


def frames(spark, rows):
    """Documents of (doc_id, text, quality or None) and the labels among them."""
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows if q is not None], "doc_id long, quality int")


def learnable(spark, n):
    ids = spark.range(4 * n + 20).withColumnRenamed("id", "doc_id").where(~quality.held_out())
    return [r["doc_id"] for r in ids.orderBy("doc_id").limit(n).collect()]


def test_few_labels(spark):
    good, bad = texts(4)
    for few in (1, 2, 8):
        ids = learnable(spark, 30 + few)
        rows = [(i, good(200), 1) for i in ids[few:]] + [(i, bad(200), 0) for i in ids[:few]]
        rows += [(1000 + i, good(200), None) for i in range(9)] + [(2000 + i, bad(200), None) for i in range(9)]
        got = {r["doc_id"]: r["score"] for r in quality.classify_quality(*frames(spark, rows)).collect()}
        assert min(got[1000 + i] for i in range(9)) > max(got[2000 + i] for i in range(9))


def test_untrainable_texts_serve_themselves():
    made = quality._dictionary([b"a few words only"], 393_216)
    assert made == b"a few words only" and zstandard.ZstdCompressionDict(made, dict_type=zstandard.DICT_TYPE_AUTO)


def test_what_follows_a_long_beginning_is_learnt(spark):
    good, bad = texts(5)
    rng = random.Random(6)
    start = lambda: " ".join(f"n{rng.randrange(10**6)}" for _ in range(2600))
    assert len(start()) > 16_384
    rows = [(i, start() + " " + (good(1500) if k % 2 else bad(2600)), k % 2) for k, i in enumerate(learnable(spark, 40))]
    rows += [(1000 + i, good(200), None) for i in range(9)] + [(2000 + i, bad(200), None) for i in range(9)]
    got = {r["doc_id"]: r["score"] for r in quality.classify_quality(*frames(spark, rows)).collect()}
    assert min(got[1000 + i] for i in range(9)) > max(got[2000 + i] for i in range(9))
