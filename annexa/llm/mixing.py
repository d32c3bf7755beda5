"""Mixing sources to target weights by Pareto order sampling (operator 6).

Each source gets a share of the mixture's words by weight; targets stop at
``max_ratio`` times the source's own words and the excess is dealt again by
weight. Within a source a document is expected ``e = min(max_ratio, c *
size ** tilt)`` times, c solved so that the expected words meet the target.
``floor(e)`` whole copies are certain. The fraction ``p = e - floor(e)`` is
sampled: documents are ranked by random odds over inclusion odds,
``(u / (1-u)) / (p / (1-p))`` with u a seeded hash of the document, and taken
in that order until the source's remaining words are used up. So reruns agree.

Scale: one pass over the texts counts words; everything after works on one
narrow row per document. Ranks are cut by a histogram of fine buckets, so no
task or sort ever sees a whole source. Targets are set over one row per source;
c is solved source by source from classes of size, 64 an octave, whatever the
rows. Classes make c inexact by far less than a percent, which moves chances
and not the words taken: the cut through the ranks is at the exact target.

Cases: null text has size 0; a document of size 0 is never taken; a null
source is one source, last in order; the draw is over doc_id, source and text,
so only rows equal in all three share one, and which of those is taken makes no
difference to the mix; very long texts are counted whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import cut

WEIGHTS = (5.0, 2.0, 1.0)
_BUCKETS = 1 << 12
_OCTAVE = 64


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, th (text hash), size (words of the whole text) and u, uniform in (0, 1) by a hash of the row."""

    def count(rows):
        for rb in rows:
            data, offsets = words.buffers(rb.column("text"))
            n = words.spans(data, offsets)[2] if rb.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("source"), rb.column("th"), pa.array(n, pa.int64())], ["doc_id", "source", "th", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    sized = rows.mapInArrow(count, "doc_id long, source string, th long, size long")
    return sized.withColumn("u", (F.pmod(F.xxhash64(F.lit(17), "doc_id", "source", "th"), F.lit(1 << 52)) + 0.5) / float(1 << 52))


def targets(total: np.ndarray, weight: np.ndarray, max_ratio: float) -> np.ndarray:
    """Words per source: shares by weight of all words, none above max_ratio times its own."""
    goal, cap = np.zeros(len(total)), max_ratio * total
    open_, left = cap > 0, float(total.sum())
    while open_.any() and left > 0:
        share = np.where(open_, weight, 0) * (left / weight[open_].sum())
        over = open_ & (share >= cap)
        if not over.any():
            return np.where(open_, share, goal)
        goal[over] = cap[over]
        left -= float(cap[over].sum())
        open_ &= ~over
    return goal


def _solve(size: np.ndarray, words_of: np.ndarray, goal: float, max_ratio: float, tilt: float) -> float:
    """c with sum of words * min(max_ratio, c * size ** tilt) = goal."""
    g = size**tilt
    lo, hi = 0.0, max_ratio / g.min() * (1 + 1e-9)
    for _ in range(200):
        mid = (lo + hi) / 2
        if float((words_of * np.minimum(max_ratio, mid * g)).sum()) < goal:
            lo = mid
        else:
            hi = mid
    return hi


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_ratio: float = 3.0, tilt: float = 0.25) -> DataFrame:
    """doc_id, th (text hash), source, size, source_size, target, copies (how often the mix takes the document), taken."""
    sized = cut(word_counts(docs))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pdf["source"].map(lambda x: (x is None, (x or "").encode()))
        pdf = pdf.loc[code.sort_values().index]
        weight = np.array([weights[i % len(weights)] for i in range(len(pdf))])
        return pdf[["source", "source_size"]].assign(target=targets(pdf["source_size"].to_numpy(float), weight, max_ratio))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own, goal = pdf[pdf["words"] > 0], float(pdf["target"].iloc[0])
        words_of = own["words"].to_numpy(float)
        c = _solve(words_of / own["n"].to_numpy(float), words_of, goal, max_ratio, tilt) if len(own) and goal > 0 else 0.0
        return pdf[["source", "source_size", "target"]].head(1).assign(c=c)

    octave = F.when(F.col("size") > 0, F.floor(F.log2("size") * _OCTAVE)).otherwise(-1)
    classes = cut(sized.groupBy("source", octave.alias("octave")).agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    totals = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.lit(1).alias("one"))
    goals = totals.groupBy("one").applyInPandas(share, "source string, source_size long, target double")
    goals = cut(goals).withColumnRenamed("source", "s")
    per_class = classes.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s", "octave")
    planned = cut(per_class.groupBy("source").applyInPandas(solve, "source string, source_size long, target double, c double"))
    known = planned.withColumnRenamed("source", "s")
    small = planned.count() <= 100_000  # rows of some 50 bytes; beyond that an ordinary join
    known = F.broadcast(known) if small else known
    e = F.least(F.lit(max_ratio), F.col("c") * F.pow(F.col("size").cast("double"), F.lit(tilt)))
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rows = rows.withColumn("e", F.when(F.col("size") > 0, e).otherwise(0.0)).withColumn("whole", F.floor("e")).withColumn("p", F.col("e") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    rank = F.when((F.col("p") > 1e-9) & (F.col("size") > 0), odds)
    # odds/(1+odds) is in (0, 1): its bucket is a cut of the ranks that needs no sort
    rows = cut(rows.withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * _BUCKETS).cast("int")).drop("e", "p", "c", "u"))
    need = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    per = rows.where("bucket IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("w"))
    run = per.withColumn("before", F.sum("w").over(Window.partitionBy("source").orderBy("bucket")) - F.col("w"))
    s, b = F.col("source"), F.col("bucket")
    cut_at = run.select(s.alias("s"), b.alias("b"), "w", "before").join(need.select(s.alias("s2"), "need"), F.col("s").eqNullSafe(F.col("s2"))).where("before + w > need")
    # a row per source: the bucket that the cut runs through; those below are taken whole, and all where there is none
    edge = cut(cut_at.groupBy("s").agg(F.min_by(F.struct("b", "before", "need"), "b").alias("e")).select("s", "e.*"))
    edge = F.broadcast(edge) if small else edge
    state = F.when(F.col("b").isNull() | (F.col("bucket") < F.col("b")), 1).when(F.col("bucket") > F.col("b"), -1).otherwise(0)
    rows = rows.join(edge, s.eqNullSafe(F.col("s")), "left").withColumn("state", F.when(b.isNotNull(), state)).drop("s", "b")
    # Only buckets that the cut runs through are ranked; each has about one of _BUCKETS of its source.
    inside = rows.where("state = 0")
    w = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "th", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(w))
    # the document on the border comes in if that brings the words nearer to the target
    taken = F.when(F.col("upto") - F.col("size") / 2 <= F.col("need"), 1).otherwise(0)
    outside = rows.where("state IS NULL OR state <> 0").withColumn("extra", F.when(F.col("state") == 1, 1).otherwise(0))
    both = inside.withColumn("extra", taken).select(*outside.columns).unionByName(outside)
    return both.select("doc_id", "th", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
