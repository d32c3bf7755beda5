"""Classification, timing, sequence and correlation metrics; one shuffle on the grouping keys each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), _ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1")]


def binary(pairs: DataFrame, keys: list[str], truth: str, pred: str, positive, vocabulary: list | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 by keys; null (not 0) where a group has no valid pair."""
    t, p = F.col(truth), F.col(pred)
    valid = t.isin(vocabulary) & p.isin(vocabulary) if vocabulary else t.isNotNull() & p.isNotNull()
    count = lambda c: F.count_if(valid & c)
    sums = pairs.groupBy(*keys).agg(
        F.count_if(valid).alias("n"), count((t == positive) & (p == positive)).alias("tp"), count((t != positive) & (p == positive)).alias("fp"),
        count((t == positive) & (p != positive)).alias("fn"), count(t == p).alias("same"),
    )
    some = lambda c, name: F.when(F.col("n") > 0, c).alias(name)
    p_, r_, f_ = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(*keys, "n", some(F.try_divide("same", "n"), "accuracy"), some(p_, "precision"), some(r_, "recall"), some(f_, "f1"))


def macro(pairs: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """Unweighted means over the labels seen in truth or prediction."""
    sides = pairs.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(
        *keys, F.explode(F.array(F.struct(F.col(truth).alias("l"), F.lit(1).alias("t"), (F.col(truth) == F.col(pred)).cast("int").alias("hit")), F.struct(F.col(pred).alias("l"), F.lit(0).alias("t"), F.lit(0).alias("hit")))).alias("x")
    )
    by = sides.groupBy(*keys, F.col("x.l").alias("l")).agg(F.sum("x.hit").alias("tp"), F.sum("x.t").alias("n_true"), F.sum(1 - F.col("x.t")).alias("n_pred"))
    scored = by.select(*keys, *_scores(F.col("tp"), F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")))
    return scored.groupBy(*keys).agg(F.count("*").alias("labels"), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def mean_absolute_error(pairs: DataFrame, vocabulary: DataFrame, key: str, truth: str, pred: str, zero_if_none: bool = False) -> DataFrame:
    """By key of a vocabulary; a key without rows gives null, or 0 where that is asked for."""
    err = pairs.groupBy(key).agg(F.avg(F.abs(F.col(truth) - F.col(pred))).alias("mae"), F.count("*").alias("n"))
    out = vocabulary.select(key).distinct().join(err, key, "left")
    return out.select(key, (F.coalesce("mae", F.lit(0.0)) if zero_if_none else F.col("mae")).alias("mae"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def average_rank(df: DataFrame, keys: list[str], c: str, name: str) -> DataFrame:
    """Ranks with ties at their mean."""
    w = Window.partitionBy(*keys).orderBy(c)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0)


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman coefficients by keys."""
    ranked = average_rank(average_rank(df, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"))


def pair_orders(df: DataFrame, key: str, ident: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b, and how often two rows are ordered alike (ties in x left out), over the pairs within key.

    Quadratic in a group by nature; meant for groups of scored items.
    """
    side = lambda n: df.select(key, F.col(ident).alias(f"i{n}"), F.col(x).alias(f"x{n}"), F.col(y).alias(f"y{n}"))
    pairs = side(1).join(side(2), key).where("i1 < i2").select(key, F.signum(F.col("x1") - F.col("x2")).alias("sx"), F.signum(F.col("y1") - F.col("y2")).alias("sy"))
    return pairs.groupBy(key).agg(
        F.try_divide(F.sum(F.col("sx") * F.col("sy")), F.sqrt(F.sum(F.abs("sx")) * F.sum(F.abs("sy")))).alias("kendall"),
        F.avg(F.when(F.col("sx") != 0, (F.col("sx") == F.col("sy")).cast("double"))).alias("pair_accuracy"),
    )
