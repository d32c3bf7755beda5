"""Group-stratified folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5, greedy: bool = False) -> DataFrame:
    """``df`` with a fold: no group in two folds, each fold near the overall share of label 1.

    Rows are counted per group in Spark; only these counts meet in one task.
    There the groups, most one-sided first (ties by size, then by a hash), go
    to the fold that leaves both labels spread most evenly over the folds, or
    (greedy) to the one then nearest to the overall share and an equal size.
    """

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < folds:
            raise ValueError("fewer groups than folds")
        pdf = pdf.sort_values(["side", "n", "h", group], ascending=[False, False, True, True])
        goal, share = pdf["n"].sum() / folds, pdf["y"].sum() / max(1, pdf["n"].sum())
        all_ = np.maximum(1, np.array([pdf["n"].sum() - pdf["y"].sum(), pdf["y"].sum()]))
        held, out = np.zeros((folds, 2)), []
        for n, y in zip(pdf["n"], pdf["y"], strict=True):
            own = np.array([n - y, y])
            cost = []
            for k in range(folds):
                size = held[k].sum() + n
                if greedy:
                    cost.append((abs((held[k][1] + y) / size - share) + 0.1 * abs(size - goal) / goal, 0))
                else:
                    held[k] += own
                    cost.append((round(float((held / all_).std(axis=0).mean()), 12), size))
                    held[k] -= own
            k = cost.index(min(cost))
            held[k] += own
            out.append(k)
        return pd.DataFrame({group: pdf[group], "fold": out})

    counts = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("y")).withColumn("side", F.abs(2 * F.col("y") - F.col("n"))).withColumn("h", F.xxhash64(group)).withColumn("_one", F.lit(1))
    kind = counts.schema[group].dataType.simpleString()
    dealt = counts.groupBy("_one").applyInPandas(deal, f"{group} {kind}, fold int")
    return df.join(dealt, group)


def checked_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``df`` as it is; fails at run time if a row has no fold of 0..folds-1 or a group lies in two."""
    span = df.groupBy(group).agg(F.min("fold").alias("_a"), F.max("fold").alias("_b"), F.count("*").alias("_n"), F.count("fold").alias("_k"))
    fine = (F.col("_n") == F.col("_k")) & (F.col("_a") == F.col("_b")) & (F.col("_a") >= 0) & (F.col("_b") < folds)
    ok = span.withColumn("_ok", F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("a row has no fold, or a group has two")))
    return df.join(ok.where("_ok IS NULL").select(group), group)


def train_and_validation(df: DataFrame, folds: int = 5) -> DataFrame:
    """Each row once per ``split``: validation in its own fold's, train in all others."""
    every = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return every.withColumn("part", F.when(F.col("split") == F.col("fold"), "validation").otherwise("train"))


def split_summary(df: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """split, part, rows, groups, positive: the sizes of every train and validation part, from one count per group and fold."""
    counts = df.groupBy("fold", group).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("y"))
    return train_and_validation(counts, folds).groupBy("split", "part").agg(F.sum("n").alias("rows"), F.count_distinct(group).alias("groups"), F.sum("y").alias("positive"))
