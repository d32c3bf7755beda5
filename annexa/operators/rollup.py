"""Segments to recordings, and first-wins merges; every order is an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays


def any_yes(label: str) -> Column:
    return F.when(F.max((F.col(label) == "yes").cast("int")) == 1, "yes").otherwise("no")


def state(label: str) -> Column:
    yes, no = F.bool_and(F.col(label) == "yes"), F.bool_and(F.col(label) == "no")
    return F.when(yes, "all_yes").when(no, "all_no").otherwise("mixed")


def segments(df: DataFrame, keys: list[str], order: str, label: str, text: str) -> DataFrame:
    """Any-yes label, state, and the distinct texts in order: of the yes segments if mixed, else of all."""
    out = df.groupBy(*keys).agg(any_yes(label).alias("label"), state(label).alias("state"), arrays.distinct_in_order(order, text).alias("_all"), arrays.distinct_in_order(order, F.when(F.col(label) == "yes", F.col(text))).alias("_yes"))
    chosen = F.when(F.col("state") == "mixed", F.col("_yes")).otherwise(F.col("_all"))
    return out.select(*keys, "label", "state", F.array_join(chosen, " || ").alias("text"))


def keep_one(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by an explicit order."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def coalesce_first(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Cell by cell, the first non-null value by order."""
    return df.groupBy(*keys).agg(*(F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def merged_sequence(df: DataFrame, keys: list[str], order: str, sequence: str) -> DataFrame:
    """A recording's sequence from its segments' by maximal suffix/prefix overlap."""
    listed = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, sequence))), lambda x: x[sequence]).alias("_s"))
    return listed.select(*keys, arrays.overlap_merge("_s").alias(sequence))


def aligned(a: DataFrame, b: DataFrame, value: object = 0) -> DataFrame:
    """Both tables' rows under all their columns, what one lacks filled."""
    only = [c for c in {*a.columns, *b.columns} if c not in a.columns or c not in b.columns]
    return a.unionByName(b, allowMissingColumns=True).fillna(value, only)


def with_average(df: DataFrame, name: str, values: list[str], label: str = "AVG") -> DataFrame:
    """The rows and one more that holds the mean of each value."""
    return df.select(name, *values).unionByName(df.agg(F.lit(label).alias(name), *(F.avg(v).alias(v) for v in values)))


def mixed_frequencies(words: DataFrame, phrases: DataFrame, top: int = 60, boost: int = 3) -> DataFrame:
    """token, count, type: the ``top`` words, and all phrases with their counts times ``boost``."""
    some = words.orderBy(F.desc("count"), "token").limit(top).select("token", "count", F.lit("unigram").alias("type"))
    return phrases.select("token", (F.col("count") * boost).alias("count"), F.lit("phrase").alias("type")).unionByName(some)


def outcome(df: DataFrame, result: str, error: str, value: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(all rows, failed ones with ``value`` so that a resumed run counts them as done; the failed ones with their error)."""
    bad = F.col(error).isNotNull()
    return df.withColumn(result, F.when(bad, F.lit(value)).otherwise(F.col(result))).drop(error), df.where(bad)


def event_windows(df: DataFrame, time: str, keys: list[str], width: str = "30 seconds", step: str = "25 seconds", late: str | None = None) -> DataFrame:
    """keys, start, rows by event-time windows; the same for a stream, where ``late`` is the watermark."""
    rows = df.withWatermark(time, late) if late else df
    return rows.groupBy(*keys, F.window(time, width, step).alias("_w")).agg(F.count("*").alias("rows")).select(*keys, F.col("_w.start").alias("start"), "rows")
