"""Event sequences and lengths from wide annotations: a label per feature, and its start and end times as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def longest(columns: list[str]) -> Column:
    """The latest of the times in ``columns``, in seconds; null if none can be read."""
    times = F.filter(F.array(*(clock.seconds(c) for c in columns)), lambda x: x.isNotNull())
    return F.array_max(times)


def event_sequence(df: DataFrame, keys: list[str], features: list[str], exclude: list[str] = (), start: str = "start_time_for_{}") -> DataFrame:
    """keys, sequence, n_present, missing (no start), invalid (a start that cannot be read), by_column.

    The features marked yes, by their start; equal starts keep the columns'
    order, and so do all features (by_column) where no start can be read.
    Features without a column of starts are in neither report.
    """
    seen = []
    for place, name in enumerate(f for f in features if f not in exclude):
        column = start.format(name)
        text = F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string")
        blank = F.coalesce(F.trim(text), F.lit("")) == ""
        seen.append(
            F.struct(
                (F.lower(F.trim(F.col(name).cast("string"))) == "yes").alias("yes"), clock.seconds(text).alias("at"), F.lit(place).alias("place"), F.lit(name).alias("name"),
                (F.lit(column in df.columns) & blank).alias("missing"), (~blank).alias("given"),
            )
        )
    present = F.filter(F.array(*seen), lambda x: F.coalesce(x["yes"], F.lit(False)))
    names = lambda x: F.transform(x, lambda e: e["name"])
    timed = F.filter("_present", lambda x: x["at"].isNotNull())
    by_time = names(F.array_sort(F.transform(timed, lambda x: F.struct(x["at"].alias("at"), x["place"].alias("place"), x["name"].alias("name")))))
    out = df.select(*keys, present.alias("_present")).withColumn("_time", by_time)
    return out.select(
        *keys, F.when(F.size("_time") > 0, F.col("_time")).otherwise(names("_present")).alias("sequence"), F.size("_present").alias("n_present"),
        names(F.filter("_present", lambda x: x["missing"])).alias("missing"), names(F.filter("_present", lambda x: x["given"] & x["at"].isNull())).alias("invalid"),
        ((F.size("_time") == 0) & (F.size("_present") > 0)).alias("by_column"),
    )
