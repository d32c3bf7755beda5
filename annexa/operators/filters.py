"""Which rows take part: keys, lists, labels, media, ranges and worker shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(df: DataFrame, name: str = "file_name") -> DataFrame:
    """The first column is the key, whatever it is called; rows without one go."""
    return df.withColumnRenamed(df.columns[0], name).where(F.col(name).isNotNull())


def naming_any(df: DataFrame, column: str, listed: DataFrame, part: str) -> DataFrame:
    """Rows whose text holds any of the listed parts.

    The list is what an operator writes by hand; its parts become one pattern,
    quoted, so no pairs of rows are made.
    """
    parts = [r[0] for r in listed.where(F.col(part).isNotNull()).select(F.col(part).cast("string")).distinct().collect()]
    return df.where(reduce(lambda a, p: a | F.contains(F.col(column), F.lit(p)), parts, F.lit(False)))


def without(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; rows without a key stay."""
    return df.join(listed.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def only_listed(df: DataFrame, listed: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """Rows whose key is listed; fails at run time unless ``expected`` rows are left."""
    kept = df.join(listed.select(key).distinct(), key, "left_semi")
    if expected is None:
        return kept
    n = kept.agg(F.count("*").alias("_n")).withColumn("_ok", F.assert_true(F.col("_n") == expected, F.concat(F.lit(f"{expected} rows are expected, not "), F.col("_n").cast("string"))))
    return kept.join(F.broadcast(n.select("_ok")), F.col("_ok").isNull(), "inner").drop("_ok")


def labelled(df: DataFrame, column: str, keep: list[str], ignore: list[str] = ()) -> DataFrame:
    """Rows with a label of ``keep`` (blanks around it dropped); those of ``ignore`` go, any other fails at run time."""
    label = F.trim(F.col(column).cast("string"))
    known = F.coalesce(label.isin(*keep, *ignore), F.lit(False))
    ok = F.assert_true(known, F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))
    return df.withColumn(column, label).withColumn("_ok", ok).where(F.col("_ok").isNull() & F.col(column).isin(*keep)).drop("_ok")


def with_media(df: DataFrame, media: str, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows all of whose media (an array of paths) are in the listing of files; rows without media stay.

    Rows are found again by their set of media, not by a row number: Spark
    computes the two sides of the join separately, and would number them apart.
    """
    listed = files.select(F.col(path).alias("_m")).distinct()
    rows = df.withColumn("_set", F.array_sort(F.array_distinct(media)))
    lost = rows.select("_set").distinct().select("_set", F.explode("_set").alias("_m")).join(listed, "_m", "left_anti").select("_set").distinct()
    return rows.join(lost, "_set", "left_anti").drop("_set")


def in_vocabulary(df: DataFrame, truth: str, label: str) -> DataFrame:
    """Rows whose label is one of those that the truth has somewhere, both in lower case."""
    known = df.select(F.lower(truth).alias("_v")).where("_v IS NOT NULL").distinct()
    return df.withColumn("_v", F.lower(label)).join(known, "_v", "left_semi").drop("_v")


def filled(df: DataFrame, feature: str, prediction: str, features: list[str], value: str = "na") -> DataFrame:
    """Missing predictions of some features count as ``value``; truth is left as it is."""
    return df.withColumn(prediction, F.when(F.col(feature).isin(features), F.coalesce(prediction, F.lit(value))).otherwise(F.col(prediction)))


def without_summary(df: DataFrame, feature: str, prefix: str = "AVG") -> DataFrame:
    """Rows other than summary rows (AVG, AVG_18, ...)."""
    return df.where(~F.coalesce(F.col(feature).rlike(rf"^{prefix}(_\d+)?$"), F.lit(False)))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def _numbered(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` with a place from 1 by order, without bringing the rows into one task: places are counted by range partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    own = F.col("_id").bitwiseAND((1 << 33) - 1)
    # a row per partition: its rows' first place
    before = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return dealt.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("_place", F.col("_before") + own + 1).drop("_p", "_id", "_before")


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def row_range(df: DataFrame, order: list[Column | str], first: int, last: int, most: int = 2300) -> DataFrame:
    """Rows ``first`` to ``last`` by order, from 1 and both included; a last over ``most`` means all that are left."""
    if first > last:
        raise ValueError("the first row comes after the last")
    placed = _numbered(df, order)
    keep = F.col("_place") >= max(1, first)
    return placed.where(keep if last > most else keep & (F.col("_place") <= last)).drop("_place")


def worker_chunks(df: DataFrame, order: list[Column | str], workers: int = 8, name: str = "worker") -> DataFrame:
    """Contiguous shares by order, of ceil(n / workers) rows each; the last ones may be short or empty."""
    placed = _numbered(df, order)
    n = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / workers)).alias("_size"))
    return placed.join(F.broadcast(n)).withColumn(name, F.floor((F.col("_place") - 1) / F.col("_size")).cast("int")).drop("_place", "_size")
