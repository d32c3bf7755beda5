"""Joins with checked cardinality, ranges and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rollup import keep_one


def checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """A join that fails at run time if the right side (or either, one_to_one) repeats a key.

    A side becomes one row a key by an aggregate, which combines repeats before
    the shuffle and fails on the first; so a hot key is never gathered.
    """

    def sole(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        row = F.first(F.struct(*rest)) if rest else F.lit(None)
        one = df.groupBy(*keys).agg(F.count("*").alias("_n"), row.alias("_row"))
        ok = F.assert_true(F.col("_n") == 1, F.lit("a key is repeated on a side that may not repeat it"))
        return one.withColumn("_ok", ok).where("_ok IS NULL").select(*keys, *(F.col("_row")[c].alias(c) for c in rest))

    return (sole(left) if one_to_one else left).join(sole(right), keys, how)


def overlapping(points: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, w_start: str, w_end: str, width: int) -> DataFrame:
    """Pairs of an interval and a window (of ``width`` at most) that overlap, both ends closed.

    Both sides are dealt by the buckets of ``width`` that they touch, so the
    join is an equi join; a pair is kept in the first bucket they share.
    """
    touch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    p, s = points.withColumn("_b", touch(start, end)), spans.withColumn("_b", touch(w_start, w_end))
    first = F.greatest(F.floor(F.col(start) / width), F.floor(F.col(w_start) / width))
    return p.join(s, [*keys, "_b"]).where((F.col(start) <= F.col(w_end)) & (F.col(end) >= F.col(w_start)) & (F.col("_b") == first)).drop("_b")


def positional_diff(a: DataFrame, b: DataFrame, order_a: list, order_b: list, value: str, keys: list[str] = ()) -> DataFrame:
    """Two lists side by side by position: match, mismatch, missing (only in a) or extra (only in b).

    keys: many pairs of lists at once, one task a list. Without keys both
    tables are one list each and are numbered in one task, so give keys for
    anything that grows.
    """
    keys = list(keys)
    place = lambda df, order, name: df.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias("pos"), F.col(value).alias(name))
    both = place(a, order_a, "left").join(place(b, order_b, "right"), [*keys, "pos"], "full")
    status = F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "extra").when(F.col("left") == F.col("right"), "match").otherwise("mismatch")
    return both.withColumn("status", status)


def diff_summary(diff: DataFrame, keys: list[str] = ()) -> DataFrame:
    """first (the first place that differs), mismatches, missing, extra, by keys."""
    count = lambda s: F.count_if(F.col("status") == s)
    return diff.groupBy(*keys).agg(F.min(F.when(F.col("status") != "match", F.col("pos"))).alias("first"), count("mismatch").alias("mismatches"), count("missing").alias("missing"), count("extra").alias("extra"))


def suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """An equi join in which columns that both sides have get their side's suffix, and no others."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    named = lambda df, end: df.select(*(F.col(c).alias(c + end if c in both else c) for c in df.columns))
    return named(left, suffixes[0]).join(named(right, suffixes[1]), keys, how)


def stem(c) -> Column:
    """A file's name without folders and extension, in lower case; a name that starts with its only dot is kept."""
    name = F.regexp_extract(F.lower(F.trim(F.col(c) if isinstance(c, str) else c)), r"([^/]*)$", 1)
    return F.coalesce(F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", ""), F.lit(""))


def by_stem(left: DataFrame, right: DataFrame, name: str, order_left: list[str], order_right: list[str], suffixes: tuple[str, str] = ("_gt", "_pred")) -> DataFrame:
    """Rows of both sides whose names have one stem; of a side's rows with one stem the first by order counts."""
    first = lambda df, order: keep_one(df.withColumn("stem", stem(name)), ["stem"], order)
    return suffixed(first(left, order_left), first(right, order_right), ["stem"], suffixes)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with the table's value; a key that the table lacks fails at run time."""
    known = table.select(key, F.struct(value).alias("_found"))
    ok = F.assert_true(F.col("_found").isNotNull(), F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    joined = df.join(known, key, "left").withColumn("_ok", ok).where("_ok IS NULL")
    return joined.withColumn(value, F.col("_found")[value]).drop("_found", "_ok")


def shared_questions(left: DataFrame, right: DataFrame, wanted: dict[str, list[str]]) -> dict[str, list[str]]:
    """Feature -> those of its questions that are columns of both sides, in order; features without any are left out."""
    both = set(left.columns) & set(right.columns)
    found = {f: [q for q in questions if q in both] for f, questions in wanted.items()}
    return {f: q for f, q in found.items() if q}
