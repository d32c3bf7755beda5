"""Filling a template of keys and columns from several tables, with reports of what stayed empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollup import coalesce_first


def align(template: DataFrame, key: str, tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """key and columns for every key of the template; each cell is the first non-null one, in the order of the tables.

    A table may lack columns (a table without the key is left out) and may
    repeat keys: the tables go through one aggregate, and its rows are joined once.
    """
    parts = []
    for n, t in enumerate(tables):
        if key in t.columns:
            parts.append(t.select(F.col(key).cast("string").alias(key), F.lit(n).alias("_order"), *(F.col(c).cast("string").alias(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in columns)))
    keys = template.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    if not parts:
        return keys.select(key, *(F.lit(None).cast("string").alias(c) for c in columns))
    return keys.join(coalesce_first(reduce(DataFrame.unionByName, parts), [key], "_order", columns), key, "left").select(key, *columns)


def empty_rows(aligned: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys for which no table had anything."""
    return aligned.where(F.coalesce(*columns).isNull()).select(key)


def empty_columns(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column without any value: name."""
    counts = aligned.agg(*(F.count(c).alias(c) for c in columns))
    return counts.unpivot([], columns, "name", "n").where("n = 0").select("name")


def never_given(tables: list[DataFrame], columns: list[str]) -> list[str]:
    """Columns that no table has at all."""
    have = {c for t in tables for c in t.columns}
    return [c for c in columns if c not in have]


def answered(value: Column, missing: str = "N/A") -> Column:
    return value.isNotNull() & (value != missing)
