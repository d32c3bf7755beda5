"""Rounding and index sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _c


@F.pandas_udf(T.DoubleType())
def _exact(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(x, digits, strict=True)], dtype="float64")


def round_exact(c, digits: int = 2) -> Column:
    """Rounds the exact binary value, ties to even (2.675 gives 2.67); F.round works on the shortest decimal."""
    return _exact(_c(c).cast("double"), F.lit(digits))


def clamp(c, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(c)))


def whole_number(c) -> Column:
    """Text to int, 0 where it is no number."""
    return F.coalesce(_c(c).try_cast("double").try_cast("int"), F.lit(0))


def even_indices(n, k: int) -> Column:
    """k indices evenly from 0 to n - 1, both ends among them; none for n of 0 or less."""
    n = _c(n)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(k - 1, 1))).cast("int"))
    return F.when(n > 0, at).otherwise(F.array().cast("array<int>"))


def centre_indices(start, end, fps, last, k: int = 32) -> Column:
    """The middle of each of k equal parts between two times (null: whole length) of a recording whose last frame is ``last``."""
    fps = _c(fps).cast("double")
    a = F.greatest(F.lit(0), F.coalesce(F.bround(_c(start) * fps).cast("int"), F.lit(0)))
    b = F.least(_c(last).cast("int"), F.coalesce(F.bround(_c(end) * fps).cast("int"), _c(last).cast("int")))
    width = (b - a) / F.lit(float(k))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (a + width / 2 + F.bround(width * i)).cast("int"))
