"""Ordered sequences as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def event_sequence(c) -> Column:
    """Items of ``['a', 'b']``, ``[a, b]``, ``a, b`` (also with full-width commas) or ``a b``."""
    inner = F.regexp_replace(F.trim(_c(c)), r"^\[|\]$", "")
    cut = F.when(inner.rlike("[,，]"), F.split(inner, "[,，]")).when(_c(c).rlike(r"^\s*\["), F.array(inner)).otherwise(F.split(inner, r"\s+"))
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", "")), lambda x: x != "")


def clean_tokens(a: Column) -> Column:
    """Quotes around and stops behind each item dropped, white space as underscores, empty items left out."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^[\s'\"]+|[\s'\"]+$", ""), r"[.;]+$", ""), r"\s+", "_")
    return F.filter(F.transform(a, clean), lambda x: x != "")


def tokens(c) -> Column:
    """Items of a comma list; null gives none."""
    return clean_tokens(F.split(F.coalesce(_c(c), F.lit("")), ","))


def distinct_in_order(order, value) -> Column:
    """Aggregate: values by order, each once, blanks left out."""
    both = F.array_sort(F.collect_list(F.struct(_c(order).alias("o"), _c(value).alias("v"))))
    return F.array_distinct(F.transform(F.filter(both, lambda x: F.trim(F.coalesce(x["v"], F.lit(""))) != ""), lambda x: F.trim(x["v"])))


def overlap_merge(sequences: str) -> Column:
    """Folds an array of arrays: each joins on with its longest prefix that the result ends with."""
    return F.expr(
        f"""aggregate({sequences}, cast(array() as array<string>), (acc, y) -> concat(acc, slice(y,
          1 + coalesce(array_max(filter(sequence(0, least(size(acc), size(y))), k -> k = 0
            or slice(acc, size(acc) - k + 1, k) = slice(y, 1, k))), 0), size(y))))"""
    )


def edit_distance(a, b) -> Column:
    """Levenshtein distance of two token arrays.

    The pair's distinct tokens become one character each and the engine's own
    distance of two texts does the rest; surrogates are left out of the
    characters, so a pair may have 63,000 different tokens.
    """
    a, b = _c(a), _c(b)
    known = F.array_distinct(F.concat(a, b))
    place = lambda x: F.array_position(known, x).cast("int")
    sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(n + F.when(n <= 0xD700, F.lit(255)).otherwise(F.lit(255 + 2048))), 4, "0")), "UTF-16BE")
    as_text = lambda x: F.array_join(F.transform(x, lambda v: sign(place(v))), "")
    return F.levenshtein(as_text(a), as_text(b))


def common_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two token arrays."""
    return F.expr(
        f"""case when size({a}) = 0 or size({b}) = 0 then 0 else
        element_at(aggregate({a}, array_repeat(0, size({b}) + 1), (up, x) ->
          aggregate(sequence(1, size({b})), array(0), (row, j) -> array_append(row,
            if({b}[j - 1] = x, up[j - 1] + 1, greatest(up[j], row[j - 1]))))), -1) end"""
    )


def windows(duration: str, width: int, step: int) -> Column:
    """array<struct<i, s, e>> of windows over 0..duration, the last one clipped; none for durations of 0 or less."""
    return F.expr(
        f"""case when {duration} > 0 then transform(sequence(0, cast(greatest(0, ceil(({duration} - {width}) / {step}.0)) as int)),
        k -> struct(k as i, k * {step} as s, least(k * {step} + {width}, {duration}) as e)) end"""
    )


def ngrams(a, n: int) -> Column:
    a = _c(a)
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n))).otherwise(F.array().cast("array<array<string>>"))


def common_share(a, b) -> Column:
    """Size of the multiset intersection of two lists over that of their union; 1 for equal lists, 0 if one is empty."""
    a, b = _c(a), _c(b)
    times = lambda x, v: F.size(F.filter(x, lambda w: w == v))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, v: s + F.least(times(a, v), times(b, v)))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))
