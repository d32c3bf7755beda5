"""Clock text to seconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def mmss(c, minute_limit: bool = True) -> Column:
    """``MM:SS`` with anything after a second colon ignored; null if malformed or out of range."""
    p = F.split(F.trim(_c(c)), ":")
    m, s = (F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2))
    fine = F.size(p).isin(2, 3) & (m >= 0) & (s >= 0) & (s < 60)
    return F.when(fine & (m < 60) if minute_limit else fine, m * 60 + s)


def seconds(c) -> Column:
    """A whole number, ``MM:SS`` or ``H:MM:SS``, without range checks."""
    p = F.split(F.trim(_c(c)), ":")
    n = [F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    return F.when(F.size(p) == 1, F.trim(_c(c)).try_cast("double").cast("int")).when(F.size(p) == 2, n[0] * 60 + n[1]).when(F.size(p) == 3, n[0] * 3600 + n[1] * 60 + n[2])


def _two(x: Column) -> Column:
    return F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))


def to_mmss(c) -> Column:
    s = F.floor(_c(c)).cast("int")
    return F.concat(_two(F.floor(s / 60).cast("int")), F.lit(":"), _two(s % 60))


def found(c) -> Column:
    """The first clock text of a reply, as MM:SS with surplus seconds carried; else N/A."""
    inner = F.coalesce(F.nullif(F.regexp_extract(_c(c), r"\[([^\]]*)\]", 1), F.lit("")), _c(c))
    m, s = (F.regexp_extract(inner, r"(\d{1,2}):(\d\d)(?:\.\d+)?", i).try_cast("int") for i in (1, 2))
    return F.coalesce(to_mmss(m * 60 + s), F.lit("N/A"))


def duration(start, end) -> Column:
    a, b = mmss(start, False), mmss(end, False)
    return F.when(b >= a, to_mmss(b - a)).otherwise("N/A")


def strict(c) -> Column:
    """The first clock text if both parts are at most 59, else N/A; not looked for further."""
    m, s = (F.regexp_extract(_c(c), r"(\d{1,2}):(\d\d)", i).try_cast("int") for i in (1, 2))
    return F.when((m <= 59) & (s <= 59), F.concat(_two(m), F.lit(":"), _two(s))).otherwise("N/A")


def rounded(c) -> Column:
    """Seconds to MM:SS with the seconds rounded half to even; 59.5 and more carry into the minutes. Not a number: N/A."""
    s = F.bround(_c(c).try_cast("double")).try_cast("int")
    return F.coalesce(to_mmss(s), F.lit("N/A"))


def from_frame(c, fps: int = 1) -> Column:
    """A frame number's time; N/A without a whole number."""
    return F.coalesce(to_mmss(F.floor(F.trim(_c(c)).try_cast("int") / fps)), F.lit("N/A"))


def span(c) -> Column:
    """struct<start, end> from the first object of a reply, its clock texts quoted or not; N/A where one is missing."""
    body = F.regexp_extract(_c(c), r"(?s)(\{.*?\})", 1)

    def part(name: str) -> Column:
        raw = F.regexp_extract(body, rf"""["']{name}["']\s*:\s*["']?\s*([0-9:.]+)""", 1)
        plain = F.regexp_replace(raw, r"\.\d+$", "")
        # of H:MM:SS the last two parts count
        return strict(F.regexp_replace(plain, r"^\d{1,2}:(\d\d:\d\d)$", "$1"))

    return F.struct(part("start_time").alias("start"), part("end_time").alias("end"))
