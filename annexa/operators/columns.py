"""Columns found by name: by prefix, pattern and exclusion, or as pairs; wide tables made long over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what marks the column that explains another.
NOTE_PREFIX = "justification_for_"
#: Names that the explained column may have, by preference.
ANSWER_NAMES = ("{}", "answer_for_{}", "{}_answer")


def columns_like(columns: list[str], prefix: str = "", pattern: str = "", without: tuple[str, ...] = ()) -> list[str]:
    """Names with the prefix, matching the pattern and holding none of ``without``, in table order."""
    return [c for c in columns if c.startswith(prefix) and re.search(pattern, c) and not any(x in c for x in without)]


def column_pairs(columns: list[str], note_prefix: str = NOTE_PREFIX, names: tuple[str, ...] = ANSWER_NAMES, skip: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """(feature, answer column, note column) of every note whose answer is there, in the notes' order."""
    have, out = set(columns) - set(skip), []
    for note in columns_like(columns, note_prefix):
        feature = note[len(note_prefix) :]
        answer = next((n.format(feature) for n in names if n.format(feature) in have), None)
        if feature and answer:
            out.append((feature, answer, note))
    return out


def unpivot_pairs(df: DataFrame, keys: list[str], pairs: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """keys, feature, answer, note: a row per row and pair, in one pass. No pair at all is an error."""
    pairs = column_pairs(df.columns, skip=tuple(keys)) if pairs is None else pairs
    if not pairs:
        raise ValueError("no answer column with a note column")
    text = lambda c: F.col(f"`{c}`").cast("string")
    made = F.array(*[F.struct(F.lit(f).alias("feature"), text(a).alias("answer"), text(n).alias("note")) for f, a, n in pairs])
    return df.select(*keys, F.inline(made))
