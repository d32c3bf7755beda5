"""Nested training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chats(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, messages: array<struct<role, content>> in order, messages without role or text left out."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("role"), F.col("text").alias("content"))))
    good = F.filter(listed, lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    return rows.groupBy(*keys).agg(F.transform(good, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")).where(F.size("messages") > 0)


def solution(messages: str) -> Column:
    """The first assistant message's text."""
    return F.get(F.filter(messages, lambda m: m["role"] == "assistant"), 0)["content"]


def with_media_tokens(messages: str, n_media: Column, token: str = "<video>") -> Column:
    """Tops up the media tokens in the last user message to the number of media."""
    is_user = F.transform(messages, lambda m, i: F.when(m["role"] == "user", i).otherwise(-1))
    last = F.array_max(is_user)
    have = F.aggregate(messages, F.lit(0), lambda s, m: s + F.regexp_count(m["content"], F.lit(token)))
    more = F.repeat(F.lit(token), F.greatest(F.lit(0), n_media - have))
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, F.concat(more, m["content"])).otherwise(m["content"]).alias("content")))


def feature_samples(df: DataFrame, file: str, features: dict[str, str], folder: str, system: str, prompt: str) -> DataFrame:
    """A training sample per row and answered feature: patient_id, video_id, feature, messages, videos.

    features: feature column -> folder of its media. Blank file names and
    answers of N/A (or null) give no sample. prompt holds {} for the feature.
    """
    name = F.trim(file)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(d).alias("folder"), F.trim(F.col(f).cast("string")).alias("answer"), F.lit(prompt.format(f)).alias("prompt")) for f, d in features.items())))
    rows = df.where(F.coalesce(name, F.lit("")) != "").select(name.alias("file"), each.alias("x")).where("x.answer IS NOT NULL AND x.answer <> 'N/A'")
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select(
        F.split_part("file", F.lit("@"), F.lit(1)).alias("patient_id"), F.regexp_replace("file", r"(?<=.)\.[^./]*$", "").alias("video_id"), "x.feature",
        F.array(said("system", F.lit(system)), said("user", F.col("x.prompt")), said("assistant", F.col("x.answer"))).alias("messages"),
        F.array(F.concat_ws("/", F.lit(folder), F.col("x.folder"), F.col("file"))).alias("videos"),
    )


def media_list(c: str, kind: str) -> Column:
    """Media as a list of paths: none for null, one for a text, and blanks dropped from a list. kind: the column's type."""
    x = F.col(c) if kind.startswith("array") else F.array(F.col(c))
    return F.coalesce(F.filter(x, lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""), F.array().cast("array<string>"))


def with_system(messages: str, text: str) -> Column:
    """The messages with every system message's text replaced."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "system", F.lit(text)).otherwise(m["content"]).alias("content")))
