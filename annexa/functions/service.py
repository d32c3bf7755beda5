"""Calls of an outside service: any callable from text to text, with retries and a fallback, from a bounded number of threads a task."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


def no_service(prompt: str) -> str:
    """The default: answers nothing, so that the fallback holds."""
    return ""


def asked(call: Callable[[str], str], at_once: int = 8, retries: int = 3, wait: float = 0.0):
    """A column function of a prompt column: the reply without outer quotes and with single spaces; empty after the last failure.

    A null or empty prompt is not sent. Equal prompts of a batch are sent once. A task that runs again
    asks again, so the service should answer alike or the result be written once.
    """

    def one(prompt: str) -> str:
        for k in range(retries):
            try:
                return call(prompt) or ""
            except Exception:  # whatever the service's client raises counts as a failed try
                if k + 1 < retries and wait:
                    time.sleep(wait)
        return ""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(at_once) as pool:
            for prompts in batches:
                some = [p for p in prompts.dropna().unique() if p]
                known = dict(zip(some, pool.map(one, some), strict=True))
                yield prompts.map(lambda p, known=known: known.get(p, "") if p else "").astype(object)

    def apply(prompt: Column) -> Column:
        reply = F.regexp_replace(F.trim(run.asNondeterministic()(prompt)), '^[`"“”]+|[`"“”]+$', "")
        return F.trim(F.regexp_replace(reply, r"\s+", " "))

    return apply


def merge_texts(rows: DataFrame, key: str, order: str, text: str, prompt: Callable[[Column], Column], call: Callable[[str], str] = no_service, joint: str = " || ", **how) -> DataFrame:
    """key and one text per key: a single part as it is, several as the service merges them, or joined where it fails.

    Blank parts are left out; a key without any has an empty text. ``prompt`` makes the prompt from the array of
    parts; only keys with several parts are asked about.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: strip(x["t"]))
    grouped = rows.groupBy(key).agg(F.filter(parts, lambda t: t.isNotNull() & (t != "")).alias("parts"))
    reply = asked(call, **how)(F.when(F.size("parts") > 1, prompt(F.col("parts"))))
    grouped = grouped.withColumn("reply", reply)
    joined = F.array_join("parts", joint)
    return grouped.select(key, F.when((F.size("parts") > 1) & (F.col("reply") != ""), F.col("reply")).otherwise(joined).alias(text))
