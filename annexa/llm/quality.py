"""Compression classifier for text quality (operator 8).

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is compressed whole, block by block, once with either; the
normalised size difference ``(bad - good) / (bad + good)`` says which it is
more like, and a logistic curve fitted on other labelled texts turns it into a
probability. Only the text decides.

Bounds: the dictionaries use ``sample`` labelled texts a class and the curve
``sample`` more, chosen by hash among all labelled rows that may be learnt from.
Of the texts for the dictionaries the driver gathers SLICES slices of SLICE
characters each at most, spread over the whole text; the curve's texts are
compressed whole by the executors, and one number each comes back. So what the
driver holds is bounded whatever the corpus and the length of its texts. The
class shares that set the curve's level are counted over all labels. Scoring
reads every text whole.

Cases: null and empty texts score the class share; labels that are null or
contradict one another for one doc_id are left out; where one class has no
usable label, or none with a text, every score is the class share (0.5 without labels); with texts
too few to train on, their own bytes are the dictionary; repeated
rows score alike; other columns pass through unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK = 1024
SLICE = 2048
SLICES = 8


def held_out(c="doc_id"):
    return F.crc32(F.col(c).cast("string")) % 5 == 0


def _coders(good: bytes, bad: bytes, level: int):
    kinds = zstandard.DICT_TYPE_AUTO  # trained, or plain content: no UTF-8 text starts like a trained one
    return [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kinds), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]


def contrast(text: bytes, coders) -> float:
    """(bad - good) / (bad + good) of the sizes, over blocks of the whole text; 0 for none."""
    size = [0, 0]
    for k in range(0, len(text), BLOCK):
        part = text[k : k + BLOCK]
        for i, c in enumerate(coders):
            size[i] += len(c.compress(part))
    return (size[1] - size[0]) / (size[0] + size[1]) if text else 0.0


def _dictionary(parts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, parts, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their own bytes serve as content
        return b"".join(parts)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and level by Newton steps, with a light ridge."""
    X, b = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ b, -30, 30)))
        g = X.T @ (w * (y - p)) - 1e-3 * b
        h = (X * (w * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def _sampled(docs: DataFrame, known: DataFrame, sample: int) -> DataFrame:
    """quality, text, rank: 2 * sample labelled texts a class at most, in order of a hash; a class's lone text as its two halves."""
    picked = None
    for q in (0, 1):  # the same number of rows for any corpus
        some = known.where(F.col("quality") == q).orderBy(F.xxhash64(F.lit(8), "doc_id"), "doc_id").limit(2 * sample)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''")
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    of_class = Window.partitionBy("quality")
    rows = rows.withColumn("rank", F.row_number().over(of_class.orderBy(F.xxhash64(F.lit(8), "doc_id"), "doc_id"))).withColumn("n", F.count("*").over(of_class))
    half = F.ceil(F.length("text") / 2).cast("int")
    halves = F.array(F.substr("text", F.lit(1), half), F.coalesce(F.nullif(F.substr("text", half + 1), F.lit("")), F.col("text")))
    lone = rows.where("n = 1").select("quality", F.posexplode(halves).alias("rank", "text")).select("quality", "text", F.col("rank") + 1)
    return cut(rows.where("n > 1").select("quality", "text", "rank").union(lone))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1000, dict_size: int = 393_216, level: int = 3) -> dict:
    """The model: both dictionaries, slope, level and class share."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).where("quality = q").drop("q")
    n = {int(r["quality"]): int(r["n"]) for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    rows = _sampled(docs, known, sample)
    model = {"share": share, "level": level, "good": b"", "bad": b"", "slope": 0.0, "base": math.log(share / (1 - share))}
    some = F.least(F.lit(SLICES), F.ceil(F.length("text") / SLICE)).cast("int")
    slices = F.transform(F.sequence(F.lit(0), some - 1), lambda i: F.substr("text", F.floor(i * F.length("text").cast("long") / some).cast("int") + 1, F.lit(SLICE)))
    parts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.where("rank % 2 = 1").select("quality", "rank", slices.alias("s")).orderBy("quality", "rank").collect():
        parts[r["quality"]] += [x.encode() for x in r["s"]]
    if not parts[0] or not parts[1]:
        return model
    bad, good = (_dictionary(parts[q], dict_size) for q in (0, 1))
    model |= {"good": good, "bad": bad}

    def contrasts(batches):
        coders = _coders(good, bad, level)
        for rb in batches:
            x = [contrast(t.encode(), coders) for t in rb.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("quality").cast(pa.int32()), rb.column("rank").cast(pa.int32()), pa.array(x, pa.float64())], ["quality", "rank", "x"])

    # two numbers a row, and 2 * sample rows
    seen = rows.where("rank % 2 = 0").select("quality", "rank", "text").mapInArrow(contrasts, "quality int, rank int, x double").orderBy("quality", "rank").collect()
    x, y = np.array([r["x"] for r in seen]), np.array([r["quality"] for r in seen], float)
    w = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    model["slope"], model["base"] = _logistic(x, y, w)
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column score, the chance of quality 1."""
    names = [c for c in docs.columns if c != "score"]

    def run(rows):
        coders = _coders(model["good"], model["bad"], model["level"]) if model["good"] else None
        empty = 1 / (1 + math.exp(-math.log(model["share"] / (1 - model["share"]))))
        for rb in rows:
            out = []
            for t in rb.column(rb.schema.get_field_index("text")).to_pylist():
                if not t or coders is None:
                    out.append(empty)
                else:
                    z = model["slope"] * contrast(t.encode(), coders) + model["base"]
                    out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(out, pa.float64())], [*names, "score"])

    chosen = docs.select(*names)
    from pyspark.sql.types import DoubleType, StructType

    return chosen.mapInArrow(run, StructType([*chosen.schema.fields]).add("score", DoubleType()))


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = 1000) -> DataFrame:
    """``docs`` with a column score."""
    return score(docs, fit(docs, labels, sample))
