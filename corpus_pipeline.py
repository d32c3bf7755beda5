"""A corpus pipeline of five stages over ``documents``, each built on one operator of annexa.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and is written as Parquet and reread in between. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annexa.llm import jaccard_join, mixing, packing, quality, substring_dedup
from annexa.llm.common import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its chance of being good reaches this.
MIN_QUALITY = 0.3
NO_ID = substring_dedup.NO_ID


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with d and t, by which operators' rows find their document, a missing doc_id included."""
    return docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify_quality(docs.select(COLUMNS), labels).where(F.col("score") >= MIN_QUALITY).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies, and every document without a doc_id."""
    linked = jaccard_join.ngram_jaccard_join(docs, n=5, percent=80)
    gone = linked.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of 20 words or more; a text that loses none stays as it is."""
    kept = substring_dedup.substring_dedup(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("th").alias("t"), "kept_text").where("n_removed > 0").dropDuplicates(["d", "t"])
    text = F.coalesce("kept_text", "text")
    return _keyed(docs).join(kept, ["d", "t"], "left").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; equal rows go by the one taken most often."""
    plan = mixing.mix_sources(docs).where("copies > 0").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("th").alias("t")).agg(F.max("copies").alias("copies"))
    return _keyed(docs).join(plan, ["d", "t"]).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 4096 tokens."""
    return packing.pack_best_fit(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("repeats", drop_repeats), ("mixing", mix), ("packing", pack)]

#: The classifier and the tokenizer cannot be stated in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # any scheme that Spark can write to
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written under spark.checkpoint.dir and reread; a stage's rows go once the next one has its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs
