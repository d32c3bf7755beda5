"""Sinks: appended batches, a table replaced as a whole in key order, metrics in one wide row per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_rows(df: DataFrame, path: str) -> None:
    """Adds a batch to a CSV folder. Every part file has its header, so the folder reads as one table; a failed batch leaves nothing."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def merge_first(done: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Rows of both under the union of their columns, one per key: a done row before a new one, then the first by all columns."""
    both = new.withColumn("_late", F.lit(1))
    if done is not None:
        both = done.withColumn("_late", F.lit(0)).unionByName(both, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("_late", key)]
    best = both.groupBy(key).agg(F.min(F.struct("_late", *rest)).alias("_best"))
    return best.select(key, *[F.col("_best")[c].alias(c) for c in rest])


def in_order(df: DataFrame, key: str, order: DataFrame) -> DataFrame:
    """The rows whose key is listed in ``order`` (place, value), sorted by place; other keys go, a key listed twice counts once."""
    places = order.groupBy(F.col("value").alias("_key")).agg(F.min("place").alias("_place"))
    return df.join(places, F.col(key).cast("string") == F.col("_key")).orderBy("_place").drop("_key", "_place")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes CSV beside ``path`` and swaps it in, so that readers meet the old or the new table; ``df`` may read ``path``.

    Of the two renames only the moment between them has no table; after a crash
    there the next call puts the old one back first.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = path.rstrip("/")
    at, fresh, old = (jvm.org.apache.hadoop.fs.Path(base + end) for end in ("", "._new", "._old"))
    fs = at.getFileSystem(conf)
    if not fs.exists(at) and fs.exists(old):
        fs.rename(old, at)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(base + "._new")
    fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old) or not fs.rename(fresh, at):
        raise OSError(f"could not swap in {path}")
    fs.delete(old, True)


def update_table(spark: SparkSession, new: DataFrame, path: str, key: str, order: DataFrame, first: list[str] | None = None) -> None:
    """Merges ``new`` into the table at ``path`` (done rows win), keeps the listed keys in their order and replaces it as a whole.

    Columns: the key, then those of ``first`` that are there, then the rest.
    """
    done = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if _exists(spark, path) else None
    merged = merge_first(done, new.select(*[F.col(c).cast("string").alias(c) for c in new.columns]), key)
    lead = [c for c in first or [] if c in merged.columns and c != key]
    replace_table(in_order(merged.select(key, *lead, *[c for c in merged.columns if c != key and c not in lead]), key, order), path)


def wide_metrics(facts: DataFrame, row: str, feature: str, metric: str, value: str, features: list[str], metrics: list[str], digits: int = 2) -> DataFrame:
    """A row per model with a text column ``<feature>_<metric>`` each, in the lists' order: fixed decimals, blank where not computable.

    The lists fix the columns, so no pass looks for them and missing features still have theirs.
    """

    def cell(f: str, m: str) -> Column:
        number = F.col(value).cast("double")
        hit = F.max(F.when((F.col(feature) == f) & (F.col(metric) == m) & ~F.isnan(number), number))
        return F.when(hit.isNull(), "").otherwise(F.format_string(f"%.{digits}f", hit)).alias(f"{f}_{m}")

    return facts.groupBy(row).agg(*[cell(f, m) for f in features for m in metrics])


def write_unquoted(df: DataFrame, path: str, sep: str = ",") -> None:
    """Lines of bare values, as they stand; a value that holds the separator or a line break fails the write."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    ok = F.assert_true(~F.concat(*cells).rlike(f"[{sep}\\n\\r]"), F.lit("a value needs quotes"))
    head = df.sparkSession.createDataFrame([(sep.join(df.columns), 0)], "value string, _k int")
    body = df.select(F.concat_ws(sep, *cells).alias("value"), F.lit(1).alias("_k"), ok.alias("_ok")).where("_ok IS NULL").drop("_ok")
    head.union(body).select("value").coalesce(1).write.mode("overwrite").text(path)


def write_report(sheets: dict[str, DataFrame], path: str) -> None:
    """A folder per sheet, each a CSV with a header; the summary sheet of a report is one of them."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def write_json_lines(df: DataFrame, path: str, summary: dict[str, object] | None = None) -> None:
    """JSON lines, and beside them a one-row summary: the row count and what is given."""
    df.write.mode("overwrite").json(f"{path}/rows")
    counted = df.sparkSession.read.json(f"{path}/rows", schema=df.schema).agg(F.count("*").alias("rows"))
    counted.select("rows", *(F.lit(v).alias(k) for k, v in (summary or {}).items())).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def copy_subset(tables: dict[str, DataFrame], keys: DataFrame, key: str, path: str) -> None:
    """The rows of every table whose key is listed, each table in a folder of its own."""
    listed = keys.select(key).distinct()
    for name, df in tables.items():
        df.join(listed, key, "left_semi").write.mode("overwrite").parquet(f"{path}/{name}")
