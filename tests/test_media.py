"""Rows whose media exist: more rows than one task holds, copies, missing lists and odd turns."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from annexa.operators import filters
from annexa.plans import catalog, preparation


def test_media_of_grouped_rows(spark):
    """The rows come from an aggregate, whose order of rows depends on the columns that are wanted."""
    pairs = spark.range(12000).select((F.col("id") % 4000).alias("k"), F.concat(F.lit("f"), (F.col("id") % 4001).cast("string")).alias("m"))
    rows = pairs.groupBy("k").agg(F.collect_list("m").alias("media"))
    files = spark.range(4001).where("id % 5 <> 0").select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    has = {}
    for i in range(12000):
        has[i % 4000] = has.get(i % 4000, True) and i % 4001 % 5 != 0
    want = [k for k, ok in has.items() if ok]
    assert 1000 < len(want) < 3000
    assert sorted(r["k"] for r in filters.with_media(rows, "media", files).select("k").collect()) == want


def test_media_of_copies_and_missing_lists(spark):
    rows = [(1, ["a", "b"]), (1, ["a", "b"]), (2, ["b", "a", "a"]), (3, ["a", "x"]), (3, ["x", "a"]), (4, ["a", None]), (5, []), (6, None), (None, ["b"])]
    files = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "path string")
    got = filters.with_media(spark.createDataFrame(rows, "k int, media array<string>"), "media", files)
    assert got.columns == ["k", "media"]
    want = [r for r in rows if r[0] not in (3, 4)]
    assert Counter(map(repr, map(tuple, got.collect()))) == Counter(map(repr, want))


def test_media_exists_as_its_sql(spark, tmp_path):
    odd = [(-1, None), (-2, None), (-2, 3), (-3, -1), (-4, -7), (-4, 5), (-5, 12), (-6, 11), (-7, 6), (-8, None), (-8, 13), (None, 1), (None, 2)]
    turns = [(c, t) for c in range(3000) for t in range(1 + c * 7919 % 9)] + odd
    spark.createDataFrame(turns, "conv_id long, turn long").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = Counter(r[0] for r in db.sql(catalog.ORACLE_SQL["media_exists"]).fetchall())
    assert {-2, -3, -4, -6, None} <= set(want) and not {-1, -5, -7, -8} & set(want)
    assert Counter(r["conv_id"] for r in preparation.media_exists(spark, str(tmp_path)).collect()) == want
