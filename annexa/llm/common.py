"""Plumbing that the operators share: durable cut points and connected components."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark 4.1's switch for dropping an execution's shuffle files when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set and Spark is one process (tests)."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        have = tempfile.mkdtemp(prefix="annexa-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(have)
    return sc.getCheckpointDir() or have


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, the shuffle files of an execution go when it ends, so that the disk holds one step at a time."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    Lost executors do not matter after this: the rows are reread, not
    recomputed. The shuffles behind the cut are dropped at once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a DataFrame takes the switch when it is made


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as longs ``(a, b)``.

    Returns ``node, component`` (smallest node reachable) for every node with
    an edge to another. Each round hooks every node to its smallest
    neighbour, jumps pointers twice and contracts the graph, until no edge
    is left: every round takes nodes away, four at least from a path whose
    numbers ascend (so its rounds are a quarter of its length). Only aggregates with map-side combine and equi
    joins run, hence a hub holding most edges is split like any skewed join.
    Null ends and loops are ignored; an empty graph gives an empty table.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total = None
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("parent"))
        for _ in range(2):
            far = up.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            up = up.join(far, "parent").select("node", F.col("grand").alias("parent"))
        up = cut(up)
        pa = up.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = up.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        e = cut(
            e.join(pa, "a").join(pb, "b").where("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        )
        if total is None:
            total = up.select("node", F.col("parent").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), "parent")
            total = cut(total.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
    if total is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return total
