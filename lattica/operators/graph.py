"""Directed graphs as edge frames ``(src, dst)``; iterative, one join a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage where the session has a checkpoint folder; else keep the plan in the cache."""
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.cache()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("uid")).union(edges.select("dst")).distinct()


def levels(edges: DataFrame) -> DataFrame:
    """``uid, level``: longest path from a source; a cycle is an error.

    Each round drops the vertices without incoming edges, so there are as many rounds as levels.
    """
    left = _cut(edges.select("src", "dst").distinct())
    out, every, level = None, vertices(left), 0
    while True:
        held = left.select(F.col("dst").alias("uid")).distinct()
        ready = _cut(every.join(held, "uid", "left_anti").withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            if every.limit(1).count():
                raise ValueError("the graph has a cycle")
            return out if out is not None else ready
        out = ready if out is None else out.unionByName(ready)
        gone = ready.select("uid")
        every = _cut(every.join(gone, "uid", "left_anti"))
        left = _cut(left.join(gone.withColumnRenamed("uid", "src"), "src", "left_anti"))
        level += 1


def topological_order(edges: DataFrame) -> DataFrame:
    return levels(edges).orderBy("level", "uid")


def has_cycle(edges: DataFrame) -> bool:
    try:
        levels(edges)
    except ValueError:
        return True
    return False


def spanning_tree(edges: DataFrame) -> DataFrame:
    """For each vertex that is no source the incoming edge from the least vertex of the level before: ``src, dst``."""
    lv = levels(edges)
    e = edges.select("src", "dst").distinct()
    j = e.join(lv.select(F.col("uid").alias("src"), F.col("level").alias("ls")), "src").join(lv.select(F.col("uid").alias("dst"), F.col("level").alias("ld")), "dst")
    return j.filter("ld = ls + 1").groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All ``(seed, uid)`` along any number of edges (a dependency dump)."""
    found = _cut(seeds.select(F.col("uid").alias("seed"), "uid").distinct())
    front = found
    while True:
        step = front.join(edges.select(F.col("src").alias("uid"), "dst"), "uid").select("seed", F.col("dst").alias("uid")).distinct()
        front = _cut(step.join(found, ["seed", "uid"], "left_anti"))
        if not front.limit(1).count():
            return found
        found = _cut(found.unionByName(front))


def degrees(edges: DataFrame) -> DataFrame:
    o = edges.groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("n_out"))
    i = edges.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("n_in"))
    return o.join(i, "uid", "full_outer").select("uid", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
