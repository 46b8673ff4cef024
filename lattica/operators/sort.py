"""Orders, ranks and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import index_of


def ascending(frame: DataFrame, *keys: str) -> DataFrame:
    return frame.orderBy(*keys)


def with_origin(frame: DataFrame, key: str, rank: str, index: str, out: str = "place") -> DataFrame:
    """Global sort that keeps where each key came from: ``place, key, rank, index``; ties by (rank, index)."""
    return index_of(frame.select(key, rank, index), key, rank, index, out=out)


def top_differences(diffs: DataFrame, size: Column, n: int, *ties: str) -> DataFrame:
    """The n largest by size."""
    return diffs.withColumn("_size", size).orderBy(F.desc("_size"), *ties).limit(n).drop("_size")


def first_errors(errors: DataFrame, n: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first n errors, and their number."""
    return errors.orderBy(*order).limit(n), errors.agg(F.count("*").alias("n_errors"))


def canonical_nodes(nodes: Column) -> Column:
    """Rotate a list so that its least uid is first, and turn it so that the smaller neighbour follows."""
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    n = F.size(nodes)
    turned = F.concat(F.slice(nodes, at, n), F.slice(nodes, F.lit(1), at - 1))
    back = F.concat(F.slice(turned, F.lit(1), F.lit(1)), F.reverse(F.slice(turned, F.lit(2), F.greatest(n - 1, F.lit(1)))))
    return F.when(n < 3, turned).when(F.element_at(turned, 2) <= F.element_at(turned, -1), turned).otherwise(back)


def cuthill_mckee(pairs: DataFrame, reverse: bool = True, most: int = 1_000_000) -> DataFrame:
    """Bandwidth-reducing order ``uid, place`` of a graph that fits the driver (refused beyond ``most`` edges)."""
    n = pairs.count()
    if n > most:
        raise ValueError(f"{n} edges; at most {most} are ordered on the driver")
    near: dict = {}
    for a, b in pairs.select("a", "b").collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order, seen = [], set()
    for start in sorted(near, key=lambda v: (len(near[v]), v)):
        if start in seen:
            continue
        queue = [start]
        seen.add(start)
        for v in queue:
            new = sorted((w for w in near[v] if w not in seen), key=lambda w: (len(near[w]), w))
            seen.update(new)
            queue += new
        order += queue
    if reverse:
        order.reverse()
    return pairs.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], "uid long, place long")
