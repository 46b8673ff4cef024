"""Ownership of rows: partitioners, replicas, halos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tester_partition(frame: DataFrame, index: str, n_cells: int, n_ranks: int, out: str = "owner") -> DataFrame:
    """``((index * 3 * ranks) / cells) % ranks`` in whole numbers."""
    return frame.withColumn(out, F.floor(F.col(index) * 3 * n_ranks / F.lit(n_cells)) % n_ranks)


def grid_partition(frame: DataFrame, sizes: dict[str, tuple[int, int]], out: str = "owner") -> DataFrame:
    """Blocks over a grid: ``sizes[index column] = (cells, parts)``."""
    owner = F.lit(0).cast("long")
    for c, (cells, parts) in sizes.items():
        owner = owner * parts + F.floor(F.col(c) * parts / F.lit(cells))
    return frame.withColumn(out, owner)


def simple_rows(frame: DataFrame, index: str, n_rows: int, n_parts: int, out: str = "owner") -> DataFrame:
    return frame.withColumn(out, F.floor(F.col(index) * n_parts / F.lit(n_rows)))


def weighted_partition(frame: DataFrame, order: list[str], weight: str, parts: int, out: str = "owner") -> DataFrame:
    """Cut the order into parts of about equal weight: a row goes where its weight's middle falls.

    The running weight is made in two passes, so no task holds the whole order.
    """
    from .scan import global_scan

    total = frame.agg(F.sum(weight).alias("_total"))
    s = global_scan(frame, weight, order, "sum", out="_upto").join(F.broadcast(total))
    middle = (F.col("_upto") - F.col(weight) / 2) * parts / F.col("_total")
    return s.withColumn(out, F.least(F.floor(middle), F.lit(parts - 1))).drop("_upto", "_total")


def constrained(frame: DataFrame, group: str, owner: str = "owner") -> DataFrame:
    """Rows of a constraint group move together to the group's least owner (null groups stay)."""
    least = frame.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(owner).alias("_o"))
    return frame.join(least, group, "left").withColumn(owner, F.coalesce("_o", owner)).drop("_o")


def balance(frame: DataFrame, owner: str = "owner", weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    return frame.groupBy(owner).agg(F.count("*").alias("n"), F.sum(w).alias("weight"))


def scaled_weights(frame: DataFrame, weight: str, top: int, out: str = "scaled") -> DataFrame:
    """Weights as whole numbers of [0, top]."""
    most = frame.agg(F.max(weight).alias("_m"))
    return frame.join(F.broadcast(most)).withColumn(out, F.when(F.col("_m") == 0, 0).otherwise(F.floor(F.col(weight) * top / F.col("_m"))).cast("long")).drop("_m")


def replica_check(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose copies differ: ``n, low, high``."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).filter("n > 1 and low <> high")


def synchronize(frame: DataFrame, uid: str, owner: str, part: str) -> DataFrame:
    """Every copy takes the owner's values: one row per uid, the one whose part is the owner."""
    return frame.filter(F.col(owner) == F.col(part)).dropDuplicates([uid])


def ghost_layer(owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows each part needs from others: ``part, uid, owner``; ``owners(uid, owner)``, ``pairs(a, b)``."""
    a = owners.select(F.col("uid").alias("a"), F.col("owner").alias("part"))
    b = owners.select(F.col("uid").alias("b"), "owner")
    return pairs.join(a, "a").join(b, "b").filter("part <> owner").select("part", F.col("b").alias("uid"), "owner").distinct()


def route(frame: DataFrame, rank: str) -> DataFrame:
    """Rows travel to their rank's partition."""
    return frame.repartition(F.col(rank))


def exchange_items(frame: DataFrame, moves: DataFrame, uid: str = "uid", owner: str = "owner") -> DataFrame:
    """``moves(uid, owner)``: chosen items get a new owner."""
    m = moves.select(uid, F.col(owner).alias("_new"))
    return frame.join(m, uid, "left").withColumn(owner, F.coalesce("_new", owner)).drop("_new")


def by_position(frame: DataFrame, key: str, order: list[str], n: int, out: str = "range") -> DataFrame:
    """Contiguous sub-ranges of n rows."""
    return frame.withColumn(out, F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / n))
