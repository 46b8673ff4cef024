"""Multi-valued cells: a bridge frame ``(cell, env, mat, value...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def purity(bridge: DataFrame) -> DataFrame:
    """Adds ``env_pure`` (one environment in the cell) and ``mat_pure`` (and one material).

    The counts come from distinct pairs by aggregation and a join, so a cell with very many rows is no single task.
    """
    n = bridge.groupBy("cell").agg(F.countDistinct("env").alias("_e"), F.countDistinct("env", "mat").alias("_m"))
    return bridge.join(n, "cell").withColumns({"env_pure": F.col("_e") == 1, "mat_pure": F.col("_m") == 1}).drop("_e", "_m")


def component(bridge: DataFrame, part: str = "all", env=None, mat=None) -> DataFrame:
    """Rows of a component, whole, ``pure`` or ``impure``."""
    b = purity(bridge)
    if env is not None:
        b = b.filter(F.col("env") == env)
    if mat is not None:
        b = b.filter(F.col("mat") == mat)
    pure = F.col("mat_pure") if mat is not None or env is None else F.col("env_pure")
    return b if part == "all" else b.filter(pure if part == "pure" else ~pure)


def find_component(cells: DataFrame, bridge: DataFrame, env) -> DataFrame:
    """Each cell's row of an environment; nulls where it has none."""
    return cells.join(bridge.filter(F.col("env") == env), "cell", "left")


def fill_partial(bridge: DataFrame, parents: DataFrame, column: str, level: str = "cell") -> DataFrame:
    """Missing partial values take the value of the parent (``cell``, or ``cell`` and ``env``)."""
    keys = ["cell"] if level == "cell" else ["cell", "env"]
    p = parents.select(*keys, F.col(column).alias("_p"))
    return bridge.join(p, keys, "left").withColumn(column, F.coalesce(column, "_p")).drop("_p")


def to_parent(bridge: DataFrame, column: str, how: str = "sum", level: str = "cell") -> DataFrame:
    keys = ["cell"] if level == "cell" else ["cell", "env"]
    return bridge.groupBy(*keys).agg(getattr(F, how)(column).alias(column))


def cell_table(bridge: DataFrame) -> DataFrame:
    """Components of each cell as a sorted list, and their number."""
    return bridge.groupBy("cell").agg(F.array_sort(F.collect_set(F.struct("env", "mat"))).alias("components")).withColumn("n", F.size("components"))


def add_cells(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """Bridge rows for new (cell, env, mat); ones that exist stay."""
    return bridge.unionByName(new.join(bridge.select("cell", "env", "mat"), ["cell", "env", "mat"], "left_anti"), allowMissingColumns=True)


def remove_cells(bridge: DataFrame, gone: DataFrame) -> DataFrame:
    """``gone(cell, mat)``; an environment without materials goes with them."""
    return bridge.join(gone.select("cell", "mat"), ["cell", "mat"], "left_anti")


def backup(bridge: DataFrame, column: str) -> DataFrame:
    return bridge.select("cell", "env", "mat", F.col(column).alias("saved"))


def restore(bridge: DataFrame, saved: DataFrame, column: str, default: float = 0.0) -> DataFrame:
    """Saved values by (cell, env, mat); new rows take the default."""
    return bridge.drop(column).join(saved, ["cell", "env", "mat"], "left").withColumn(column, F.coalesce("saved", F.lit(default))).drop("saved")


def rebuild(groups: DataFrame, materials: DataFrame) -> DataFrame:
    """A bridge from component groups ``(mat, cell)`` and ``materials(mat, env)``."""
    return groups.join(F.broadcast(materials), "mat").select("cell", "env", "mat").distinct()
