"""Reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_reduce(frame: DataFrame, column: str, *keys: str) -> DataFrame:
    """Minimum, maximum and sum in one pass."""
    return frame.groupBy(*keys).agg(F.min(column).alias("min"), F.max(column).alias("max"), F.sum(column).alias("sum"))


def min_max_sum(frame: DataFrame, value: str, rank: str) -> DataFrame:
    """Minimum, maximum, sum over ranks' sums, and the least rank that holds the minimum and the maximum."""
    per = frame.groupBy(rank).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(value).alias("_s"))
    return per.agg(
        F.min("_lo").alias("min"),
        F.max("_hi").alias("max"),
        F.sum("_s").alias("sum"),
        F.min(F.struct("_lo", rank))[rank].alias("min_rank"),
        F.min(F.struct(-F.col("_hi"), F.col(rank).alias("r")))["r"].alias("max_rank"),
    )


def reduce_arrays(frame: DataFrame, column: str, how: str = "sum") -> DataFrame:
    """Elementwise over rows: ``pos, value``."""
    return frame.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(getattr(F, how)("v").alias("value"))


def strict_sum(frame: DataFrame, value: str, *keys: str, blocks: int = 64) -> DataFrame:
    """A sum that does not depend on the partitioning.

    Values are summed exactly as decimals of 18 places after the point, which any order of additions leaves alike, and
    then rounded to a double once; infinities and NaN make the sum NaN.
    """
    v = F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    total = F.sum(F.when(~odd, v.cast("decimal(38,18)")))
    return frame.groupBy(*keys).agg(F.when(F.max(odd.cast("int")) == 1, F.lit(float("nan"))).otherwise(total.cast("double")).alias("strict_sum"))


def sorted_sum(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """All values of a key ascending, added one after the other; for keys of bounded size."""
    s = F.aggregate(F.array_sort(F.collect_list(F.col(value).cast("double"))), F.lit(0.0), lambda a, b: a + b)
    return frame.groupBy(*keys).agg(s.alias("sorted_sum"))


def clamped_step(frame: DataFrame, size: Column, speed: Column, cfl: float, low: float, high: float) -> DataFrame:
    """Global time step: cfl times the least size/speed, kept within [low, high]."""
    return frame.agg(F.least(F.greatest(F.min(F.try_divide(size, speed)) * cfl, F.lit(float(low))), F.lit(float(high))).alias("dt"))


def convergence(new: DataFrame, old: DataFrame, uid: str, column: str) -> DataFrame:
    """Largest absolute change."""
    o = old.select(uid, F.col(column).alias("_old"))
    return new.join(o, uid).agg(F.max(F.abs(F.col(column) - F.col("_old"))).alias("max_change"))


def imbalance(frame: DataFrame, part: str, cost: str) -> DataFrame:
    """``(max - min) / min`` of the parts' costs."""
    per = frame.groupBy(part).agg(F.sum(cost).alias("_c"))
    return per.agg(F.try_divide(F.max("_c") - F.min("_c"), F.min("_c")).alias("imbalance"))


def variable_hash(frame: DataFrame, uid: str, column: str, digits: int = 6, block: int = 1 << 16) -> DataFrame:
    """Digest of the values in order of uid: blocks of uids are digested by themselves, then the digests in order."""
    row = F.struct(F.col(uid).alias("k"), F.format_string(f"%.{digits}f", F.col(column).cast("double")).alias("v"))
    b = frame.groupBy(F.floor(F.col(uid) / block).alias("_b")).agg(F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]))).alias("_h"))
    return b.agg(F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"]))).alias("hash"))


def mesh_statistics(items: DataFrame, kind: str, shape: str) -> DataFrame:
    """Counts by kind and shape with totals (null stands for all)."""
    return items.cube(kind, shape).agg(F.count("*").alias("n"))


def norms(frame: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    return frame.agg(F.sum((v != 0).cast("long")).alias("norm0"), F.sum(F.abs(v)).alias("norm1"), F.sqrt(F.sum(v * v)).alias("norm2"), F.max(F.abs(v)).alias("norm_inf"))


def timing(frame: DataFrame, phase: str, action: str, seconds: str) -> DataFrame:
    return frame.groupBy(phase, action).agg(F.count("*").alias("calls"), F.sum(seconds).alias("seconds"))


def plane_normal(points: DataFrame, uid: str = "uid") -> DataFrame:
    """Barycentre and the normalised normal of a face group: sum of the faces' area vectors ``nx, ny, nz``."""
    s = points.agg(*(F.avg(c).alias(c) for c in ("cx", "cy", "cz")), *(F.sum(c).alias(c) for c in ("nx", "ny", "nz")))
    n = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return s.withColumns({c: F.when(n == 0, F.col(c)).otherwise(F.col(c) / n) for c in ("nx", "ny", "nz")})


def running(frame: DataFrame, value: str, order: list[str], keys: list[str], how: str = "max", out: str = "running") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.withColumn(out, getattr(F, how)(value).over(w))
