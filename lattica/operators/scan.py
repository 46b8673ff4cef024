"""Prefix operations and positional access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

_WITH = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def scan(frame: DataFrame, value: Column, order: list[str], keys: list[str], how: str = "sum", init=None, exclusive: bool = False, out: str = "scan") -> DataFrame:
    """Prefix sum, min or max by key in the given order, combined with ``init``; exclusive scans start at ``init`` (null without)."""
    end = -1 if exclusive else Window.currentRow
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    run = getattr(F, how)(value).over(w)
    if init is not None:
        first = F.lit(init)
        run = F.coalesce(_WITH[how](run, first), first) if how == "sum" else F.when(run.isNull(), first).otherwise(_WITH[how](run, first))
    return frame.withColumn(out, run)


def global_scan(frame: DataFrame, value: str, order: list[str], how: str = "sum", init=None, exclusive: bool = False, out: str = "scan") -> DataFrame:
    """The same over one order of all rows, in two passes: within range partitions, then with the partitions' totals before."""
    p = in_ranges(frame, *order)
    totals = p.groupBy("_p").agg(getattr(F, how)(value).alias("_t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = totals.select("_p", getattr(F, how)("_t").over(before).alias("_before"))
    s = scan(p, F.col(value), order, ["_p"], how, None, exclusive, "_own").join(F.broadcast(starts), "_p")
    both = F.when(F.col("_own").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_own")).otherwise(_WITH[how](F.col("_own"), F.col("_before")))
    if init is not None:
        both = F.when(both.isNull(), F.lit(init)).otherwise(_WITH[how](both, F.lit(init)))
    return s.withColumn(out, both).drop("_p", "_own", "_before")


def in_ranges(frame: DataFrame, *order: str) -> DataFrame:
    """``frame`` with ``_p``, the number of its range of the order: as many ranges as shuffle partitions.

    The bounds are quantiles of the first key, found once and then fixed, so a part that is computed again, after an
    executor is lost or by a second reader, falls into the same ranges.  Rows of one first key share a range; where one
    such key is hot, the others' hashes do not help an order, and its rows are one task's.
    """
    n = max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = order[0]
    kind = frame.schema[key].dataType
    if n == 1:
        return frame.withColumn("_p", F.lit(0))
    if isinstance(kind, NumericType):
        number = F.col(key).cast("double")
    elif isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        number = F.unix_timestamp(F.col(key).cast("timestamp")).cast("double")
    else:  # the order of the first six bytes
        number = F.conv(F.rpad(F.hex(F.substring(F.col(key).cast("string").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    bounds = frame.agg(F.percentile_approx(number, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bounds = sorted({b for b in bounds if b == b})
    # null and NaN as in the order: nulls first, NaN last
    place = F.when(number.isNull(), 0).when(F.isnan(number), len(bounds)).otherwise(sum((F.when(number > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0)))
    return frame.withColumn("_p", place.cast("int"))


def neighbours(frame: DataFrame, uid: str, order: list[str], keys: list[str]) -> DataFrame:
    """``previous`` and ``next`` uid along a direction; null at the border."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumns({"previous": F.lag(uid).over(w), "next": F.lead(uid).over(w)})


def last_wins(frame: DataFrame, keys: list[str], seq: str, *values: str) -> DataFrame:
    """Per key the row of the largest ``seq``; partial aggregation, no sort."""
    row = F.max_by(F.struct(*values), seq)
    return frame.groupBy(*keys).agg(row.alias("_row")).select(*keys, *(F.col(f"_row.{v}").alias(v) for v in values))


def zero_fill(history: DataFrame, name: str, iteration: str, value: str) -> DataFrame:
    """A row per name and iteration from the first to the last of all, 0 where nothing was recorded."""
    span = history.agg(F.min(iteration).alias("_lo"), F.max(iteration).alias("_hi"))
    grid = history.select(name).distinct().join(F.broadcast(span)).select(name, F.explode(F.sequence("_lo", "_hi")).alias(iteration))
    return grid.join(history.select(name, iteration, value), [name, iteration], "left").withColumn(value, F.coalesce(value, F.lit(0).cast(history.schema[value].dataType)))


def shrink(history: DataFrame, iteration: str, period: int) -> DataFrame:
    """Only the points of the output period."""
    return history.filter(F.col(iteration) % period == 0)


def transform_curves(history: DataFrame, name: str, function, schema: str) -> DataFrame:
    """A user function on each curve's (iterations, values), one curve in memory at a time."""
    return history.groupBy(name).applyInPandas(function, schema)
