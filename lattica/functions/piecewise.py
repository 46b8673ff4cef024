"""Functions of the data set: values given at breakpoints.

A table function is a small frame ``(x, y)``.  It becomes intervals by
``lead`` and meets the data by a range condition; the intervals' number is
checked before they are broadcast, and a large table is bucketed by ``x``
instead, so that the join is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Breakpoints up to which intervals are broadcast.
BROADCAST_POINTS = 10_000


def intervals(table: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``lo, hi, y0, y1``: one row per breakpoint; the first also covers everything before it, the last everything after."""
    from ..operators.relations import index_of

    t = index_of(table.select(F.col(x).cast("double").alias("lo"), F.col(y).alias("y0")), "lo", out="_at")
    after = t.select((F.col("_at") - 1).alias("_at"), F.col("lo").alias("hi"), F.col("y0").alias("y1"))
    t = t.join(after, "_at", "left").withColumn("first", F.col("_at") == 0)
    return t.select("lo", "hi", "y0", F.coalesce("y1", "y0").alias("y1"), "first")


def evaluate(data: DataFrame, table: DataFrame, at: Column, out: str = "value", kind: str = "linear", comul: float = 1.0, comul_x: float = 1.0, shift: Column | float = 0.0, integer: bool = False) -> DataFrame:
    """Adds ``out``: the table at ``(at + shift) / comul_x``, times ``comul``.

    Up to the first breakpoint its value holds, beyond the last the last one's, exactly at a breakpoint that one's;
    between, the left value (``constant``) or the line (``linear``).  Null parameters give null.  Integer tables are
    interpolated in double and cut towards zero.
    """
    if comul_x == 0:
        raise ValueError("comul_x must not be zero")
    n = table.count()
    if not n:
        return data.withColumn(out, F.lit(None).cast("double"))
    steps = intervals(table)
    p = ((at + (shift if isinstance(shift, Column) else F.lit(float(shift)))).cast("double")) / F.lit(float(comul_x))
    d = data.withColumn("_p", p)
    inside = ((F.col("_p") >= F.col("lo")) | F.col("first")) & (F.col("hi").isNull() | (F.col("_p") < F.col("hi")))
    if n <= BROADCAST_POINTS:
        j = d.join(F.broadcast(steps), inside, "left")
    else:  # many breakpoints: both sides by cell of x, an interval in every cell it crosses
        lo, hi = table.agg(F.min("x"), F.max("x")).first()
        cell = lambda c: F.floor((F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))) - lo) / ((hi - lo) / n))
        s = steps.withColumn("_cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.coalesce("hi", F.col("lo"))))))
        j = d.withColumn("_c", cell(F.col("_p"))).join(s, (F.col("_c") == F.col("_cell")) & inside, "left").drop("_c", "_cell")
    y0, y1 = F.col("y0"), F.col("y1")
    if kind == "constant":
        v = y0
    else:
        t = (F.col("_p") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        v = F.when(F.col("hi").isNull() | (F.col("_p") <= F.col("lo")), y0).otherwise(y0 + (y1 - y0) * t)
        if integer:
            v = v.cast("int")
    if comul != 1.0:
        v = v * F.lit(float(comul))
    return j.withColumn(out, v).drop("_p", "lo", "hi", "y0", "y1", "first")


_registry: dict[str, object] = {}


def register(name: str, function) -> None:
    """A user function on columns (or a pandas UDF), to be called by name."""
    _registry[name] = function


def call(name: str, *columns: Column) -> Column:
    if name not in _registry:
        raise KeyError(f"no function named {name}; known: {sorted(_registry)}")
    return _registry[name](*columns)
