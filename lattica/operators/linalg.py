"""Sparse linear algebra on coordinate frames ``(row, col, value)`` and vectors ``(id, value)``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order up to which systems are solved densely on the driver.
DENSE = 2000


def assemble(entries: DataFrame, how: str = "add", seq: str | None = None) -> DataFrame:
    """``add`` sums the entries of a place, ``set`` takes the last (by ``seq``)."""
    value = F.sum("value") if how == "add" else F.max_by("value", seq)
    return entries.groupBy("row", "col").agg(value.alias("value"))


def assemble_keys(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Entries by (variable, item) keys: ``row_var, row_item, col_var, col_item, value`` with ``index(var, item, id)``."""
    r = index.select(F.col("var").alias("row_var"), F.col("item").alias("row_item"), F.col("id").alias("row"))
    c = index.select(F.col("var").alias("col_var"), F.col("item").alias("col_item"), F.col("id").alias("col"))
    return assemble(entries.join(r, ["row_var", "row_item"]).join(c, ["col_var", "col_item"]).select("row", "col", "value"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def scale(a: DataFrame, k: float) -> DataFrame:
    return a.withColumn("value", F.col("value") * F.lit(float(k)))


def diagonal(a: DataFrame) -> DataFrame:
    return a.filter("row = col").select(F.col("row").alias("id"), "value")


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """``A x``: one join on the column, one aggregation by row."""
    v = x.select(F.col("id").alias("col"), F.col("value").alias("_x"))
    return a.join(v, "col").groupBy(F.col("row").alias("id")).agg(F.sum(F.col("value") * F.col("_x")).alias("value"))


def combine(alpha: float, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    """``alpha x + beta y``; a missing entry is zero."""
    both = x.select("id", (F.col("value") * F.lit(float(alpha))).alias("value")).unionByName(y.select("id", (F.col("value") * F.lit(float(beta))).alias("value")))
    return both.groupBy("id").agg(F.sum("value").alias("value"))


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    return combine(alpha, x, 1.0, y)


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    return combine(1.0, b, -1.0, spmv(a, x))


def pointwise(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.select("id", F.col("value").alias("_y")), "id").select("id", (F.col("value") * F.col("_y")).alias("value"))


def reciprocal(x: DataFrame) -> DataFrame:
    """1/x; null at zero."""
    return x.select("id", F.try_divide(F.lit(1.0), F.col("value")).alias("value"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    return pointwise(x, y).agg(F.sum("value").alias("dot"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse times sparse: join on the inner index, sum by place."""
    r = b.select(F.col("row").alias("col"), F.col("col").alias("_j"), F.col("value").alias("_b"))
    return a.join(r, "col").groupBy("row", F.col("_j").alias("col")).agg(F.sum(F.col("value") * F.col("_b")).alias("value"))


def block_spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """Blocks ``value: array<array<double>>`` times block vectors ``value: array<double>``."""
    v = x.select(F.col("id").alias("col"), F.col("value").alias("_x"))
    rows = F.transform("value", lambda r: F.aggregate(F.zip_with(r, F.col("_x"), lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t))
    e = a.join(v, "col").select(F.col("row").alias("id"), F.posexplode(rows).alias("k", "v"))
    part = e.groupBy("id", "k").agg(F.sum("v").alias("v"))
    return part.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("value"))


# ------------------------------------------------------------ solvers


def _dense(a: DataFrame, b: DataFrame) -> tuple[np.ndarray, np.ndarray, list]:
    rows = b.collect()
    if len(rows) > DENSE:
        raise ValueError(f"order {len(rows)}: dense solvers take at most {DENSE}")
    ids = sorted(r["id"] for r in rows)
    at = {v: i for i, v in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for r in a.collect():
        m[at[r["row"]], at[r["col"]]] += r["value"]
    return m, np.array([{r["id"]: r["value"] for r in rows}[i] for i in ids], float), ids


def solve_dense(a: DataFrame, b: DataFrame) -> DataFrame:
    """Direct solution of a small system."""
    m, v, ids = _dense(a, b)
    x = np.linalg.solve(m, v)
    return b.sparkSession.createDataFrame([(i, float(c)) for i, c in zip(ids, x, strict=True)], b.select("id", "value").schema)


def inverse_dense(a: DataFrame, ids: DataFrame) -> DataFrame:
    m, _, names = _dense(a, ids.select("id", F.lit(0.0).alias("value")))
    inv = np.linalg.inv(m)
    return a.sparkSession.createDataFrame([(r, c, float(inv[i, j])) for i, r in enumerate(names) for j, c in enumerate(names)], "row long, col long, value double")


def _keep(df: DataFrame) -> DataFrame:
    from .graph import _cut

    return _cut(df)


def _number(df: DataFrame) -> float:
    return float(df.first()[0] or 0.0)


def conjugate_gradient(a: DataFrame, b: DataFrame, eps: float = 1e-10, most: int = 200, jacobi: bool = True) -> tuple[DataFrame, int, float]:
    """Preconditioned CG for symmetric positive definite systems: solution, steps, last residual norm over |b|."""
    a = a.cache()
    inv = reciprocal(diagonal(a)).cache() if jacobi else None
    pre = (lambda r: pointwise(r, inv)) if jacobi else (lambda r: r)
    size = _number(dot(b, b)) ** 0.5 or 1.0
    x, r = combine(0.0, b, 0.0, b), _keep(b.select("id", "value"))
    p = z = _keep(pre(r))
    rz, norm, n = _number(dot(r, z)), 1.0, 0
    while n < most and rz:
        q = _keep(spmv(a, p))
        alpha = rz / _number(dot(p, q))
        x, r = _keep(axpy(alpha, p, x)), _keep(axpy(-alpha, q, r))
        n += 1
        norm = _number(dot(r, r)) ** 0.5 / size
        if norm < eps:
            break
        z = _keep(pre(r))
        new = _number(dot(r, z))
        p, rz = _keep(axpy(new / rz, p, z)), new
    return x, n, norm


def bicgstab(a: DataFrame, b: DataFrame, eps: float = 1e-10, most: int = 200) -> tuple[DataFrame, int, float]:
    """For systems that are not symmetric."""
    a = a.cache()
    size = _number(dot(b, b)) ** 0.5 or 1.0
    x, r = combine(0.0, b, 0.0, b), _keep(b.select("id", "value"))
    shadow, p, rho, norm, n = r, r, _number(dot(r, r)), 1.0, 0
    while n < most and rho:
        v = _keep(spmv(a, p))
        alpha = rho / _number(dot(shadow, v))
        s = _keep(axpy(-alpha, v, r))
        t = _keep(spmv(a, s))
        tt = _number(dot(t, t))
        omega = _number(dot(t, s)) / tt if tt else 0.0
        x, r = _keep(axpy(omega, s, axpy(alpha, p, x))), _keep(axpy(-omega, t, s))
        n += 1
        norm = _number(dot(r, r)) ** 0.5 / size
        if norm < eps or not omega:
            break
        new = _number(dot(shadow, r))
        p, rho = _keep(axpy(new / rho * alpha / omega, axpy(-omega, v, p), r)), new
    return x, n, norm


def richardson(a: DataFrame, b: DataFrame, damping: float = 0.8, eps: float = 1e-8, most: int = 200, x0: DataFrame | None = None) -> tuple[DataFrame, int, float]:
    """Damped Jacobi iterations."""
    a = a.cache()
    inv = reciprocal(diagonal(a)).cache()
    size = _number(dot(b, b)) ** 0.5 or 1.0
    x, n, norm = x0 if x0 is not None else combine(0.0, b, 0.0, b), 0, 1.0
    while n < most:
        r = _keep(residual(a, x, b))
        norm = _number(dot(r, r)) ** 0.5 / size
        if norm < eps:
            break
        x = _keep(axpy(damping, pointwise(r, inv), x))
        n += 1
    return x, n, norm


def preonly(a: DataFrame, b: DataFrame) -> tuple[DataFrame, int, float]:
    """The preconditioner alone."""
    return pointwise(b, reciprocal(diagonal(a))), 1, float("nan")


SOLVERS: dict[str, Callable] = {"cg": conjugate_gradient, "bicgstab": bicgstab, "richardson": richardson, "preonly": preonly}
