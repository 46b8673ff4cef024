"""Histories and curves: ``(name, x, y)`` frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def curve(history: DataFrame, times: DataFrame) -> DataFrame:
    """x is the iteration's time: ``name, x, y``."""
    return history.join(times, "iteration").select("name", F.col("time").alias("x"), F.col("value").alias("y"))


def crop(c: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """``low <= x < high``; without limits nothing is cut."""
    if low is not None:
        c = c.filter(F.col("x") >= low)
    if high is not None:
        c = c.filter(F.col("x") < high)
    return c


def smooth(c: DataFrame, n: int, *keys: str) -> DataFrame:
    """Weighted moving mean over n points to the left and n - 1 to the right, weights the mean of the neighbours' x; ends stay."""
    keys = list(keys or ["name"])
    w = Window.partitionBy(*keys).orderBy("x")
    size = c.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = c.withColumns({"_i": F.row_number().over(w) - 1, "_w": (F.lead("x").over(w) + F.lag("x").over(w)) / 2}).join(size, keys)
    inner = (F.col("_i") >= 1) & (F.col("_i") < F.col("_n") - 2)
    # the last point inside the window is the one before min(i + n, n_points - 2)
    d = d.withColumns({"_wy": F.when(inner, F.col("_w") * F.col("y")), "_ww": F.when(inner, F.col("_w"))})
    r = Window.partitionBy(*keys).orderBy("_i").rangeBetween(-n, n - 1)
    mean = F.try_divide(F.sum("_wy").over(r), F.sum("_ww").over(r))
    edge = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)
    return d.withColumn("_y", F.when(edge, F.col("y")).otherwise(F.coalesce(mean, F.lit(float("nan"))))).select(*keys, "x", F.col("_y").alias("y"))


# ------------------------------------------------------------ interpolation (arrays of one curve)


def interpolate(order: int, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """P0 (nearest, ties to the right), P1 (line) or P2 (three points); grid points keep their value, outside is 0."""
    n = len(x)
    at = np.asarray(at, float)
    out = np.zeros(len(at))
    if n == 0:
        return out
    inside = (at >= x[0]) & (at <= x[-1])
    i = np.clip(np.searchsorted(x, at), 0, n - 1)  # first grid point >= at
    exact = inside & (x[i] == at)
    out[exact] = y[i[exact]]
    todo = np.flatnonzero(inside & ~exact)
    if order > 0 and n <= order:
        return out
    i, a = i[todo], at[todo]
    if order == 0:
        out[todo] = np.where(np.abs(a - x[i - 1]) >= np.abs(a - x[i]), y[i], y[i - 1])
    elif order == 1:
        out[todo] = y[i - 1] + (y[i] - y[i - 1]) * (a - x[i - 1]) / (x[i] - x[i - 1])
    else:
        can = (i < n - 1) & (i >= 2)
        right = (i < 2) | (can & (np.abs(a - x[np.maximum(i - 2, 0)]) >= np.abs(a - x[np.minimum(i + 1, n - 1)])))
        right &= i + 1 < n
        p = np.where(right, i - 1, i - 2)
        total = 0.0
        for k in range(3):
            term = y[p + k]
            for m in range(3):
                if m != k:
                    term = term * (a - x[p + m]) / (x[p + k] - x[p + m])
            total = total + term
        out[todo] = total
    return out


def common_grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Later start, inner points of the first grid, earlier end; an empty grid gives the other; no overlap gives none."""
    if not len(a):
        return b
    if not len(b):
        return a
    lo, hi = max(a[0], b[0]), min(a[-1], b[-1])
    if hi < lo:
        return np.zeros(0)
    return np.concatenate([[lo], a[(a > lo) & (a < hi)], [hi]])


def project(rx, ry, tx, ty) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both curves on their common grid, P2 (P1 on two points)."""
    grid = common_grid(common_grid(rx, tx), common_grid(tx, rx))
    order = 1 if len(grid) == 2 else 2
    return grid, interpolate(order, grid, rx, ry), interpolate(order, grid, tx, ty)


# ------------------------------------------------------------ errors


def _relative(grid, r, t, whole):
    e = (t - r) / np.where(r == 0, 1.0, r)
    return e, float(np.abs(e).max(initial=0))


def _relative_max(grid, r, t, whole):
    top = np.abs(whole).max(initial=0)
    e = (t - r) / (top if top else 1.0)
    return e, float(np.abs(e).max(initial=0))


def _max(grid, r, t, whole):
    mr, mt = np.maximum.accumulate(np.abs(r)), np.maximum.accumulate(np.abs(t))
    e = (mt - mr) / (mr[-1] if len(mr) and mr[-1] else 1.0)
    return e, float(abs(e[-1])) if len(e) > 1 else 0.0


def _drbar(grid, r, t, whole):
    e = np.maximum.accumulate(t) - np.maximum.accumulate(r)
    return e, float(abs(e[-1])) if len(e) > 1 else 0.0


def _drift(grid, r, t, whole):
    """Time average of the relative error; the recurrence telescopes to a running sum over time."""
    rel = np.where(r != 0, (t - r) / np.where(r == 0, 1.0, r), 0.0)
    dt = np.diff(grid, prepend=0.0)
    if len(grid) and grid[0] == 0:
        rel[0] = 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.abs(np.where(grid != 0, np.cumsum(dt * rel) / grid, 0.0))
    return e, float(e[-1]) if len(e) > 1 else 0.0


def _chronometry(grid, r, t, whole):
    """Distance of the places of the largest magnitudes; the reference starts from its signed first value."""
    if not len(grid):
        return np.zeros(0), 0.0
    best_r, at_r, best_t, at_t = r[0], grid[0], abs(t[0]), abs(grid[0])
    e = np.zeros(len(grid))
    for i, x in enumerate(grid):
        if abs(r[i]) > best_r:
            best_r, at_r = abs(r[i]), x
        if abs(t[i]) > best_t:
            best_t, at_t = abs(t[i]), x
        e[i] = at_t - at_r
    return e, float(abs(e[-1]))


ERRORS: dict[str, Callable] = {"relative": _relative, "relative_max": _relative_max, "max": _max, "drbar": _drbar, "drift": _drift, "chronometry": _chronometry}


def _pairs(reference: DataFrame, target: DataFrame):
    r = reference.select("name", "x", "y")
    t = target.select("name", "x", "y")
    return r.groupBy("name").cogroup(t.groupBy("name"))


def _sorted(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    f = f.sort_values("x")
    return f.x.to_numpy(float), f.y.to_numpy(float)


def error_curves(reference: DataFrame, target: DataFrame, kind: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """``name, x, error`` on the common grid, for curves of both cases; one pair of curves in memory at a time."""
    f = ERRORS[kind]

    def run(r: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(t):
            return pd.DataFrame({"name": [], "x": [], "error": []})
        (rx, ry), (tx, ty) = _sorted(r), _sorted(t)
        keep = lambda x: (x >= (low if low is not None else -np.inf)) & (x < (high if high is not None else np.inf))
        grid, pr, pt = project(rx[keep(rx)], ry[keep(rx)], tx[keep(tx)], ty[keep(tx)])
        return pd.DataFrame({"name": r.name.iloc[0], "x": grid, "error": f(grid, pr, pt, ry)[0]})

    return _pairs(reference, target).applyInPandas(run, "name string, x double, error double")


def errors(reference: DataFrame, target: DataFrame, kind: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """``name, error``: the scalar of each common curve."""
    f = ERRORS[kind]

    def run(r: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(t):
            return pd.DataFrame({"name": [], "error": []})
        (rx, ry), (tx, ty) = _sorted(r), _sorted(t)
        keep = lambda x: (x >= (low if low is not None else -np.inf)) & (x < (high if high is not None else np.inf))
        grid, pr, pt = project(rx[keep(rx)], ry[keep(rx)], tx[keep(tx)], ty[keep(tx)])
        return pd.DataFrame({"name": [r.name.iloc[0]], "error": [f(grid, pr, pt, ry)[1]]})

    return _pairs(reference, target).applyInPandas(run, "name string, error double")


def projected(reference: DataFrame, target: DataFrame, order: int) -> DataFrame:
    """``name, x, y``: target curves on the reference's grid (within the target's range)."""

    def run(r: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(t):
            return pd.DataFrame({"name": [], "x": [], "y": []})
        (rx, _), (tx, ty) = _sorted(r), _sorted(t)
        at = rx[(rx >= tx[0]) & (rx <= tx[-1])]
        return pd.DataFrame({"name": r.name.iloc[0], "x": at, "y": interpolate(order, at, tx, ty)})

    return _pairs(reference, target).applyInPandas(run, "name string, x double, y double")


def norm_inf(c: DataFrame, *keys: str) -> DataFrame:
    return c.groupBy(*(keys or ("name",))).agg(F.max(F.abs("y")).alias("norm_inf"))


def rename(c: DataFrame, pattern: str, to: str) -> DataFrame:
    return c.withColumn("name", F.regexp_replace("name", pattern, to))


def several(history: DataFrame, values: str, policy: str = "ignore") -> DataFrame:
    """Curves with several values: dropped (``ignore``), or one curve each, named ``name_k`` (``split``)."""
    if policy == "ignore":
        return history.filter(F.size(values) == 1).withColumn("value", F.element_at(values, 1)).drop(values)
    e = history.select(*[c for c in history.columns if c != values], F.posexplode(values).alias("_k", "value"))
    return e.withColumn("name", F.concat_ws("_", "name", "_k")).drop("_k")


def scope_name(name: Column, mesh: Column, sub_domain: Column) -> Column:
    """``Mesh0_SD0_name`` style keys; null scopes are left out."""
    return F.concat_ws("_", mesh, F.when(sub_domain.isNotNull(), F.concat(F.lit("SD"), sub_domain.cast("string"))), name)
