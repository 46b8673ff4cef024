"""Item shapes: faces and edges by type, barycentric centres, isoparametric maps."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Faces of each shape by corner positions, outward (fixed values); plane shapes list their sides.
FACES: dict[str, tuple[tuple[int, ...], ...]] = {
    "line": ((0,), (1,)),
    "triangle": ((0, 1), (1, 2), (2, 0)),
    "quad": ((0, 1), (1, 2), (2, 3), (3, 0)),
    "tetraedron": ((0, 2, 1), (0, 3, 2), (0, 1, 3), (1, 2, 3)),
    "pyramid": ((0, 3, 2, 1), (0, 4, 3), (0, 1, 4), (1, 2, 4), (2, 3, 4)),
    "pentaedron": ((0, 2, 1), (0, 3, 5, 2), (0, 1, 4, 3), (3, 4, 5), (1, 2, 5, 4)),
    "hexaedron": ((0, 3, 2, 1), (0, 4, 7, 3), (0, 1, 5, 4), (4, 5, 6, 7), (1, 2, 6, 5), (3, 7, 6, 2)),
}


def edges_of(shape: str) -> list[tuple[int, int]]:
    """Each edge of a shape once, corners ascending."""
    out = set()
    for f in FACES[shape]:
        ring = f if len(f) > 2 else f[:2]
        pairs = list(zip(ring, ring[1:] + ring[:1], strict=True)) if len(ring) > 2 else ([tuple(ring)] if len(ring) == 2 else [])
        out |= {tuple(sorted(p)) for p in pairs}
    return sorted(out) or [(0, 1)]


def templates(spark: SparkSession) -> DataFrame:
    """``type, face, pos, corner``: a table small enough to broadcast."""
    return spark.createDataFrame([(t, i, k, c) for t, fs in FACES.items() for i, f in enumerate(fs) for k, c in enumerate(f)], "type string, face int, pos int, corner int")


def faces(cells: DataFrame, cell_node: DataFrame) -> DataFrame:
    """``cell, face, nodes``: every face of every cell as a node list in order, from the type's template."""
    t = F.broadcast(templates(cells.sparkSession))  # a fixed table
    e = cells.select(F.col("uid").alias("src"), "type").join(t, "type").join(cell_node.select("src", F.col("pos").alias("corner"), "dst"), ["src", "corner"])
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda p: p["dst"])
    return e.groupBy(F.col("src").alias("cell"), "face").agg(nodes.alias("nodes"))


def unique_faces(cell_faces: DataFrame) -> DataFrame:
    """Faces by their sorted nodes: ``key, back, front`` (front null at the border); back is the cell of smaller uid."""
    k = cell_faces.select("cell", F.array_sort("nodes").alias("key"))
    g = k.groupBy("key").agg(F.min("cell").alias("back"), F.max("cell").alias("front"), F.count("*").alias("n"))
    return g.select("key", "back", F.when(F.col("n") > 1, F.col("front")).alias("front"))


def centres(cell_node: DataFrame, nodes: DataFrame) -> DataFrame:
    """Barycentres ``uid, x, y, z`` of items of any shape."""
    return cell_node.join(nodes.select(F.col("uid").alias("dst"), "x", "y", "z"), "dst").groupBy(F.col("src").alias("uid")).agg(*(F.avg(a).alias(a) for a in "xyz"))


# ------------------------------------------------------------ isoparametric quadrangle and hexahedron

_SIGNS = {4: ((-1, -1), (1, -1), (1, 1), (-1, 1)), 8: ((-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1))}


def position(corners: list[Column], iso: list[Column]) -> list[Column]:
    """Point at iso coordinates in [-1, 1], as a sum of corner weights."""
    signs = _SIGNS[len(corners)]
    dim = len(signs[0])
    weight = [reduce(lambda a, b: a * b, ((1 + s * u) / 2 for s, u in zip(sg, iso, strict=True))) for sg in signs]
    return [reduce(lambda a, b: a + b, (w * p[a] for w, p in zip(weight, corners, strict=True))) for a in "xyz"[:dim]]


def inverse_map(frame: DataFrame, corners: str, point: str, dim: int, out: str = "iso", rounds: int = 25, eps: float = 1e-12) -> DataFrame:
    """Iso coordinates of ``point`` (array) in the cell of ``corners`` (array of arrays) by Newton's method; NaN where it fails."""
    signs = np.array(_SIGNS[4 if dim == 2 else 8], float)

    @F.pandas_udf("array<double>")
    def newton(c: pd.Series, p: pd.Series) -> pd.Series:
        if not len(c):
            return pd.Series([], dtype=object)
        x = np.array([[list(q)[:dim] for q in row] for row in c], float)
        target = np.array([list(q)[:dim] for q in p], float)
        u = np.zeros((len(x), dim))
        for _ in range(rounds):
            f = (1 + signs[None] * u[:, None]) / 2
            w = f.prod(2)
            r = np.einsum("nk,nkd->nd", w, x) - target
            j = np.zeros((len(x), dim, dim))
            for a in range(dim):
                g = np.where(np.arange(dim) == a, signs / 2, f)
                j[:, :, a] = np.einsum("nk,nkd->nd", g.prod(2), x)
            ok = np.abs(np.linalg.det(j)) > 1e-300
            step = np.full_like(u, np.nan)
            step[ok] = np.linalg.solve(j[ok], r[ok][..., None])[..., 0]
            u = u - step
            if not (np.abs(step) > eps).any():
                break
        return pd.Series(list(u))

    return frame.withColumn(out, newton(corners, point))


def gradient(edges: DataFrame, values: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per cell, the least-squares gradient of a node value around the cell's centre: ``uid, gx, gy`` in the plane."""
    j = edges.join(nodes.select(F.col("uid").alias("dst"), "x", "y"), "dst").join(values.select(F.col("uid").alias("dst"), "v"), "dst")
    m = j.groupBy("src").agg(*(F.avg(c).alias(f"m{c}") for c in ("x", "y", "v")), F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "v").alias("xv"), F.covar_pop("y", "v").alias("yv"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return m.select(F.col("src").alias("uid"), F.try_divide(F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), det).alias("gx"), F.try_divide(F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"), det).alias("gy"))
