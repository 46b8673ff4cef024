"""Cartesian refinement: zones, patches, coarsening."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_zone(position: tuple[float, ...], length: tuple[float, ...], centre: tuple[str, ...]) -> Column:
    """Centre strictly inside the open box (as many axes as given)."""
    test = F.lit(True)
    for c, p, n in zip(centre, position, length, strict=False):
        test = test & (F.col(c) > p) & (F.col(c) < p + n)
    return test


def refine_zone(cells: DataFrame, position: tuple[float, ...], length: tuple[float, ...], dim: int = 2) -> DataFrame:
    """Active cells ``(i, j[, k], level, active, size..., cx, cy[, cz])`` of the zone get 2**dim children at half the size."""
    axes = "xyz"[:dim]
    idx = "ijk"[:dim]
    hit = F.col("active") & in_zone(position, length, tuple(f"c{a}" for a in axes))
    stay = cells.withColumn("active", F.col("active") & ~hit)
    born = cells.filter(hit)
    for a, i in zip(axes, idx, strict=True):
        born = born.withColumn("_d", F.explode(F.array(F.lit(0), F.lit(1))))
        born = born.withColumns({i: F.col(i) * 2 + F.col("_d"), f"c{a}": F.col(f"c{a}") + (F.col("_d") - 0.5) * F.col(f"h{a}") / 2, f"h{a}": F.col(f"h{a}") / 2}).drop("_d")
    return stay.unionByName(born.withColumn("level", F.col("level") + 1))


def coarsen_grid(cells: DataFrame, value: str, how: str = "avg", dim: int = 2) -> DataFrame:
    """2x2(x2) cells to one: ``I, J[, K], value, n``."""
    keys = [F.floor(F.col(c) / 2).cast("long").alias(c.upper()) for c in "ijk"[:dim]]
    return cells.groupBy(*keys).agg(getattr(F, how)(value).alias(value), F.count("*").alias("n"))


def patches(flagged: DataFrame, efficiency: float = 0.7, least: int = 2, most: int = 2_000_000) -> list[tuple[int, int, int, int]]:
    """Boxes ``(i0, j0, i1, j1)`` (ends excluded) that cover the flagged cells ``(i, j)`` of a plane.

    The flags are counted per cell in Spark; the cutting works on signatures (counts per row and column): a box that
    is less than ``efficiency`` full is cut at an empty line, else where the second difference of a signature changes
    sign most, else in the middle.
    """
    n = flagged.select("i", "j").distinct()
    if n.count() > most:
        raise ValueError(f"more than {most} flagged cells; aggregate them to coarser cells first")
    p = np.array([(r.i, r.j) for r in n.collect()], dtype=np.int64).reshape(-1, 2)
    out, todo = [], [p] if len(p) else []
    while todo:
        q = todo.pop()
        lo, hi = q.min(0), q.max(0) + 1
        size = hi - lo
        if len(q) >= efficiency * size.prod() or (size < 2 * least).all():
            out.append((int(lo[0]), int(lo[1]), int(hi[0]), int(hi[1])))
            continue
        best = None
        for axis in (0, 1):
            sig = np.bincount(q[:, axis] - lo[axis], minlength=size[axis])
            empty = np.flatnonzero(sig == 0)
            if len(empty):
                best = (float("inf"), axis, int(lo[axis] + empty[np.argmin(np.abs(empty - size[axis] / 2))]))
                break
            if size[axis] >= 2 * least:
                second = np.diff(sig, 2)
                jump = np.abs(np.diff(second)) * (np.sign(second[1:]) != np.sign(second[:-1]))
                ok = jump[least - 2 if least > 2 else 0 : size[axis] - least - 1]
                cut = (int(np.argmax(ok)) + 2, float(ok.max())) if len(ok) and ok.max() > 0 else (size[axis] // 2, 0.0)
                if best is None or cut[1] > best[0]:
                    best = (cut[1], axis, int(lo[axis] + cut[0]))
        if best is None:
            out.append((int(lo[0]), int(lo[1]), int(hi[0]), int(hi[1])))
            continue
        side = q[:, best[1]] < best[2]
        todo += [q[side], q[~side]] if side.any() and not side.all() else []
        if side.all() or not side.any():
            out.append((int(lo[0]), int(lo[1]), int(hi[0]), int(hi[1])))
    return sorted(out)


def merge_patches(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Join boxes whose union is a box, until none is left."""
    boxes, again = list(boxes), True
    while again:
        again = False
        for a in range(len(boxes)):
            for b in range(a):
                p, q = boxes[a], boxes[b]
                u = (min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3]))
                area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
                if area(u) == area(p) + area(q):
                    boxes[a] = u
                    del boxes[b]
                    again = True
                    break
            if again:
                break
    return sorted(boxes)


def overlap_layer(cells: DataFrame, box: tuple[int, int, int, int], layers: int) -> DataFrame:
    """Cells within ``layers`` of a box: ``in_patch`` and ``overlap``."""
    i, j = F.col("i"), F.col("j")
    inside = (i >= box[0]) & (i < box[2]) & (j >= box[1]) & (j < box[3])
    near = (i >= box[0] - layers) & (i < box[2] + layers) & (j >= box[1] - layers) & (j < box[3] + layers)
    return cells.filter(near).withColumns({"in_patch": inside, "overlap": ~inside})
