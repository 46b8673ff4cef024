"""Joins by place: coincident points, rays against faces, all-pairs forces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _cells(frame: DataFrame, size: float, axes: tuple[str, ...], spread: bool) -> DataFrame:
    """The grid cell of each point and, with ``spread``, the cells around it."""
    steps = F.array(*(F.lit(d) for d in (-1, 0, 1)))
    for a in axes:
        c = F.floor(F.col(a) / F.lit(size)).cast("long")
        frame = frame.withColumn(f"_{a}", c)
        if spread:
            frame = frame.withColumn("_d", F.explode(steps)).withColumn(f"_{a}", F.col(f"_{a}") + F.col("_d")).drop("_d")
    return frame


def close_pairs(left: DataFrame, right: DataFrame, eps: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Pairs ``l_uid, r_uid, distance`` within eps, by an equi-join on grid cells of that size."""
    lhs = _cells(left.select(F.col("uid").alias("l_uid"), *axes), eps, axes, False)
    rhs = _cells(right.select(F.col("uid").alias("r_uid"), *axes), eps, axes, True)
    rhs = rhs.select("r_uid", *(F.col(a).alias(f"r{a}") for a in axes), *(f"_{a}" for a in axes))
    d = F.sqrt(reduce(lambda s, t: s + t, ((F.col(a) - F.col(f"r{a}")) ** 2 for a in axes)))
    return lhs.join(rhs, [f"_{a}" for a in axes]).withColumn("distance", d).filter(F.col("distance") <= eps).select("l_uid", "r_uid", "distance")


def coordinate_uids(points: DataFrame, known: DataFrame, eps: float) -> DataFrame:
    """The uid of the nearest known point within eps, or null."""
    near = close_pairs(points, known, eps).groupBy("l_uid").agg(F.min(F.struct("distance", "r_uid"))["r_uid"].alias("found"))
    return points.join(near, F.col("uid") == F.col("l_uid"), "left").drop("l_uid")


def ray_faces(rays: DataFrame, faces: DataFrame, cell: float) -> DataFrame:
    """First face that each ray meets: ``uid, face_uid, ix, iy, iz, distance`` (nulls for none).

    ``rays(uid, px, py, pz, dx, dy, dz, reach)`` travel ``reach`` times their direction at most;
    ``faces(uid, ax..cz)`` are triangles.  Both are spread over grid cells of ``cell``: faces over the cells of their
    box, rays over the cells they pass (by samples of half a cell and the cells around), so candidates meet by an
    equi-join; the exact test follows.
    """
    axes = "xyz"
    n = F.greatest(F.ceil(F.sqrt(reduce(lambda s, t: s + t, (F.col(f"d{a}") ** 2 for a in axes))) * F.col("reach") / (cell / 2)), F.lit(1)).cast("int")
    r = rays.withColumn("_t", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: k * F.col("reach") / n)))
    for a in axes:
        r = r.withColumn(f"_{a}", F.floor((F.col(f"p{a}") + F.col(f"d{a}") * F.col("_t")) / cell).cast("long"))
    r = r.drop("_t").distinct()
    f = faces
    for a in axes:
        lo, hi = F.least(*(F.col(f"{v}{a}") for v in "abc")), F.greatest(*(F.col(f"{v}{a}") for v in "abc"))
        f = f.withColumn(f"_{a}", F.explode(F.sequence(F.floor(lo / cell).cast("long") - 1, F.floor(hi / cell).cast("long") + 1)))
    j = r.join(f.withColumnRenamed("uid", "face_uid"), [f"_{a}" for a in axes])
    v = lambda p, q: [F.col(f"{p}{a}") - F.col(f"{q}{a}") for a in axes]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    d = [F.col(f"d{a}") for a in axes]
    e1, e2, s = v("b", "a"), v("c", "a"), v("p", "a")
    h = cross(d, e2)
    det = dot(e1, h)
    j = j.withColumns({"_det": det, "_u": F.try_divide(dot(s, h), det), "_v": F.try_divide(dot(d, cross(s, e1)), det), "_t": F.try_divide(dot(e2, cross(s, e1)), det)})
    hit = (F.abs("_det") > 1e-14) & (F.col("_u") >= 0) & (F.col("_v") >= 0) & (F.col("_u") + F.col("_v") <= 1) & (F.col("_t") >= 0) & (F.col("_t") <= F.col("reach"))
    best = j.filter(hit).groupBy("uid").agg(F.min(F.struct(F.col("_t"), F.col("face_uid"))).alias("_b"))
    out = rays.join(best, "uid", "left")
    at = {f"i{a}": F.col(f"p{a}") + F.col(f"d{a}") * F.col("_b._t") for a in axes}
    length = F.sqrt(dot(d, d)) * F.col("_b._t")
    return out.select("uid", F.col("_b.face_uid").alias("face_uid"), *(c.alias(k) for k, c in at.items()), length.alias("distance"))


#: Bodies in a block, targets that meet a block of sources at once, and pairs of blocks in a task.
BLOCK, AT_ONCE, TASK = 4096, 64, 4


def _forces(softening: float, uid: pa.DataType):
    """Map over pairs of packed blocks: the part of each target's force that the block of sources gives."""
    soft = float(softening)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                of, by = (batch.column(c)[i].values for c in ("_of", "_by"))
                target, source = ([x.field(a).to_numpy(zero_copy_only=False) for a in "xyz"] for x in (of, by.filter(pc.is_valid(by.field("x")))))
                force = np.zeros((3, len(of)))
                with np.errstate(all="ignore"):
                    for lo in range(0, len(of), AT_ONCE):
                        d = [s[None, :] - t[lo : lo + AT_ONCE, None] for s, t in zip(source, target, strict=True)]
                        r = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] + soft
                        r *= np.sqrt(r)
                        for k in range(3):
                            force[k, lo : lo + AT_ONCE] = (d[k] / r).sum(axis=1)
                blank = pc.is_null(of.field("x")).to_numpy(zero_copy_only=False) if len(source[0]) else np.ones(len(of), bool)
                yield pa.RecordBatch.from_arrays([of.field("uid").cast(uid), *(pa.array(f, pa.float64(), mask=blank) for f in force)], ["uid", "fx", "fy", "fz"])

    return run


def n_body(bodies: DataFrame, softening: float, block: int = BLOCK) -> DataFrame:
    """Force on each body from all bodies (unit masses): ``uid, fx, fy, fz``.

    All pairs, by pairs of blocks of about ``block`` bodies: a row is a block of targets and one of sources, and each
    target sends one sum per block of sources.  A body without all three coordinates gives no force and has a null one.
    """
    blocks = bodies.count() // block + 1
    whole = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull(), F.lit(True))
    b = bodies.select("uid", *(F.when(whole, F.col(a).cast("double")).alias(a) for a in "xyz"))
    packed = b.groupBy(F.pmod(F.xxhash64("uid", "x", "y", "z"), F.lit(blocks)).alias("_b")).agg(F.collect_list(F.struct("uid", "x", "y", "z")).alias("_all"))
    of = packed.select(F.col("_b").alias("_t"), F.col("_all").alias("_of"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_b"))
    pairs = of.join(packed.withColumnRenamed("_all", "_by"), "_b").repartition(blocks * blocks // TASK + 1, "_t", "_b").select("_of", "_by")
    uid = bodies.schema["uid"].dataType
    f = pairs.mapInArrow(_forces(softening, to_arrow_type(uid)), T.StructType([T.StructField("uid", uid), *(T.StructField(f"f{a}", T.DoubleType()) for a in "xyz")]))
    return f.groupBy("uid").agg(*(F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"))
