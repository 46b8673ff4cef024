"""Meshes from arithmetic on ``spark.range``: no shuffle, no driver-side lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES, INDEX = "xyz", "ijk"


def _split(n: Column, sizes: tuple[int, ...]) -> list[Column]:
    """Grid position of a running number, the first axis fastest."""
    out = []
    for s in sizes:
        out.append(F.pmod(n, F.lit(s)))
        n = F.floor(n / s).cast("long")
    return out


def grid_uid(position: list[Column], sizes: tuple[int, ...]) -> Column:
    uid = F.lit(0).cast("long")
    for p, s in reversed(list(zip(position, sizes, strict=True))):
        uid = uid * s + p
    return uid


def coordinates(n: int, length: float, ratio: float = 1.0):
    """Node position as a function of its index: even, or a geometric progression of cell lengths."""
    if ratio == 1.0:
        return lambda i: i * F.lit(length / n)
    return lambda i: (F.pow(F.lit(ratio), i) - 1) * F.lit(length / (ratio**n - 1))


def cartesian(spark: SparkSession, sizes: tuple[int, ...], lengths: tuple[float, ...], parts: tuple[int, ...] | None = None, ratios: tuple[float, ...] | None = None) -> dict[str, DataFrame]:
    """``cell(uid, i, j[, k], owner)``, ``node(uid, x, y[, z])`` and ``cell_node(src, pos, dst)`` of a block."""
    dim = len(sizes)
    parts, ratios = parts or (1,) * dim, ratios or (1.0,) * dim
    nodes = tuple(s + 1 for s in sizes)
    total = lambda t: reduce(lambda a, b: a * b, t)
    p = _split(F.col("id"), sizes)
    cell = spark.range(total(sizes)).select(F.col("id").alias("uid"), *(c.alias(INDEX[a]) for a, c in enumerate(p)))
    owner = F.lit(0).cast("long")
    for a in reversed(range(dim)):
        owner = owner * parts[a] + F.floor(F.col(INDEX[a]) * parts[a] / F.lit(sizes[a]))
    cell = cell.withColumn("owner", owner)
    q = _split(F.col("id"), nodes)
    node = spark.range(total(nodes)).select(F.col("id").alias("uid"), *(coordinates(sizes[a], lengths[a], ratios[a])(c).cast("double").alias(AXES[a]) for a, c in enumerate(q)))
    corners = [(0,), (1,)] if dim == 1 else [(0, 0), (1, 0), (1, 1), (0, 1)]
    if dim == 3:
        corners = [(*c, k) for k in (0, 1) for c in corners]
    shift = F.array(*(F.struct(F.lit(n).alias("pos"), *(F.lit(d).alias(f"d{INDEX[a]}") for a, d in enumerate(c))) for n, c in enumerate(corners)))
    e = cell.select("*", F.explode(shift).alias("_c"))
    dst = grid_uid([F.col(INDEX[a]) + F.col(f"_c.d{INDEX[a]}") for a in range(dim)], nodes)
    return {"cell": cell, "node": node, "cell_node": e.select(F.col("uid").alias("src"), F.col("_c.pos").alias("pos"), dst.alias("dst"))}


def cartesian_faces(cell: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``axis, uid, back, front``: every face with the cells behind and before it (null at the border)."""
    dim = len(sizes)
    out = None
    for a in range(dim):
        idx = INDEX[a]
        both = F.array(F.struct(F.col(idx).alias("at"), F.lit("front").alias("side")), F.struct((F.col(idx) + 1).alias("at"), F.lit("back").alias("side")))
        e = cell.select("*", F.explode(both).alias("_f"))
        faces = tuple(s + (1 if b == a else 0) for b, s in enumerate(sizes))
        uid = grid_uid([F.col("_f.at") if b == a else F.col(INDEX[b]) for b in range(dim)], faces)
        f = e.select(F.lit(AXES[a]).alias("axis"), uid.alias("face"), F.col("uid"), F.col("_f.side").alias("side"))
        f = f.groupBy("axis", F.col("face").alias("uid")).agg(F.max(F.when(F.col("side") == "back", F.col("uid"))).alias("back"), F.max(F.when(F.col("side") == "front", F.col("uid"))).alias("front"))
        out = f if out is None else out.unionByName(f)
    return out


def cartesian_neighbour(cell: DataFrame, sizes: tuple[int, ...], axis: int) -> DataFrame:
    """``uid, previous, next`` along a direction by arithmetic; null at the border."""
    step = reduce(lambda a, b: a * b, sizes[:axis], 1)
    i = F.col(INDEX[axis])
    return cell.select("uid", F.when(i > 0, F.col("uid") - step).alias("previous"), F.when(i < sizes[axis] - 1, F.col("uid") + step).alias("next"))


def sod_tube(spark: SparkSession, nx: int, ny: int, nz: int) -> dict[str, DataFrame]:
    """The shock tube: a block of lengths 1 x 0.1 x 0.1 with groups ZG (left half), ZD, and XMIN ... ZMAX of nodes."""
    mesh = cartesian(spark, (nx, ny, nz), (1.0, 0.1, 0.1))
    group = mesh["cell"].select(F.when(F.col("i") < F.lit(nx / 2), "ZG").otherwise("ZD").alias("group"), "uid")
    sizes = (nx + 1, ny + 1, nz + 1)
    n = mesh["node"]
    at = _split(F.col("uid"), sizes)
    ends = F.array(*(F.when(c == v, F.lit(f"{a.upper()}{side}")) for a, c, s in zip(AXES, at, sizes, strict=True) for v, side in ((0, "MIN"), (s - 1, "MAX"))))
    nodes = n.select(F.explode(F.array_compact(ends)).alias("group"), "uid")
    return mesh | {"cell_group": group, "node_group": nodes}


def honeycomb(spark: SparkSession, layers: int, pitch: float, heights: int = 1) -> DataFrame:
    """Hexagonal cells ``uid, q, r, level, x, y`` around a centre: those of axial distance below ``layers``."""
    n = 2 * layers - 1
    c = spark.range(n * n * heights)
    q, r, k = _split(F.col("id"), (n, n, heights))
    c = c.select((q - (layers - 1)).alias("q"), (r - (layers - 1)).alias("r"), k.alias("level"))
    c = c.filter(F.greatest(F.abs("q"), F.abs("r"), F.abs(F.col("q") + F.col("r"))) < layers)
    uid = (F.col("level") * n + F.col("r") + layers - 1) * n + F.col("q") + layers - 1
    return c.select(uid.alias("uid"), "q", "r", "level", (F.lit(pitch) * (F.col("q") + F.col("r") / 2)).alias("x"), (F.lit(pitch * 3**0.5 / 2) * F.col("r")).alias("y"))


def simple_mesh(spark: SparkSession) -> dict[str, DataFrame]:
    """A small fixed mesh of a hexahedron, a prism and a pyramid side by side."""
    points = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1), (2, 0, 0), (2, 0, 1), (0.5, 0.5, 2)]
    node = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "uid long, x double, y double, z double")
    cells = [(0, "hexaedron", [0, 1, 2, 3, 4, 5, 6, 7]), (1, "pentaedron", [1, 8, 2, 5, 9, 6]), (2, "pyramid", [4, 5, 6, 7, 10])]
    return unstructured(spark, cells) | {"node": node}


def unstructured(spark: SparkSession, cells: list[tuple[int, str, list[int]]]) -> dict[str, DataFrame]:
    """Cells given as (uid, type, node uids)."""
    c = spark.createDataFrame(cells, "uid long, type string, nodes array<long>")
    return {"cell": c.select("uid", "type"), "cell_node": c.select(F.col("uid").alias("src"), F.posexplode("nodes").alias("pos", "dst"))}


def initial_values(cell: DataFrame, groups: DataFrame, values: dict[str, dict[str, float]]) -> DataFrame:
    """Constants by variable and group; items outside a variable's groups are null."""
    g = groups.groupBy("uid").agg(F.collect_set("group").alias("_groups"))
    out = cell.join(g, "uid", "left")
    for name, by in values.items():
        v = F.lit(None).cast("double")
        for group, x in by.items():
            v = F.when(F.array_contains("_groups", group), F.lit(float(x))).otherwise(v)
        out = out.withColumn(name, v)
    return out.drop("_groups")


def particles(spark: SparkSession, n: int, cells: int, seed: int = 1) -> DataFrame:
    """Particles ``uid, cell_uid`` spread over cells by hash."""
    return spark.range(n).select(F.col("id").alias("uid"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(cells)).alias("cell_uid"))
