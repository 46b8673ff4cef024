"""Reference programs as composite queries: heat, Poisson, equation of state, hydrodynamics, weather stencil."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.expressions import divide
from ..operators import relations
from ..operators.graph import _cut
from ..sources import generators


def perfect_gas(density: Column, energy: Column, gamma: Column) -> tuple[Column, Column]:
    """Pressure and sound speed."""
    pressure = (gamma - 1) * density * energy
    return pressure, F.sqrt(gamma * divide(pressure, density))


def node_mean(edges: DataFrame, cells: DataFrame, column: str) -> DataFrame:
    """Nodes take the mean of their cells: ``uid, column``."""
    return relations.scatter(edges, cells, "uid", column, "mean").withColumnRenamed("dst", "uid")


def cell_mean(edges: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    return relations.gather(edges, nodes, "uid", column, "mean").withColumnRenamed("src", "uid")


def heat(cells: DataFrame, edges: DataFrame, source: DataFrame | None, steps: int, every: int = 5) -> DataFrame:
    """``cells(uid, t)``: each step nodes average cells, cells average nodes, source cells ``(uid, t)`` stay fixed."""
    for n in range(steps):
        cells = cell_mean(edges, node_mean(edges, cells, "t"), "t")
        if source is not None:
            cells = cells.join(source.select("uid", F.col("t").alias("_s")), "uid", "left").select("uid", F.coalesce("_s", "t").alias("t"))
        if n % every == every - 1:
            cells = _cut(cells)
    return cells


def poisson(cells: DataFrame, edges: DataFrame, boundary: DataFrame, tolerance: float = 0.2, most: int = 50) -> tuple[DataFrame, int]:
    """``boundary(uid, value, turn)``: fixed node values; stop when no cell changes by more than the tolerance."""
    nodes = edges.select(F.col("dst").alias("uid")).distinct().withColumn("t", F.lit(0.0))
    n = 0
    while n < most:
        nodes = relations.overwrite(node_mean(edges, cells, "t") if n else nodes, "uid", "t", boundary)
        new = _cut(cell_mean(edges, nodes, "t"))
        change = new.join(cells.select("uid", F.col("t").alias("_old")), "uid").agg(F.max(F.abs(F.col("t") - F.col("_old")))).first()[0]
        cells, n = new, n + 1
        if change is not None and change < tolerance:
            break
    return cells, n


class Hydro:
    """Explicit Lagrangian hydrodynamics of a perfect gas on hexahedra; every step is a new version of two frames.

    ``cell(uid, density, pressure, energy, mass, volume, gamma, length, sound)``, ``node(uid, x, y, z, vx, vy, vz, mass)``,
    and ``cell_node(src, pos, dst)``.
    """

    def __init__(self, spark: SparkSession, mesh: dict[str, DataFrame], gamma: float = 1.4):
        self.spark, self.time = spark, 0.0
        self.edges = _cut(mesh["cell_node"].select("src", "pos", "dst"))
        order = [(pos, f, k) for f, face in enumerate(V.HEXA_FACES) for k, pos in enumerate(face)]
        self.order = spark.createDataFrame(order, "pos int, face int, k int")  # 24 rows, whatever the mesh
        self.faces = _cut(self.sides(mesh["node"]))
        start = mesh["cell"].select("uid", "density", "pressure").join(self.geometry(self.faces), "uid")
        g = F.lit(gamma)
        self.cell = _cut(start.withColumns({"gamma": g, "mass": F.col("density") * F.col("volume"), "energy": F.col("pressure") / ((g - 1) * F.col("density")), "sound": F.sqrt(g * F.col("pressure") / F.col("density"))}))
        share = self.edges.join(self.cell.select(F.col("uid").alias("src"), (F.col("mass") / 8).alias("_m")), "src").groupBy(F.col("dst").alias("uid")).agg(F.sum("_m").alias("mass"))
        self.node = _cut(mesh["node"].join(share, "uid").withColumns({v: F.lit(0.0) for v in ("vx", "vy", "vz")}))

    def sides(self, node: DataFrame) -> DataFrame:
        """``src, face, nx, ny, nz, cx, cy, cz``: area vector (outward) and centre of each cell's six faces.

        A row per corner of a face, gathered by cell and face, so that no expression holds a whole cell.
        """
        corner = self.edges.join(node.select(F.col("uid").alias("dst"), "x", "y", "z"), "dst").repartition("src")
        c = corner.join(F.broadcast(self.order), "pos")
        at = lambda a, k: F.max(F.when(F.col("k") == k, F.col(a))).alias(f"{a}{k}")
        p = c.groupBy("src", "face").agg(*(at(a, k) for a in "xyz" for k in range(4)))
        d = p.withColumns({f"{m}{a}": F.col(f"{a}{i}") - F.col(f"{a}{j}") for a in "xyz" for m, i, j in (("u", 2, 0), ("w", 3, 1))})
        normal = {f"n{a}": 0.5 * (F.col(f"u{b}") * F.col(f"w{c}") - F.col(f"u{c}") * F.col(f"w{b}")) for a, b, c in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))}
        centre = {f"c{a}": (F.col(f"{a}0") + F.col(f"{a}1") + F.col(f"{a}2") + F.col(f"{a}3")) / 4 for a in "xyz"}
        return d.select("src", "face", *(v.alias(k) for k, v in (normal | centre).items()))

    @staticmethod
    def geometry(faces: DataFrame) -> DataFrame:
        """``uid, volume, length``: a third of the sum of centres times area vectors; spans between opposite faces' centres."""
        at = lambda a, f: F.max(F.when(F.col("face") == f, F.col(f"c{a}"))).alias(f"{a}{f}")
        volume = F.sum(sum((F.col(f"c{a}") * F.col(f"n{a}") for a in "xyz"), F.lit(0.0)) / 3).alias("volume")
        g = faces.groupBy(F.col("src").alias("uid")).agg(volume, *(at(a, f) for a in "xyz" for f in range(6)))
        span = lambda i: sum(((F.col(f"{a}{i}") - F.col(f"{a}{i + 3}")) ** 2 for a in "xyz"), F.lit(0.0))
        g = g.select("uid", "volume", *(span(i).alias(f"s{i}") for i in range(3)))
        s0, s1, s2 = (F.col(f"s{i}") for i in range(3))
        return g.select("uid", "volume", (F.sqrt(s0 * s1 * s2) / F.greatest(F.sqrt(s0 * s1 + s1 * s2 + s2 * s0), F.lit(1e-300))).alias("length"))

    def step(self, dt: float, walls: DataFrame) -> None:
        """Forces by position, velocities, walls ``(uid, vx, vy, vz)`` (null: free), motion, geometry, density, energy and state."""
        push = self.faces.join(self.cell.select(F.col("uid").alias("src"), "pressure"), "src").join(F.broadcast(self.order), "face")
        push = push.groupBy("src", "pos").agg(*(F.sum(F.col("pressure") * F.col(f"n{a}") / 4).alias(f"f{a}") for a in "xyz"))
        force = self.edges.join(push, ["src", "pos"]).groupBy(F.col("dst").alias("uid")).agg(*(F.sum(f"f{a}").alias(f"f{a}") for a in "xyz"))
        n = self.node.join(force, "uid")
        n = n.withColumns({f"v{a}": F.col(f"v{a}") + F.lit(dt) * F.col(f"f{a}") / F.col("mass") for a in "xyz"})
        w = walls.select("uid", *(F.col(f"v{a}").alias(f"_v{a}") for a in "xyz"))
        n = n.join(w, "uid", "left").withColumns({f"v{a}": F.coalesce(f"_v{a}", f"v{a}") for a in "xyz"})
        n = n.withColumns({a: F.col(a) + F.lit(dt) * F.col(f"v{a}") for a in "xyz"})
        self.node = _cut(n.select("uid", "x", "y", "z", "mass", "vx", "vy", "vz"))
        self.faces = _cut(self.sides(self.node))
        now = self.geometry(self.faces).select("uid", F.col("volume").alias("new_volume"), F.col("length").alias("new_length"))
        c = self.cell.join(now, "uid")
        # energy with half the work of the old and half of the new pressure, solved for the perfect gas
        ratio = F.col("new_volume") / F.col("volume")
        g = F.col("gamma") - 1
        energy = F.col("energy") * (1 + 0.5 * g * (1 - ratio)) / (1 + 0.5 * g * (1 - 1 / ratio))
        c = c.withColumns({"density": F.col("mass") / F.col("new_volume"), "energy": energy})
        p, s = perfect_gas(F.col("density"), F.col("energy"), F.col("gamma"))
        self.cell = _cut(c.withColumns({"pressure": p, "sound": s}).select("uid", "density", "pressure", "energy", "mass", F.col("new_volume").alias("volume"), "gamma", F.col("new_length").alias("length"), "sound"))
        self.time += dt

    def time_step(self, old: float, cfl: float = 0.3, low: float = 1e-12, high: float = 1.0) -> float:
        least = self.cell.agg(F.min(F.col("length") / F.col("sound"))).first()[0]
        return float(min(max(cfl * least, low), high, 1.1 * old))


def sod_case(spark: SparkSession, nx: int = 20, ny: int = 2, nz: int = 2) -> tuple[Hydro, DataFrame]:
    """The shock tube and its walls."""
    mesh = generators.sod_tube(spark, nx, ny, nz)
    cell = generators.initial_values(mesh["cell"], mesh["cell_group"], {"density": {"ZG": 1.0, "ZD": 0.125}, "pressure": {"ZG": 1.0, "ZD": 0.1}})
    fixed = lambda a: F.max(F.when(F.col("group").isin(f"{a}MIN", f"{a}MAX"), F.lit(0.0)))
    walls = mesh["node_group"].groupBy("uid").agg(fixed("X").alias("vx"), fixed("Y").alias("vy"), fixed("Z").alias("vz"))
    return Hydro(spark, {"cell": cell, "node": mesh["node"], "cell_node": mesh["cell_node"]}), walls.cache()


def run_sod(spark: SparkSession, steps: int, nx: int = 20, ny: int = 2, nz: int = 2) -> Hydro:
    hydro, walls = sod_case(spark, nx, ny, nz)
    dt = 1e-3
    for _ in range(steps):
        hydro.step(dt, walls)
        dt = hydro.time_step(dt)
    return hydro


def stencil(grid: DataFrame, sizes: tuple[int, int], steps: int, k: float = 0.1) -> DataFrame:
    """A structured plane ``(i, j, v)``: each step adds k times the sum of differences to the four neighbours (edges closed)."""
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    for _ in range(steps):
        out = grid.select("i", "j", "v", F.explode(around).alias("d")).select((F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j"), "v")
        near = out.filter((F.col("i") >= 0) & (F.col("i") < sizes[0]) & (F.col("j") >= 0) & (F.col("j") < sizes[1])).groupBy("i", "j").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
        grid = grid.join(near, ["i", "j"]).select("i", "j", (F.col("v") + k * (F.col("s") - F.col("n") * F.col("v"))).alias("v"))
    return grid
