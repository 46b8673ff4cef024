"""Consistency checks, discrete operators and small utilities of a mesh."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_ids(items: DataFrame, uid: str = "uid") -> DataFrame:
    """Uids that occur more than once; empty if all is well."""
    return items.groupBy(uid).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose source or target is no item: ``src, dst, missing``."""
    s = edges.join(sources.select(F.col("uid").alias("src")), "src", "left_anti").withColumn("missing", F.lit("source"))
    t = edges.join(targets.select(F.col("uid").alias("dst")), "dst", "left_anti").withColumn("missing", F.lit("target"))
    return s.select("src", "dst", "missing").unionByName(t.select("src", "dst", "missing"))


def owner_conflicts(items: DataFrame, uid: str = "uid", owner: str = "owner") -> DataFrame:
    """Uids that different rows give different owners."""
    return items.groupBy(uid).agg(F.countDistinct(owner).alias("n_owners")).filter("n_owners > 1")


def stray_members(group: DataFrame, items: DataFrame) -> DataFrame:
    """Group members that are no items."""
    return group.join(items.select("uid"), "uid", "left_anti")


def check_mesh(mesh: dict[str, DataFrame]) -> DataFrame:
    """``check, n_bad`` over cells, nodes and their relation."""
    found = {"cell uids": unique_ids(mesh["cell"]), "node uids": unique_ids(mesh["node"]), "cell_node": dangling(mesh["cell_node"], mesh["cell"], mesh["node"])}
    return reduce(lambda a, b: a.unionByName(b), (f.agg(F.lit(k).alias("check"), F.count("*").alias("n_bad")) for k, f in found.items()))


def misoriented(cell_faces: DataFrame) -> DataFrame:
    """Sides ``(cell, nodes)`` of two nodes that two cells run through in the same direction: ``a, b, c1, c2``."""
    s = cell_faces.filter(F.size("nodes") == 2).select(F.col("nodes")[0].alias("a"), F.col("nodes")[1].alias("b"), "cell")
    return s.groupBy("a", "b").agg(F.min("cell").alias("c1"), F.max("cell").alias("c2"), F.count("*").alias("n")).filter("n > 1").drop("n")


def divergence(faces: DataFrame, flux: str) -> DataFrame:
    """Sum of face fluxes into cells: ``faces(back, front, flux)`` with the flux from back to front; ``uid, div``."""
    both = F.array(F.struct(F.col("back").alias("uid"), F.col(flux).alias("f")), F.struct(F.col("front").alias("uid"), (-F.col(flux)).alias("f")))
    return faces.select(F.explode(both).alias("e")).filter("e.uid is not null").groupBy(F.col("e.uid").alias("uid")).agg(F.sum("e.f").alias("div"))


def error_estimate(values: DataFrame, exact: Column, weight: Column) -> DataFrame:
    """Norms of ``value - exact``: weighted L1 and L2, and the largest."""
    e = F.abs(F.col("value") - exact)
    return values.agg(F.sum(e * weight).alias("l1"), F.sqrt(F.sum(e * e * weight)).alias("l2"), F.max(e).alias("linf"))


def refinement_flags(values: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Cells whose value jumps by more than the threshold to a neighbour: ``uid``."""
    a, b = values.select(F.col("uid").alias("a"), F.col("value").alias("_va")), values.select(F.col("uid").alias("b"), F.col("value").alias("_vb"))
    return pairs.join(a, "a").join(b, "b").filter(F.abs(F.col("_va") - F.col("_vb")) > threshold).select(F.col("a").alias("uid")).distinct()


def dump_if(frame: DataFrame, test: Column, *columns: str, n: int = 100) -> str:
    """Text of the rows where the test holds (at most n)."""
    rows = frame.filter(test).select(*columns).limit(n).collect()
    return "\n".join(", ".join(f"{c}={r[c]}" for c in columns) for r in rows)


def export_size(frame: DataFrame) -> float:
    """Estimated MB of a frame by Catalyst's statistics."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6


def subdivide(cells: DataFrame, pattern: list[tuple[float, ...]]) -> DataFrame:
    """Split each cell ``(uid, cx, cy[, cz], hx, hy[, hz])`` by a pattern of relative centres; sizes go by the number of distinct places on each axis."""
    dim = len(pattern[0])
    axes = "xyz"[:dim]
    parts = [len({p[a] for p in pattern}) for a in range(dim)]
    p = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(float(v)).alias(f"p{a}") for a, v in zip(axes, q, strict=True))) for k, q in enumerate(pattern)))
    e = cells.withColumn("_p", F.explode(p))
    new = {"parent_uid": F.col("uid"), "uid": F.col("uid") * len(pattern) + F.col("_p.k")}
    for a, n in zip(axes, parts, strict=True):
        new[f"c{a}"] = F.col(f"c{a}") + F.col(f"_p.p{a}") * F.col(f"h{a}")
        new[f"h{a}"] = F.col(f"h{a}") / n
    return e.withColumns(new).drop("_p")


def copy_mean(items: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``mapping(uid, first, second)``: items take the mean of two others' values (one of them if the other is null)."""
    v = items.select(F.col("uid").alias("_u"), F.col(column).alias("_v"))
    e = mapping.select("uid", F.explode(F.array("first", "second")).alias("_u")).join(v, "_u").groupBy("uid").agg(F.avg("_v").alias("_new"))
    return items.join(e, "uid", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def tied_interface(slaves: DataFrame, masters: DataFrame, eps: float) -> DataFrame:
    """Slave nodes ``(uid, x, y)`` on master sides ``(uid, ax, ay, bx, by)`` within eps: ``slave, master, t`` (place on the side); nearest side.

    Sides are spread over cells of the longest side's length, so candidates meet by an equi-join.
    """
    size = masters.agg(F.max(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).first()[0] or 1.0
    size = max(size, eps)
    m = masters
    for a in "xy":
        lo, hi = F.least(f"a{a}", f"b{a}"), F.greatest(f"a{a}", f"b{a}")
        m = m.withColumn(f"_{a}", F.explode(F.sequence(F.floor((lo - eps) / size).cast("long"), F.floor((hi + eps) / size).cast("long"))))
    s = slaves.select(F.col("uid").alias("slave"), "x", "y", *(F.floor(F.col(a) / size).cast("long").alias(f"_{a}") for a in "xy"))
    j = s.join(m.withColumnRenamed("uid", "master"), ["_x", "_y"])
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.least(F.greatest(F.try_divide((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    j = j.withColumn("t", t).withColumn("_d", F.sqrt((F.col("x") - F.col("ax") - F.col("t") * dx) ** 2 + (F.col("y") - F.col("ay") - F.col("t") * dy) ** 2))
    best = F.min(F.struct("_d", "master", "t")).alias("_b")
    return j.filter(F.col("_d") <= eps).groupBy("slave").agg(best).select("slave", F.col("_b.master").alias("master"), F.col("_b.t").alias("t"))


def corefine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlaps of two sets of axis-parallel rectangles ``(uid, x0, y0, x1, y1)``: ``a_uid, b_uid, x0, y0, x1, y1, area``.

    Rectangles are spread over cells of the larger mean size; a pair counts in the cell of its overlap's lower corner.
    """
    spread = lambda f: f.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    size = max(spread(a), spread(b))

    def cells(f: DataFrame, tag: str) -> DataFrame:
        f = f.select(F.col("uid").alias(f"{tag}_uid"), *(F.col(c).alias(f"{tag}{c}") for c in ("x0", "y0", "x1", "y1")))
        for ax in "xy":
            f = f.withColumn(f"_{ax}", F.explode(F.sequence(F.floor(F.col(f"{tag}{ax}0") / size).cast("long"), F.floor(F.col(f"{tag}{ax}1") / size).cast("long"))))
        return f

    j = cells(a, "a").join(cells(b, "b"), ["_x", "_y"])
    j = j.withColumns({"x0": F.greatest("ax0", "bx0"), "y0": F.greatest("ay0", "by0"), "x1": F.least("ax1", "bx1"), "y1": F.least("ay1", "by1")})
    here = (F.floor(F.col("x0") / size) == F.col("_x")) & (F.floor(F.col("y0") / size) == F.col("_y"))
    j = j.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & here)
    return j.select("a_uid", "b_uid", "x0", "y0", "x1", "y1", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


class Derived:
    """Named derived columns: each knows what it depends on; a request adds what is missing, in order, once."""

    def __init__(self):
        self.rules: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {}

    def add(self, name: str, needs: tuple[str, ...], compute: Callable[..., Column]) -> Derived:
        self.rules[name] = (needs, compute)
        return self

    def dependencies(self, name: str, seen: tuple[str, ...] = ()) -> list[str]:
        """What a column needs, deepest first."""
        if name in seen:
            raise ValueError(f"{name} depends on itself")
        if name not in self.rules:
            return []
        out: list[str] = []
        for n in self.rules[name][0]:
            out += [d for d in [*self.dependencies(n, (*seen, name)), n] if d not in out]
        return out

    def apply(self, frame: DataFrame, *names: str) -> DataFrame:
        for name in names:
            for d in [*self.dependencies(name), name]:
                if d not in frame.columns:
                    if d not in self.rules:
                        raise KeyError(f"{d} is neither a column nor a rule")
                    needs, f = self.rules[d]
                    frame = frame.withColumn(d, f(*(F.col(n) for n in needs)))
        return frame


class Services:
    """Implementations chosen by interface and name in the data set."""

    def __init__(self):
        self.known: dict[tuple[str, str], Callable] = {}

    def add(self, interface: str, name: str, make: Callable) -> Services:
        self.known[interface, name] = make
        return self

    def create(self, interface: str, name: str, **options):
        if (interface, name) not in self.known:
            raise KeyError(f"no service {name} for {interface}; known: {sorted(n for i, n in self.known if i == interface)}")
        return self.known[interface, name](**options)
