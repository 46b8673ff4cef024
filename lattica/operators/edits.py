"""Structure edits: every edit returns a new version of the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relations import index_of


def add_items(items: DataFrame, new: DataFrame, uid: str = "uid") -> DataFrame:
    """New items; a uid that exists keeps its old row."""
    return items.unionByName(new.join(items.select(uid), uid, "left_anti"), allowMissingColumns=True)


def add_cells(mesh: dict[str, DataFrame], new: DataFrame) -> dict[str, DataFrame]:
    """``new(uid, type, nodes)``: cells with their edges; nodes that are not there yet are made."""
    edges = new.select(F.col("uid").alias("src"), F.posexplode("nodes").alias("pos", "dst"))
    nodes = edges.select(F.col("dst").alias("uid")).distinct()
    return mesh | {"cell": add_items(mesh["cell"], new.select("uid", "type")), "cell_node": mesh["cell_node"].unionByName(edges, allowMissingColumns=True), "node": add_items(mesh["node"], nodes)}


def remove_cells(mesh: dict[str, DataFrame], gone: DataFrame, keep_orphans: bool = False) -> dict[str, DataFrame]:
    """Drop cells, their edges and (unless kept) nodes that no cell holds any more."""
    edges = mesh["cell_node"].join(gone.select(F.col("uid").alias("src")), "src", "left_anti")
    nodes = mesh["node"] if keep_orphans else mesh["node"].join(edges.select(F.col("dst").alias("uid")), "uid", "left_semi")
    return mesh | {"cell": mesh["cell"].join(gone.select("uid"), "uid", "left_anti"), "cell_node": edges, "node": nodes}


def compact(items: DataFrame, uid: str = "uid", out: str = "local_id") -> DataFrame:
    """Local ids 0..n-1 in order of uid."""
    return index_of(items, uid, out=out)


def merge_meshes(*families: DataFrame, uid: str = "uid") -> DataFrame:
    """Append meshes; shared items stay once (the first mesh's row)."""
    both = None
    for turn, f in enumerate(families):
        f = f.withColumn("_turn", F.lit(turn))
        both = f if both is None else both.unionByName(f, allowMissingColumns=True)
    row = F.min_by(F.struct(*[c for c in both.columns if c not in (uid, "_turn")]), "_turn").alias("_row")
    rest = [c for c in both.columns if c not in (uid, "_turn")]
    return both.groupBy(uid).agg(row).select(uid, *(F.col(f"_row.{c}").alias(c) for c in rest)) if rest else both.select(uid).distinct()


def merge_nodes(edges: DataFrame, nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs(gone, kept)``: edges to a merged node go to the kept one; merged nodes are dropped."""
    e = edges.join(pairs.select(F.col("gone").alias("dst"), "kept"), "dst", "left").withColumn("dst", F.coalesce("kept", "dst")).drop("kept")
    return e, nodes.join(pairs.select(F.col("gone").alias("uid")), "uid", "left_anti")


def renumber(items: DataFrame, uid: str, *keys: str) -> DataFrame:
    """Uids from a hash of the keys (for instance node uids), non-negative."""
    return items.withColumn(uid, F.xxhash64(*keys).bitwiseAND(F.lit((1 << 63) - 1)))


def refine(cells: DataFrame, children: int, flag: Column | None = None) -> DataFrame:
    """Flagged active cells become inactive parents of ``children`` new cells: adds ``parent_uid``; uids by arithmetic."""
    chosen = F.col("active") & (flag if flag is not None else F.lit(True))
    c = cells.withColumn("_refine", chosen)
    parents = c.withColumn("active", F.col("active") & ~F.col("_refine")).drop("_refine")
    top = cells.agg(F.max("uid").alias("_top"))
    born = c.filter("_refine").join(F.broadcast(top)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(children - 1))))
    born = born.withColumns({"parent_uid": F.col("uid"), "uid": F.col("_top") + 1 + F.col("uid") * children + F.col("_k"), "level": F.col("level") + 1, "active": F.lit(True)})
    return parents.unionByName(born.select(*parents.columns))


def coarsen(cells: DataFrame, flag: Column) -> DataFrame:
    """Parents all of whose children are flagged and active become active again; the children go."""
    kids = cells.filter(F.col("parent_uid").isNotNull()).groupBy("parent_uid").agg(F.min((F.col("active") & flag).cast("int")).alias("_all"))
    back = kids.filter("_all = 1").select("parent_uid")
    stay = cells.join(back, "parent_uid", "left_anti")
    woken = back.select(F.col("parent_uid").alias("uid"), F.lit(True).alias("_woken"))
    return stay.join(woken, "uid", "left").withColumn("active", F.col("active") | F.col("_woken").isNotNull()).drop("_woken").select(*cells.columns)


def grid_intersection(first: DataFrame, second: DataFrame, x: str = "x") -> DataFrame:
    """Common grid of two curves: the later start, the first grid's inner points, the earlier end; an empty grid gives the other one."""
    ends = first.agg(F.min(x).alias("a0"), F.max(x).alias("b0")).join(second.agg(F.min(x).alias("a1"), F.max(x).alias("b1")))
    ends = ends.select(F.greatest("a0", "a1").alias("a"), F.least("b0", "b1").alias("b"), F.col("a0").isNull().alias("none0"), F.col("a1").isNull().alias("none1"))
    one = first.select(F.col(x).alias("v")).join(F.broadcast(ends)).filter("none1 or (v > a and v < b)").select(F.col("v").alias(x))
    other = second.select(F.col(x).alias("v")).join(F.broadcast(ends)).filter("none0").select(F.col("v").alias(x))
    tips = ends.filter("not none0 and not none1 and a <= b").select(F.explode(F.array("a", "b")).alias(x))
    return one.unionByName(other).unionByName(tips)


def scheduled(items: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None, move: DataFrame | None = None, uid: str = "uid") -> DataFrame:
    """Deferred edits applied together: moves ``(uid, x, y, z)``, then removals, then additions."""
    out = items
    if move is not None:
        m = move.select(uid, *(F.col(c).alias(f"_{c}") for c in move.columns if c != uid))
        out = out.join(m, uid, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in move.columns if c != uid}).select(*items.columns)
    if remove is not None:
        out = out.join(remove.select(uid), uid, "left_anti")
    return add_items(out, add, uid) if add is not None else out


def places(frame: DataFrame, key: str, order: list[str], out: str = "pos") -> DataFrame:
    """Position of each element in its list."""
    return frame.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
