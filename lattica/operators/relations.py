"""Joins along index relations.

A relation is an edge frame ``(src, dst[, pos])``: ``src`` items point to
``dst`` items, ``pos`` orders the targets of a source.  Relations may hold an
edge several times; operators say whether that counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def relation(frame: DataFrame, src: str, dst: str, order: list[str] | None = None) -> DataFrame:
    """Edges of a link table; with ``order``, targets are numbered from 0 by it."""
    if order:
        w = Window.partitionBy(src).orderBy(*order)
        frame = frame.withColumn("pos", F.row_number().over(w) - 1)
    return frame.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *(["pos"] if order else []))


def from_lists(items: DataFrame, uid: str, targets: str) -> DataFrame:
    """Edges of a column of target lists."""
    return items.select(F.col(uid).alias("src"), F.posexplode(targets).alias("pos", "dst"))


def to_lists(edges: DataFrame) -> DataFrame:
    """``src, targets``: lists in order of ``pos`` (of ``dst``, where there is none)."""
    key = "pos" if "pos" in edges.columns else "dst"
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("dst").alias("v"))))
    return edges.groupBy("src").agg(F.transform(pairs, lambda p: p["v"]).alias("targets"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges a -> c where a -> b and b -> c, each once."""
    return first.select("src", F.col("dst").alias("_via")).join(second.select(F.col("src").alias("_via"), "dst"), "_via").select("src", "dst").distinct()


def gather(edges: DataFrame, values: DataFrame, uid: str, column: str, how: str = "mean", out: str | None = None) -> DataFrame:
    """Per source, an aggregate of its targets' values (every edge counts): ``src, out``."""
    v = values.select(F.col(uid).alias("dst"), F.col(column).alias("_v"))
    return edges.join(v, "dst").groupBy("src").agg(AGGREGATES[how]("_v").alias(out or column))


def scatter(edges: DataFrame, values: DataFrame, uid: str, column: str, how: str = "sum", out: str | None = None) -> DataFrame:
    """Per target, an aggregate of what its sources send along each edge: ``dst, out``."""
    v = values.select(F.col(uid).alias("src"), F.col(column).alias("_v"))
    return edges.join(v, "src").groupBy("dst").agg(AGGREGATES[how]("_v").alias(out or column))


def scatter_share(edges: DataFrame, values: DataFrame, uid: str, column: str, out: str = "share") -> DataFrame:
    """Each source divides its value evenly among its edges; targets add up their shares."""
    n = edges.groupBy("src").agg(F.count("*").alias("_n"))
    v = values.select(F.col(uid).alias("src"), F.col(column).alias("_v")).join(n, "src").select("src", (F.col("_v") / F.col("_n")).alias("_share"))
    return edges.join(v, "src").groupBy("dst").agg(F.sum("_share").alias(out))


def scatter_positional(edges: DataFrame, weights: DataFrame, values: DataFrame, uid: str, column: str, out: str = "total") -> DataFrame:
    """Sum over edges of the source's value times the weight for (source, position): ``weights(src, pos, weight)``."""
    v = values.select(F.col(uid).alias("src"), F.col(column).alias("_v"))
    return edges.join(weights, ["src", "pos"]).join(v, "src").groupBy("dst").agg(F.sum(F.col("_v") * F.col("weight")).alias(out))


def overwrite(items: DataFrame, uid: str, column: str, writes: DataFrame) -> DataFrame:
    """``writes(uid, value, turn)``: the write of the largest turn wins; items without a write keep their value."""
    last = writes.groupBy(F.col("uid").alias(uid)).agg(F.max_by("value", "turn").alias("_new"))
    return items.join(last, uid, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def lookup(keys: DataFrame, items: DataFrame, key: str, uid: str, fatal: bool = False) -> DataFrame:
    """Rows of ``items`` by key; a missing key gives nulls, or fails if ``fatal``."""
    j = keys.join(items.withColumnRenamed(uid, "_uid"), F.col(key) == F.col("_uid"), "left")
    if fatal:
        j = j.withColumn("_uid", F.when(F.col("_uid").isNull() & F.col(key).isNotNull(), F.raise_error(F.concat(F.lit("no item with uid "), F.col(key).cast("string")))).otherwise(F.col("_uid")))
    return j.withColumnRenamed("_uid", "found_uid")


def fetch(requests: DataFrame, items: DataFrame, uid: str, column: str) -> DataFrame:
    """Values for ``requests(pos, uid)``, one row per request, missing ones null; ``pos`` keeps the order."""
    return requests.select("pos", F.col("uid").alias(uid)).join(items.select(uid, column), uid, "left").select("pos", F.col(uid).alias("uid"), column)


def adjacency(edges: DataFrame) -> DataFrame:
    """Pairs of different sources that share a target, each ordered pair once: ``a, b``."""
    e = edges.select("src", "dst").distinct()
    return e.select(F.col("src").alias("a"), "dst").join(e.select(F.col("src").alias("b"), "dst"), "dst").filter("a <> b").select("a", "b").distinct()


def k_hop(pairs: DataFrame, seeds: DataFrame, layers: int, lineage: int = 4) -> DataFrame:
    """Items within ``layers`` steps of each seed along ``pairs(a, b)``: ``seed, uid, layer`` (the least; seeds are layer 0).

    Lineage is cut by checkpoint every ``lineage`` layers where the session has a checkpoint folder.
    """
    reached = seeds.select(F.col("uid").alias("seed"), "uid", F.lit(0).alias("layer")).distinct()
    front = reached
    can_cut = bool(reached.sparkSession.conf.get("spark.checkpoint.dir", None))
    for layer in range(1, layers + 1):
        step = front.join(pairs, F.col("uid") == F.col("a")).select("seed", F.col("b").alias("uid")).distinct()
        front = step.join(reached.select("seed", "uid"), ["seed", "uid"], "left_anti").select("seed", "uid", F.lit(layer).alias("layer"))
        reached = reached.unionByName(front)
        if can_cut and layer % lineage == 0:
            reached, front = reached.checkpoint(), front.checkpoint()
    return reached


def connected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs(src, dst)`` with ``linked``: whether the relation has that edge."""
    have = edges.select("src", "dst").distinct().withColumn("_have", F.lit(True))
    return pairs.join(have, ["src", "dst"], "left").withColumn("linked", F.col("_have").isNotNull()).drop("_have")


def connected_by_class(sources: DataFrame, targets: DataFrame, edges: DataFrame, classed: Callable[[Column], Column]) -> DataFrame:
    """``src, dst, linked`` for all pairs of ``sources(src)`` and ``targets(dst)`` whose uids have one class; each pair once.

    There are many more pairs than edges, so pairs are never sent: a target takes with it the sources that it is linked
    to in its class, and is then paired with the sources of the class, which are few enough to broadcast or are shuffled alone.
    """
    s = sources.select("src").distinct().withColumn("_class", classed(F.col("src")))
    have = edges.filter(classed(F.col("src")) == classed(F.col("dst"))).groupBy("dst").agg(F.collect_set("src").alias("_from"))
    d = targets.select("dst").distinct().withColumn("_class", classed(F.col("dst"))).join(have, "dst", "left")
    return d.join(s, "_class").select("src", "dst", F.coalesce(F.array_contains("_from", F.col("src")), F.lit(False)).alias("linked"))


def by_node_tuple(requests: DataFrame, faces: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Faces found by their node uids in any order: ``requests(pos, nodes)`` -> ``pos, uid`` (null where there is none)."""
    f = faces.select(F.array_sort(nodes).alias("_key"), "uid")
    return requests.select("pos", F.array_sort(nodes).alias("_key")).join(f, "_key", "left").select("pos", "uid")


def transpose_mesh(children: DataFrame, parent_uid: str = "parent_uid") -> DataFrame:
    """Parent to child map of a sub-mesh."""
    return children.select(F.col(parent_uid).alias("parent"), F.col("uid").alias("child"))


def degrees(edges: DataFrame, items: DataFrame, uid: str) -> DataFrame:
    """``uid, n``: edges per source, 0 for items without any."""
    n = edges.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("_n"))
    return items.select(F.col(uid).alias("uid")).join(n, F.col("uid") == F.col("_s"), "left").select("uid", F.coalesce("_n", F.lit(0)).alias("n"))


def incremental(edges: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None, replace: DataFrame | None = None) -> DataFrame:
    """A new version of a relation: ``replace(src, old, new)``, then ``remove(src, dst)``, then ``add(src, dst)``."""
    e = edges
    if replace is not None:
        e = e.join(replace.select("src", F.col("old").alias("dst"), "new"), ["src", "dst"], "left").withColumn("dst", F.coalesce("new", "dst")).drop("new")
    if remove is not None:
        e = e.join(remove.select("src", "dst"), ["src", "dst"], "left_anti")
    if add is not None:
        e = e.unionByName(add, allowMissingColumns=True)
    return e


def any_items(**groups: DataFrame) -> DataFrame:
    """Groups of several families under one index space: ``kind, uid`` and their shared columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (g.withColumn("kind", F.lit(k)) for k, g in groups.items()))


def index_of(frame: DataFrame, *keys: str, out: str = "index") -> DataFrame:
    """Contiguous numbers from 0 in order of the keys, without sorting everything in one task.

    A range of the first key for each row (``scan.in_ranges``); a count per range gives each range its first number.
    """
    from .scan import in_ranges

    ranged = in_ranges(frame, *keys)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    first = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_p").orderBy(*keys)
    return ranged.join(F.broadcast(starts), "_p").withColumn(out, F.col("_first") + F.row_number().over(within) - 1).drop("_p", "_first")


def ranked(frame: DataFrame, order: Column | str, out: str = "index") -> DataFrame:
    return index_of(frame, order, out=out)
