"""Row subsets: filters, partitions, and groups derived through relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_if(frame: DataFrame, test: Column) -> DataFrame:
    return frame.filter(test)


def apply_flags(frame: DataFrame, flag: str) -> DataFrame:
    return frame.filter(F.col(flag) != 0)


def partition_two(frame: DataFrame, test: Column, out: str = "part") -> DataFrame:
    """Part 0 where the test holds, else 1 (null counts as failing)."""
    return frame.withColumn(out, F.when(test, 0).otherwise(1))


def partition_three(frame: DataFrame, first: Column, second: Column, out: str = "part") -> DataFrame:
    """Part 0 where ``first`` holds, 1 where only ``second`` does, else 2."""
    return frame.withColumn(out, F.when(first, 0).when(second, 1).otherwise(2))


def part_sizes(frame: DataFrame, out: str = "part") -> DataFrame:
    return frame.groupBy(out).agg(F.count("*").alias("n"))


def touching(items: DataFrame, uid: str, edges: DataFrame, group: DataFrame) -> DataFrame:
    """Items that a member of ``group(uid)`` points to, each once."""
    hit = edges.join(group.select(F.col("uid").alias("src")), "src", "left_semi").select(F.col("dst").alias(uid))
    return items.join(hit, uid, "left_semi")


def own(items: DataFrame, part: int, owner: str = "owner") -> DataFrame:
    return items.filter(F.col(owner) == part)


def ghost(items: DataFrame, uid: str, own_items: DataFrame) -> DataFrame:
    """All minus own."""
    return items.join(own_items.select(uid), uid, "left_anti")


def interface(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Items with a neighbour of another owner: ``uid, owner``; ``pairs(a, b)``, ``owners(uid, owner)``."""
    a = owners.select(F.col("uid").alias("a"), F.col("owner").alias("_oa"))
    b = owners.select(F.col("uid").alias("b"), F.col("owner").alias("_ob"))
    return pairs.join(a, "a").join(b, "b").filter("_oa <> _ob").select(F.col("a").alias("uid"), F.col("_oa").alias("owner")).distinct()


def inner_outer(edges: DataFrame, group: DataFrame) -> DataFrame:
    """Targets by how many members of the group hold them: ``dst, n, kind`` (inner: 2 or more, outer: exactly 1)."""
    e = edges.join(group.select(F.col("uid").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    return e.groupBy("dst").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("n") >= 2, "inner").otherwise("outer"))


def sub_parts_by_type(items: DataFrame, kind: str) -> DataFrame:
    return items.groupBy(kind).agg(F.count("*").alias("n"), F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid"))


def common_names(frame: DataFrame, name: str, part: str) -> DataFrame:
    """Names present on all parts, sorted (the number of parts is counted in the same pass over distinct pairs)."""
    pairs = frame.select(name, part).distinct()
    n = pairs.agg(F.countDistinct(part).alias("_all"))
    return pairs.groupBy(name).agg(F.count("*").alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all")).select(name).orderBy(name)


def add_members(group: DataFrame, more: DataFrame, check: bool = True) -> DataFrame:
    """With ``check``, members stay distinct."""
    both = group.select("uid").unionByName(more.select("uid"))
    return both.distinct() if check else both


def remove_members(group: DataFrame, less: DataFrame) -> DataFrame:
    return group.join(less.select("uid"), "uid", "left_anti")


def half_space(cells: DataFrame, edges: DataFrame, nodes: DataFrame, planes: list[tuple[tuple[float, float, float], tuple[float, float, float]]]) -> DataFrame:
    """Cells whose node-mean centre is on the positive side of every plane (point, normal): ``uid, cx, cy, cz``."""
    at = edges.join(nodes.select(F.col("uid").alias("dst"), "x", "y", "z"), "dst").groupBy(F.col("src").alias("uid")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    test = F.lit(True)
    for p, n in planes:
        test = test & (sum((F.col(c) - F.lit(float(q))) * F.lit(float(m)) for c, q, m in zip(("cx", "cy", "cz"), p, n, strict=True)) >= 0)
    return cells.select("uid").join(at, "uid").filter(test)


def sub_mesh(cells: DataFrame, edges: DataFrame, nodes: DataFrame, group: DataFrame) -> dict[str, DataFrame]:
    """The mesh restricted to a group of cells."""
    e = edges.join(group.select(F.col("uid").alias("src")), "src", "left_semi")
    return {"cell": cells.join(group.select("uid"), "uid", "left_semi"), "cell_node": e, "node": nodes.join(e.select(F.col("dst").alias("uid")), "uid", "left_semi")}


def valid_values(frame: DataFrame, *columns: str) -> DataFrame:
    """Counts of null, NaN and infinite values by column."""
    out = None
    for c in columns:
        v = F.col(c).cast("double")
        one = frame.agg(F.lit(c).alias("name"), F.sum(v.isNull().cast("long")).alias("n_null"), F.sum(F.isnan(v).cast("long")).alias("n_nan"), F.sum((F.abs(v) == float("inf")).cast("long")).alias("n_inf"))
        out = one if out is None else out.unionByName(one)
    return out
