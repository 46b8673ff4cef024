"""Further registered queries: curves on grids of their own, random numbers, distribution, matrices, checks, files, programs."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions import random
from ..operators import amr, checks, curves, distribution, groups, linalg, materials, relations, scan, sort, spatial, tables
from ..sources import files, sinks
from . import programs
from .catalogue import _DAY, _bridge, _coo, _history, query, r, t


def _folder(spark) -> str:
    """A place of its own below the session's shared folder (a temporary one in local mode without it)."""
    import uuid

    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            known = spark.conf.get("spark.sql.warehouse.dir")
        else:
            known = "file://" + tempfile.mkdtemp(prefix="lattica-")
    return f"{known.rstrip('/')}/files-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- curves on different grids

# Two cases: daily means of the events of users with even and with odd ids, a curve for each type of event; the second
# one's days are shifted, so the grids never agree.
_SHIFT = 0.3
_CASES = f"""
cr AS (SELECT event_type AS name, {_DAY}::DOUBLE AS x, round(avg(value), 6) AS y FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2),
ct AS (SELECT event_type AS name, {_DAY}::DOUBLE + {_SHIFT} AS x, round(avg(value), 6) AS y FROM events WHERE user_id % 2 = 1 GROUP BY 1, 2),
lr AS (SELECT name, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM cr GROUP BY 1),
lt AS (SELECT name, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM ct GROUP BY 1)"""


def _case(spark, sf, odd: int):
    h = _history(spark, sf).filter(F.col("user_id") % 2 == odd).groupBy("name", "iteration").agg(F.avg("value").alias("y"))
    return h.select("name", (F.col("iteration").cast("double") + odd * _SHIFT).alias("x"), r("y", 6).alias("y"))


def _at(order: int, points: str, lists: str, out: str) -> str:
    """CTEs that interpolate ``lists(name, xs, ys)`` at ``points(name, x)``."""
    i = f"{out}_i AS (SELECT q.name, q.x, l.xs, l.ys, len(l.xs) AS n, len(list_filter(l.xs, lambda v: v < q.x)) AS i FROM {points} q JOIN {lists} l USING (name))"
    xs = lambda k: f"xs[{k} + 1]"
    inside = "x >= xs[1] AND x <= xs[n]"
    if order == 0:
        value = f"CASE WHEN x - {xs('i - 1')} >= {xs('i')} - x THEN ys[i + 1] ELSE ys[i] END"
    elif order == 1:
        value = f"CASE WHEN n <= 1 THEN 0 ELSE ys[i] + (ys[i + 1] - ys[i]) * (x - {xs('i - 1')}) / ({xs('i')} - {xs('i - 1')}) END"
    else:
        term = lambda k: f"ys[p + {k} + 1] * " + " * ".join(f"(x - xs[p + {m} + 1]) / (xs[p + {k} + 1] - xs[p + {m} + 1])" for m in range(3) if m != k)
        value = f"CASE WHEN n <= 2 THEN 0 ELSE {' + '.join(term(k) for k in range(3))} END"
        far = f"x - {xs('greatest(i - 2, 0)')} >= {xs('least(i + 1, n - 1)')} - x"
        i += f", {out}_p AS (SELECT *, CASE WHEN (i < 2 OR (i < n - 1 AND {far})) AND i + 1 < n THEN i - 1 ELSE i - 2 END AS p FROM {out}_i)"
        return f"{i}, {out} AS (SELECT name, x, CASE WHEN NOT ({inside}) THEN 0 WHEN {xs('i')} = x THEN ys[i + 1] ELSE {value} END AS y FROM {out}_p)"
    return f"{i}, {out} AS (SELECT name, x, CASE WHEN NOT ({inside}) THEN 0 WHEN {xs('i')} = x THEN ys[i + 1] ELSE {value} END AS y FROM {out}_i)"


_ERRORS = f"""{_CASES},
ends AS (SELECT name, greatest(lr.xs[1], lt.xs[1]) AS lo, least(lr.xs[len(lr.xs)], lt.xs[len(lt.xs)]) AS hi FROM lr JOIN lt USING (name)),
grid AS (SELECT name, lo AS x FROM ends WHERE lo <= hi UNION ALL SELECT name, x FROM cr JOIN ends USING (name) WHERE x > lo AND x < hi UNION ALL SELECT name, hi FROM ends WHERE lo <= hi),
{_at(2, "grid", "lr", "pr")}, {_at(2, "grid", "lt", "pt")},
j AS (SELECT pr.name, pr.x, pr.y AS r, pt.y AS t FROM pr JOIN pt ON pr.name = pt.name AND pr.x = pt.x)"""


@query(f"WITH {_CASES} SELECT name, x, y FROM cr WHERE x >= 19725 AND x < 19740")
def curve_crop(spark, sf):
    return curves.crop(_case(spark, sf, 0), 19725, 19740)


def _projection(order: int) -> str:
    own = "own AS (SELECT cr.name, x FROM cr JOIN lt USING (name) WHERE x >= xs[1] AND x <= xs[len(xs)])"
    return f"WITH {_CASES}, {own}, {_at(order, 'own', 'lt', 'o')} SELECT name, x, round(y, 4) AS y FROM o"


@query(_projection(0))
def curve_project_p0(spark, sf):
    return curves.projected(_case(spark, sf, 0), _case(spark, sf, 1), 0).withColumn("y", r("y"))


@query(_projection(1))
def curve_project_p1(spark, sf):
    return curves.projected(_case(spark, sf, 0), _case(spark, sf, 1), 1).withColumn("y", r("y"))


@query(_projection(2))
def curve_project_p2(spark, sf):
    return curves.projected(_case(spark, sf, 0), _case(spark, sf, 1), 2).withColumn("y", r("y"))


def _error(spark, sf, kind):
    return curves.errors(_case(spark, sf, 0), _case(spark, sf, 1), kind).withColumn("error", r("error", 5))


@query(f"WITH {_ERRORS} SELECT name, round(max(abs((t - r) / CASE WHEN r = 0 THEN 1 ELSE r END)), 5) AS error FROM j GROUP BY 1")
def curve_error_relative(spark, sf):
    return _error(spark, sf, "relative")


@query(f"WITH {_ERRORS}, w AS (SELECT name, max(abs(y)) AS top FROM cr GROUP BY 1) SELECT name, round(max(abs(t - r)) / max(CASE WHEN top = 0 THEN 1 ELSE top END), 5) AS error FROM j JOIN w USING (name) GROUP BY 1")
def curve_error_relative_max(spark, sf):
    return _error(spark, sf, "relative_max")


@query(f"WITH {_ERRORS} SELECT name, round(abs((max(abs(t)) - max(abs(r))) / CASE WHEN max(abs(r)) = 0 THEN 1 ELSE max(abs(r)) END), 5) AS error FROM j GROUP BY 1")
def curve_error_max(spark, sf):
    return _error(spark, sf, "max")


@query(f"WITH {_ERRORS} SELECT name, round(abs(max(t) - max(r)), 5) AS error FROM j GROUP BY 1")
def curve_error_drbar(spark, sf):
    return _error(spark, sf, "drbar")


@query(f"""WITH {_ERRORS}, d AS (SELECT name, x, x - coalesce(lag(x) OVER (PARTITION BY name ORDER BY x), 0) AS dt, CASE WHEN r = 0 THEN 0 ELSE (t - r) / r END AS rel FROM j)
SELECT name, round(abs(sum(dt * rel) / max(x)), 5) AS error FROM d GROUP BY 1""")
def curve_error_drift(spark, sf):
    return _error(spark, sf, "drift")


@query(f"""WITH {_ERRORS}, m AS (SELECT name, max(abs(t)) AS mt, max(abs(r)) AS mr FROM j GROUP BY 1)
SELECT name, round(abs(min(CASE WHEN abs(t) = mt THEN x END) - min(CASE WHEN abs(r) = mr THEN x END)), 5) AS error FROM j JOIN m USING (name) GROUP BY 1""")
def curve_error_chronometry(spark, sf):
    return _error(spark, sf, "chronometry")


@query(f"WITH {_ERRORS} SELECT name, round(x, 6) AS x, round((t - r) / CASE WHEN r = 0 THEN 1 ELSE r END, 4) AS error FROM j")
def curve_error_points(spark, sf):
    return curves.error_curves(_case(spark, sf, 0), _case(spark, sf, 1), "relative").select("name", r("x", 6).alias("x"), r("error").alias("error"))


@query(f"WITH {_CASES} SELECT name, max(abs(y)) AS norm_inf FROM cr GROUP BY 1")
def curve_norm_inf(spark, sf):
    return curves.norm_inf(_case(spark, sf, 0))


@query(f"WITH {_CASES} SELECT 'run_' || name AS name, count(*) AS n FROM cr GROUP BY 1")
def curve_rename(spark, sf):
    return curves.rename(_case(spark, sf, 0), "^(.*)$", "run_$1").groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT event_type AS name, floor(epoch(ts))::DOUBLE AS x, value AS y FROM events")
def curve_from_iterations(spark, sf):
    e = t(spark, sf, "events")
    history = e.select(F.col("event_type").alias("name"), F.col("event_id").alias("iteration"), "value")
    return curves.curve(history, e.select(F.col("event_id").alias("iteration"), F.unix_timestamp("ts").cast("double").alias("time")))


_SEVERAL = "SELECT l_orderkey AS iteration, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1"


def _several(spark, sf):
    e = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("iteration")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("s"))
    return e.select(F.lit("q").alias("name"), "iteration", F.transform("s", lambda x: x["l_quantity"]).alias("v"))


@query(f"WITH e AS ({_SEVERAL}) SELECT 'q' AS name, iteration, v[1] AS value FROM e WHERE len(v) = 1")
def curve_several_ignored(spark, sf):
    return curves.several(_several(spark, sf), "v", "ignore")


@query(f"WITH e AS ({_SEVERAL}) SELECT 'q_' || (k - 1) AS name, iteration, v[k] AS value FROM e, range(1, len(v) + 1) g(k)")
def curve_several_split(spark, sf):
    return curves.several(_several(spark, sf), "v", "split")


@query("SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'Mesh0_' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN 'SD' || (user_id % 4) || '_' ELSE '' END || event_type AS name FROM events")
def history_scope_names(spark, sf):
    e = t(spark, sf, "events")
    mesh = F.when(F.col("event_id") % 3 == 0, F.lit("Mesh0"))
    part = F.when(F.col("event_id") % 2 == 0, F.col("user_id") % 4)
    return e.select(curves.scope_name(F.col("event_type"), mesh, part).alias("name")).distinct()


@query(f"SELECT event_type AS name, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def history_transform(spark, sf):
    import pandas as pd

    def total(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": f["name"].iloc[:1], "n": [len(f)], "total": [float(f["value"].sum())]})

    return scan.transform_curves(_history(spark, sf), "name", total, "name string, n long, total double").withColumn("total", r("total", 3))


# ---------------------------------------------------------------- random numbers

_M = "4294967295"


def _psdes_sql(key: int, counter: str, table: str) -> str:
    steps, at = [f"r0 AS (SELECT {counter} AS c, {key}::UBIGINT AS l, ({counter})::UBIGINT AS r FROM {table})"], 0
    for a, b in zip(random.PSDES_1, random.PSDES_2, strict=True):
        steps.append(f"a{at} AS (SELECT c, l, r, xor(r, {a}::UBIGINT) & 65535 AS lo, xor(r, {a}::UBIGINT) >> 16 AS hi FROM r{at})")
        steps.append(f"b{at} AS (SELECT c, l, r, lo, hi, (lo * lo + ({_M}::UBIGINT - ((hi * hi) & {_M}))) & {_M} AS m FROM a{at})")
        steps.append(f"r{at + 1} AS (SELECT c, r AS l, xor(l, (xor((m >> 16) | ((m & 65535) << 16), {b}::UBIGINT) + lo * hi) & {_M}) AS r FROM b{at})")
        at += 1
    return ", ".join(steps) + f", u AS (SELECT c, (l::DOUBLE * 4294967296.0 + r::DOUBLE) * 5.4210108624275222e-20 AS u FROM r{at})"


@query(f"WITH {_psdes_sql(7, 'o_orderkey', 'orders')} SELECT c AS o_orderkey, round(u, 9) AS u FROM u")
def random_counter(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", r(random.counter_uniform(F.col("o_orderkey"), 7), 9).alias("u"))


@query(f"WITH {_psdes_sql(11, 'o_orderkey', 'orders')} SELECT 1 + floor(u * 6)::BIGINT AS face, count(*) AS n FROM u GROUP BY 1")
def random_dice(spark, sf):
    o = t(spark, sf, "orders")
    return o.select(random.uniform_int(random.counter_uniform(F.col("o_orderkey"), 11), 1, 6).alias("face")).groupBy("face").agg(F.count("*").alias("n"))


@query(f"""WITH {_psdes_sql(3, 'o_orderkey', 'orders')}, v AS (SELECT c, u AS u1, u - floor(u * 1000) / 1000 AS w FROM u)
SELECT c AS o_orderkey, round(sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * w * 1000), 6) AS gauss, round(2 * u1 - 1, 6) AS z, round(sqrt(greatest(1 - (2 * u1 - 1) * (2 * u1 - 1), 0)) * cos(2 * pi() * w * 1000), 6) AS x FROM v""")
def random_shapes(spark, sf):
    o = t(spark, sf, "orders").withColumn("u1", random.counter_uniform(F.col("o_orderkey"), 3))
    u2 = (F.col("u1") - F.floor(F.col("u1") * 1000) / 1000) * 1000
    s = random.on_sphere(F.col("u1"), u2)
    return o.select("o_orderkey", r(random.normal(F.col("u1"), u2), 6).alias("gauss"), r(s["z"], 6).alias("z"), r(s["x"], 6).alias("x"))


# ---------------------------------------------------------------- distribution


@query("SELECT p_size // 10 * 5 + (p_partkey % 100) * 5 // 100 AS owner, count(*) AS n FROM (SELECT p_size - 1 AS p_size, p_partkey FROM part) GROUP BY 1")
def grid_owner(spark, sf):
    p = t(spark, sf, "part").select((F.col("p_size") - 1).alias("i"), (F.col("p_partkey") % 100).alias("j"))
    return distribution.grid_partition(p, {"i": (50, 5), "j": (100, 5)}).groupBy("owner").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT max(c_custkey) AS m FROM customer) SELECT c_custkey * 7 // (m + 1) AS owner, count(*) AS n FROM customer, n GROUP BY 1")
def row_owner(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey")
    n = c.agg(F.max("c_custkey")).first()[0] + 1
    return distribution.simple_rows(c, "c_custkey", n, 7).groupBy("owner").agg(F.count("*").alias("n"))


@query("SELECT l_partkey % 50 AS g, min(l_suppkey % 8) AS owner, count(*) AS n FROM lineitem GROUP BY 1")
def constrained_owner(spark, sf):
    f = t(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("g"), (F.col("l_suppkey") % 8).alias("owner"))
    return distribution.constrained(f, "g").groupBy("g", "owner").agg(F.count("*").alias("n")).select("g", "owner", "n")


@query("SELECT o_custkey % 8 AS owner, count(*) AS n, round(sum(o_totalprice), 2) AS weight FROM orders GROUP BY 1")
def owner_balance(spark, sf):
    o = t(spark, sf, "orders").withColumn("owner", F.col("o_custkey") % 8)
    return distribution.balance(o, weight=F.col("o_totalprice")).withColumn("weight", r("weight", 2))


@query("SELECT l_orderkey AS uid, min(l_suppkey) AS value FROM lineitem GROUP BY 1")
def synchronized_values(spark, sf):
    f = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_suppkey").alias("part"))
    owner = f.groupBy("uid").agg(F.min("part").alias("owner"))
    copies = f.join(owner, "uid").withColumn("value", F.col("part"))
    return distribution.synchronize(copies, "uid", "owner", "part").select("uid", "value")


@query("SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS range, count(*) AS n FROM orders GROUP BY o_custkey, o_orderkey QUALIFY true")
def sub_ranges(spark, sf):
    p = distribution.by_position(t(spark, sf, "orders"), "o_custkey", ["o_orderkey"], 4)
    return p.select("o_custkey", "range", F.lit(1).cast("long").alias("n"))


@query("SELECT o_custkey % 6 AS rank, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def routed_rows(spark, sf):
    o = distribution.route(t(spark, sf, "orders").withColumn("rank", F.col("o_custkey") % 6), "rank")
    alone = o.withColumn("p", F.spark_partition_id()).groupBy("rank").agg(F.countDistinct("p").alias("p"), F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
    return alone.filter("p = 1").select("rank", "n", "total")


# ---------------------------------------------------------------- relations


@query("""
WITH f AS (SELECT l_orderkey AS uid, list_sort(list(l_partkey)) AS k FROM lineitem GROUP BY 1), u AS (SELECT k, min(uid) AS uid FROM f GROUP BY 1 HAVING count(*) = 1)
SELECT f.uid AS pos, u.uid AS uid FROM f JOIN u USING (k)
""")
def faces_by_nodes(spark, sf):
    e = t(spark, sf, "lineitem")
    faces = e.groupBy(F.col("l_orderkey").alias("uid")).agg(F.sort_array(F.collect_list("l_partkey")).alias("nodes"))
    once = faces.groupBy("nodes").agg(F.min("uid").alias("uid"), F.count("*").alias("n")).filter("n = 1").select("uid", "nodes")
    turned = faces.select(F.col("uid").alias("pos"), F.reverse("nodes").alias("nodes"))
    return relations.by_node_tuple(turned, once).filter("uid is not null").select("pos", "uid")


@query("SELECT c_nationkey AS parent, count(*) AS n FROM customer GROUP BY 1")
def parent_children(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("parent_uid"))
    m = relations.transpose_mesh(c)
    return m.groupBy(F.col(m.columns[0]).alias("parent")).agg(F.count("*").alias("n")) if "parent_uid" not in m.columns else m.groupBy(F.col("parent_uid").alias("parent")).agg(F.count("*").alias("n"))


@query("""
SELECT kind, count(*) AS n, min(uid) AS low, max(uid) AS high FROM (SELECT 'customer' AS kind, c_custkey AS uid FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part) GROUP BY 1
""")
def items_of_families(spark, sf):
    uid = lambda name, c: t(spark, sf, name).select(F.col(c).alias("uid"))
    every = relations.any_items(customer=uid("customer", "c_custkey"), supplier=uid("supplier", "s_suppkey"), part=uid("part", "p_partkey"))
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.min("uid").alias("low"), F.max("uid").alias("high"))


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem),
a AS (SELECT src, CASE WHEN dst % 10 = 3 THEN -dst ELSE dst END AS dst FROM e), b AS (SELECT * FROM a WHERE NOT (src % 5 = 0 AND dst >= 0))
SELECT * FROM b UNION ALL SELECT o_orderkey, -1000000 FROM orders WHERE o_orderkey % 100 = 0
""")
def incremental_links(spark, sf):
    e = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    swap = e.filter("dst % 10 = 3").select("src", F.col("dst").alias("old"), (-F.col("dst")).alias("new"))
    gone = e.filter("src % 5 = 0 and dst % 10 <> 3").select("src", "dst")
    more = t(spark, sf, "orders").filter("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("src"), F.lit(-1000000).cast("long").alias("dst"))
    return relations.incremental(e, more, gone, swap).select("src", "dst")


@query("SELECT o_orderkey AS uid, CASE WHEN o_totalprice > 200000 THEN 0 ELSE CAST(o_custkey AS DOUBLE) END AS value FROM orders")
def filled_items(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").cast("double").alias("value"), "o_totalprice")
    writes = groups.apply_if(o, F.col("o_totalprice") > 200000).select("uid", F.lit(0.0).alias("value"), F.lit(0).alias("turn"))
    return relations.overwrite(o.select("uid", "value"), "uid", "value", writes).select("uid", "value")


# ---------------------------------------------------------------- matrices and solvers


@query("SELECT l_partkey AS row, l_orderkey AS col, round(sum(l_quantity) * 2.5, 6) AS value FROM lineitem GROUP BY 1, 2")
def matrix_transpose_scaled(spark, sf):
    return linalg.scale(linalg.transpose(linalg.assemble(_coo(spark, sf))), 2.5).withColumn("value", r("value", 6))


@query("SELECT l_orderkey AS row, l_partkey AS col, arg_max(l_quantity, l_linenumber * 1000 + l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def matrix_set_values(spark, sf):
    return linalg.assemble(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("value"), (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("seq")), "set", "seq")


@query("""
WITH i AS (SELECT 'o' AS var, o_orderkey AS item, o_orderkey AS id FROM orders UNION ALL SELECT 'p', p_partkey, 10000000 + p_partkey FROM part)
SELECT a.id AS row, b.id AS col, sum(l_quantity) AS value FROM lineitem JOIN i a ON a.var = 'o' AND a.item = l_orderkey JOIN i b ON b.var = 'p' AND b.item = l_partkey GROUP BY 1, 2
""")
def matrix_by_keys(spark, sf):
    o = t(spark, sf, "orders").select(F.lit("o").alias("var"), F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("id"))
    p = t(spark, sf, "part").select(F.lit("p").alias("var"), F.col("p_partkey").alias("item"), (F.col("p_partkey") + 10000000).alias("id"))
    e = t(spark, sf, "lineitem").select(F.lit("o").alias("row_var"), F.col("l_orderkey").alias("row_item"), F.lit("p").alias("col_var"), F.col("l_partkey").alias("col_item"), F.col("l_quantity").alias("value"))
    return linalg.assemble_keys(e, o.union(p))


@query("SELECT p_partkey AS id, CASE WHEN p_size = 10 THEN NULL ELSE round(p_retailprice / (p_size - 10), 6) END AS value FROM part")
def vector_quotient(spark, sf):
    x = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))
    y = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 10).cast("double").alias("value"))
    return linalg.pointwise(x, linalg.reciprocal(y)).withColumn("value", r("value", 6))


@query("""
WITH x AS (SELECT p_partkey AS k, p_retailprice AS a, p_size::DOUBLE AS b FROM part)
SELECT l_orderkey AS id, round(sum(l_quantity * a + l_tax * b), 3) AS v0, round(sum(l_discount * a + l_quantity * b), 3) AS v1 FROM lineitem JOIN x ON k = l_partkey GROUP BY 1
""")
def block_product(spark, sf):
    q, d, s = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    a = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.array(F.array(q, s), F.array(d, q)).alias("value"))
    x = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_retailprice", F.col("p_size").cast("double")).alias("value"))
    y = linalg.block_spmv(a, x)
    return y.select("id", r(F.col("value")[0], 3).alias("v0"), r(F.col("value")[1], 3).alias("v1"))


def _system(spark, sf):
    """A diagonally dominant symmetric system over the nations: customers against suppliers."""
    c = t(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count("*").cast("double").alias("n"))
    pairs = c.select(F.col("id").alias("row")).join(F.broadcast(c.select(F.col("id").alias("col"))), F.abs(F.col("row") - F.col("col")) == 1)  # nations: a fixed list
    near = pairs.select("row", "col", F.lit(-1.0).alias("value"))
    middle = c.select(F.col("id").alias("row"), F.col("id").alias("col"), (F.col("n") + 3).alias("value"))
    b = t(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(r(F.sum("c_acctbal"), 2).alias("value"))
    return near.union(middle), b


_RIGHT = "SELECT c_nationkey::BIGINT AS id, round(round(sum(c_acctbal), 2) + 0.003, 1) AS value FROM customer GROUP BY 1"


def _back(a, x):
    # right sides have two decimals: a little more keeps them off the border between two roundings
    return linalg.spmv(a, x).withColumn("value", r(F.col("value") + 0.003, 1))


@query(_RIGHT)
def solve_cg(spark, sf):
    a, b = _system(spark, sf)
    return _back(a, linalg.conjugate_gradient(a, b)[0])


@query(_RIGHT)
def solve_bicgstab(spark, sf):
    a, b = _system(spark, sf)
    return _back(a, linalg.bicgstab(a, b)[0])


@query(_RIGHT)
def solve_richardson(spark, sf):
    a, b = _system(spark, sf)
    return _back(a, linalg.richardson(a, b, eps=1e-12)[0])


@query(_RIGHT)
def solve_direct(spark, sf):
    a, b = _system(spark, sf)
    return _back(a, linalg.solve_dense(a, b))


@query("SELECT c_nationkey::BIGINT AS row, c_nationkey::BIGINT AS col, 1.0::DOUBLE AS value FROM customer GROUP BY 1")
def inverse_times_matrix(spark, sf):
    a, b = _system(spark, sf)
    return linalg.matmul(linalg.inverse_dense(a, b), a).withColumn("value", r("value", 6)).filter("value <> 0")


@query("WITH n AS (SELECT c_nationkey::BIGINT AS id, count(*) + 3.0 AS d, round(sum(c_acctbal), 2) AS b FROM customer GROUP BY 1) SELECT id, round(b / d, 6) AS value FROM n")
def solve_diagonal_only(spark, sf):
    a, b = _system(spark, sf)
    return linalg.preonly(a, b)[0].withColumn("value", r("value", 6))


# ---------------------------------------------------------------- materials


@query("SELECT l_orderkey AS cell, l_suppkey AS env, l_partkey AS mat FROM lineitem WHERE l_suppkey = 3")
def material_component(spark, sf):
    return materials.component(_bridge(spark, sf), "all", env=3).select("cell", "env", "mat")


@query("""
WITH n AS (SELECT l_orderkey AS c, count(DISTINCT l_suppkey) AS e FROM lineitem GROUP BY 1)
SELECT l_orderkey AS cell, count(*) AS n FROM lineitem JOIN n ON c = l_orderkey WHERE l_suppkey = 3 AND e > 1 GROUP BY 1
""")
def material_impure(spark, sf):
    b = _bridge(spark, sf)
    return materials.component(b, "impure", env=3).groupBy("cell").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey AS cell, l_suppkey AS env, l_partkey AS mat FROM lineitem WHERE l_partkey % 7 <> 0 UNION SELECT o_orderkey, 0, 0 FROM orders")
def material_add_remove(spark, sf):
    b = _bridge(spark, sf).select("cell", "env", "mat").distinct()
    gone = b.filter("mat % 7 = 0").select("cell", "mat").distinct()
    new = t(spark, sf, "orders").select(F.col("o_orderkey").alias("cell"), F.lit(0).cast("long").alias("env"), F.lit(0).cast("long").alias("mat"))
    return materials.add_cells(materials.remove_cells(b, gone), new).select("cell", "env", "mat")


@query("""
WITH b AS (SELECT l_orderkey AS cell, l_suppkey AS env, l_partkey AS mat, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3)
SELECT cell, env, mat, CASE WHEN mat % 2 = 0 THEN value ELSE -1.0 END AS value FROM b
""")
def material_backup_restore(spark, sf):
    b = _bridge(spark, sf).groupBy("cell", "env", "mat").agg(F.sum("value").alias("value"))
    saved = materials.backup(b.filter("mat % 2 = 0"), "value")
    return materials.restore(b.drop("value"), saved, "value", -1.0).select("cell", "env", "mat", "value")


@query("SELECT DISTINCT l_orderkey AS cell, l_partkey % 5 AS env, l_partkey AS mat FROM lineitem")
def material_rebuild(spark, sf):
    g = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("mat"), F.col("l_orderkey").alias("cell")).distinct()
    m = t(spark, sf, "part").select(F.col("p_partkey").alias("mat"), (F.col("p_partkey") % 5).alias("env"))
    return materials.rebuild(g, m).select("cell", "env", "mat")


# ---------------------------------------------------------------- checks, tables, sorts


@query("SELECT l_orderkey AS src, l_partkey AS dst, 'target' AS missing FROM lineitem WHERE l_partkey % 11 = 0")
def dangling_links(spark, sf):
    e = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"))
    p = t(spark, sf, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("uid"))
    return checks.dangling(e, o, p).select("src", "dst", F.lit("target").alias("missing"))


@query("SELECT l_partkey AS uid FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 4) > 1")
def owner_conflict_uids(spark, sf):
    f = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("uid"), (F.col("l_suppkey") % 4).alias("owner"))
    return checks.owner_conflicts(f).select("uid").distinct()


@query("SELECT DISTINCT l_suppkey AS uid FROM lineitem WHERE l_suppkey % 3 = 0")
def stray_group_members(spark, sf):
    g = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("uid")).distinct()
    return checks.stray_members(g, t(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("uid"))).select("uid")


@query("""
WITH e AS (SELECT abs(p_retailprice - (900 + p_size)) AS d, p_size::DOUBLE AS w FROM part)
SELECT round(sum(d * w), 2) AS l1, round(sqrt(sum(d * d * w)), 3) AS l2, round(max(d), 6) AS top FROM e
""")
def error_norms(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("uid"), F.col("p_retailprice").alias("value"), "p_size")
    e = checks.error_estimate(p, F.lit(900.0) + F.col("p_size"), F.col("p_size").cast("double"))
    a, b, c = e.columns
    return e.select(r(a, 2).alias("l1"), r(b, 3).alias("l2"), r(c, 6).alias("top"))


@query("""
WITH v AS (SELECT p_partkey AS uid, p_retailprice AS value FROM part)
SELECT DISTINCT a.uid AS uid FROM v a JOIN v b ON abs(a.uid - b.uid) = 1 WHERE abs(a.value - b.value) > 90
""")
def jump_flags(spark, sf):
    v = t(spark, sf, "part").select(F.col("p_partkey").alias("uid"), F.col("p_retailprice").alias("value"))
    pairs = v.select(F.col("uid").alias("a"), F.explode(F.array(F.col("uid") - 1, F.col("uid") + 1)).alias("b"))
    return checks.refinement_flags(v, pairs, 90.0).select("uid").distinct()


@query("SELECT c_mktsegment AS name, printf('%.2f', avg(c_acctbal)) AS fixed, printf('%.3e', sum(c_acctbal)) AS scientific FROM customer GROUP BY 1")
def formatted_numbers(spark, sf):
    c = t(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.avg("c_acctbal").alias("a"), F.sum("c_acctbal").alias("s"))
    return c.select("name", tables.formatted(F.col("a"), 2).alias("fixed"), tables.formatted(F.col("s"), 3, "scientific").alias("scientific"))


@query("SELECT n_regionkey AS n_regionkey, list_sort(list(n_nationkey))[1:3] AS first FROM nation GROUP BY 1")
def first_of_each(spark, sf):
    n = t(spark, sf, "nation").groupBy("n_regionkey").agg(F.slice(F.sort_array(F.collect_list("n_nationkey")), 1, 3).alias("first"))
    return n.select("n_regionkey", "first")


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 150000) AS n_errors, o_orderkey AS uid FROM orders WHERE o_totalprice > 150000 ORDER BY o_orderkey LIMIT 10")
def first_ten_errors(spark, sf):
    bad = t(spark, sf, "orders").filter("o_totalprice > 150000").select(F.col("o_orderkey").alias("uid"))
    head, number = sort.first_errors(bad, 10, "uid")
    n = number.select(F.col(number.columns[0]).alias("n_errors"))
    return head.select("uid").join(F.broadcast(n)).select("n_errors", "uid")


@query("SELECT i, j, (i >= 10 AND i < 20 AND j >= 2 AND j < 6) AS in_patch, (i >= 8 AND i < 22 AND j >= 0 AND j < 8) AND NOT (i >= 10 AND i < 20 AND j >= 2 AND j < 6) AS overlap FROM (SELECT DISTINCT p_size AS i, p_partkey % 25 AS j FROM part) WHERE i >= 8 AND i < 22 AND j >= 0 AND j < 8")
def patch_overlap(spark, sf):
    c = t(spark, sf, "part").select(F.col("p_size").alias("i"), (F.col("p_partkey") % 25).alias("j")).distinct()
    o = amr.overlap_layer(c, (10, 2, 20, 6), 2)
    return o.filter("in_patch or overlap").select("i", "j", "in_patch", "overlap")


@query("""
WITH s AS (SELECT s_suppkey AS uid, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier)
SELECT uid AS uid, uid AS known FROM s
""")
def coordinate_lookup(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") * 1.0).alias("z"))
    moved = s.select((F.col("uid") + 1000000).alias("uid"), (F.col("x") + 1e-4).alias("x"), "y", "z")
    found = spatial.coordinate_uids(moved, s, 1e-3)
    known = next(c for c in found.columns if c not in ("uid", "x", "y", "z"))
    return found.select((F.col("uid") - 1000000).alias("uid"), F.col(known).alias("known"))


# ---------------------------------------------------------------- files


@query("SELECT n_regionkey::VARCHAR AS row, 'c' || (n_nationkey % 5) AS col, round(sum(n_nationkey * 1.25::DOUBLE), 6) AS value FROM nation GROUP BY 1, 2")
def csv_table_round_trip(spark, sf):
    n = t(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("string").alias("row"), F.concat(F.lit("c"), F.col("n_nationkey") % 5).alias("col")).agg(F.sum(F.col("n_nationkey") * 1.25).alias("value"))
    path = _folder(spark)
    sinks.write_csv_table(n, path, "nations")
    return files.csv_table(spark, path).filter("value is not null").select("row", "col", r("value", 6).alias("value"))


@query("SELECT s_suppkey AS uid, s_acctbal AS value FROM supplier")
def checkpoint_round_trip(spark, sf):
    store = sinks.Checkpoints(spark, _folder(spark))
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_acctbal").alias("value"))
    store.write(1, {"s": s.withColumn("value", F.lit(0.0))})
    store.write(2, {"s": s})
    return store.read()[0]["s"]


@query("SELECT 3 AS iteration, o_orderkey AS uid, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'")
def post_process_round_trip(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    path = _folder(spark)
    group = o.filter("o_orderstatus = 'F'").select("uid")
    sinks.post_process(o, path, 3, 0.5, ["price"], group)
    sinks.post_process(o, path, 3, 0.5, ["price"], group)
    return sinks.read_post(spark, path).select(F.col("iteration").cast("int").alias("iteration"), "uid", "price")


@query("SELECT c_custkey, c_acctbal FROM customer")
def sorted_write_round_trip(spark, sf):
    path = _folder(spark)
    sinks.sorted_write(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), path, "c_acctbal", "c_custkey")
    return spark.read.parquet(path)


@query("SELECT count(*) AS n, 0::BIGINT AS n_different FROM supplier")
def reference_verify(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_acctbal").alias("bal"))
    path = _folder(spark)
    sinks.reference_file(s, path, "uid", ["bal"])
    now = s.select(F.lit("bal").alias("name"), "uid", (F.col("bal") * (1 + 1e-12)).alias("value"))
    v = tables.verify(spark.read.parquet(path), now, 1e-9)
    a, b = [c for c in v.columns if c != "name"]
    return v.select(F.col(a).alias("n"), F.col(b).alias("n_different"))


# ---------------------------------------------------------------- programs

_HEAT = """
e AS (SELECT l_orderkey AS c, l_partkey AS p FROM lineitem),
n1 AS (SELECT p, avg(o_totalprice) AS v FROM e JOIN orders ON o_orderkey = c GROUP BY 1), c1 AS (SELECT c, avg(v) AS v FROM e JOIN n1 USING (p) GROUP BY 1)"""


@query(f"WITH {_HEAT}, n2 AS (SELECT p, avg(v) AS v FROM e JOIN c1 USING (c) GROUP BY 1), c2 AS (SELECT c, avg(v) AS v FROM e JOIN n2 USING (p) GROUP BY 1) SELECT c AS uid, round(v, 4) AS t FROM c2")
def heat(spark, sf):
    edges = relations.relation(t(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    cells = t(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_totalprice").alias("t"))
    return programs.heat(cells, edges, None, 2).select("uid", r("t").alias("t"))


@query("""
WITH e AS (SELECT l_orderkey AS c, l_partkey AS p FROM lineitem),
b0 AS (SELECT DISTINCT p, CASE WHEN p % 10 = 0 THEN 100.0 ELSE 0.0 END AS v FROM e), c1 AS (SELECT c, avg(v) AS v FROM e JOIN b0 USING (p) GROUP BY 1),
b1 AS (SELECT p, CASE WHEN p % 10 = 0 THEN 100.0 ELSE avg(v) END AS v FROM e JOIN c1 USING (c) GROUP BY 1), c2 AS (SELECT c, avg(v) AS v FROM e JOIN b1 USING (p) GROUP BY 1)
SELECT c AS uid, round(v, 6) AS t FROM c2
""")
def poisson(spark, sf):
    edges = relations.relation(t(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    cells = t(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), F.lit(0.0).alias("t"))
    hot = t(spark, sf, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("uid"), F.lit(100.0).alias("value"), F.lit(0).alias("turn"))
    return programs.poisson(cells, edges, hot, tolerance=1e-9, most=2)[0].select("uid", r("t", 6).alias("t"))


_GRID = "SELECT i, j, round(sum(p_retailprice), 2) AS v FROM (SELECT (p_size - 1)::BIGINT AS i, p_partkey % 8 AS j, p_retailprice FROM part UNION ALL SELECT a.range, b.range, 0 FROM range(50) a, range(8) b) GROUP BY 1, 2"


def _diffuse(source: str) -> str:
    near = f"SELECT a.i, a.j, sum(b.v) AS s, count(*) AS n FROM {source} a JOIN {source} b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY 1, 2"
    return f"SELECT g.i, g.j, g.v + 0.1 * (m.s - m.n * g.v) AS v FROM {source} g JOIN ({near}) m USING (i, j)"


@query(f"WITH g0 AS ({_GRID}), g1 AS ({_diffuse('g0')}), g2 AS ({_diffuse('g1')}) SELECT i, j, round(v, 4) AS v FROM g2")
def stencil(spark, sf):
    some = t(spark, sf, "part").select((F.col("p_size") - 1).cast("long").alias("i"), (F.col("p_partkey") % 8).alias("j"), F.col("p_retailprice").alias("v"))
    none = spark.range(400).select(F.floor(F.col("id") / 8).alias("i"), (F.col("id") % 8).alias("j"), F.lit(0.0).alias("v"))
    grid = some.union(none).groupBy("i", "j").agg(r(F.sum("v"), 2).alias("v"))
    return programs.stencil(grid, (50, 8), 2).withColumn("v", r("v"))


# one step of the shock tube: only the plane between the halves moves, by the pressures' difference
@query("""
WITH k AS (SELECT 100 AS nx, 0.001 AS dt, 1.4 AS g, 0.01 AS dx, 0.1 / 15 * 0.1 / 15 AS a), v AS (SELECT *, dt * (1.0 - 0.1) * a / (dx * a * (1.0 + 0.125) / 2) AS v FROM k),
c AS (SELECT range AS i, CASE WHEN range < nx / 2 THEN 1.0 ELSE 0.125 END AS d0, CASE WHEN range < nx / 2 THEN 1.0 ELSE 0.1 END AS p0,
 (dx + CASE WHEN range = nx / 2 - 1 THEN dt * v WHEN range = nx / 2 THEN -dt * v ELSE 0 END) / dx AS q, g FROM range(100), v),
e AS (SELECT i, d0 / q AS d, p0 / ((g - 1) * d0) * (1 + 0.5 * (g - 1) * (1 - q)) / (1 + 0.5 * (g - 1) * (1 - 1 / q)) AS e, g FROM c)
SELECT i, 225::BIGINT AS n, round(d, 9) AS density, round(e, 9) AS energy, round((g - 1) * d * e, 9) AS pressure FROM e
""")
def hydro_sod(spark, sf):
    hydro, walls = programs.sod_case(spark, 100, 15, 15)
    hydro.step(1e-3, walls)
    plane = hydro.edges.groupBy(F.col("src").alias("uid")).agg(F.min("dst").alias("corner")).withColumn("i", F.col("corner") % 101)
    c = hydro.cell.join(plane, "uid").groupBy("i").agg(F.count("*").alias("n"), *(r(F.avg(x), 9).alias(x) for x in ("density", "energy", "pressure")))
    return c.select("i", "n", "density", "energy", "pressure")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN o_totalprice * 2 + 1 ELSE sqrt(o_totalprice) END AS value FROM orders")
def user_function(spark, sf):
    from ..functions import piecewise

    piecewise.register("bent", lambda x: F.when(x < 100000, x * 2 + 1).otherwise(F.sqrt(x)))
    return t(spark, sf, "orders").select("o_orderkey", piecewise.call("bent", F.col("o_totalprice")).alias("value"))


@query(f"SELECT event_type AS name, {_DAY} AS iteration, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def stream_last_wins(spark, sf):
    from .. import streaming

    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    history = events.select(F.col("event_type").alias("name"), F.floor(F.unix_timestamp("ts") / 86400).cast("long").alias("iteration"), F.col("event_id").alias("seq"), "value")
    path, place = _folder(spark), _folder(spark)
    streaming.each_batch(history, streaming.upsert_into(path, ["name", "iteration"], "seq"), place).awaitTermination()
    last = max(int(p) for p in _numbers(spark, f"{place}/commits"))
    return streaming.current(spark, path, last).select("name", "iteration", "value")


def _numbers(spark, folder: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return [s.getPath().getName() for s in listed if s.getPath().getName().isdigit()]
