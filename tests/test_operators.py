import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import amr, curves, distribution, edits, graph, groups, linalg, materials, relations, scan, sort, spatial, tables


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_scan_edges(spark):
    empty = spark.createDataFrame([], "k int, i int, v long")
    assert scan.scan(empty, F.col("v"), ["i"], ["k"]).count() == 0
    rows = [(1, i, v) for i, v in enumerate([5, -2, 7, 7])]
    df = spark.createDataFrame(rows, "k int, i int, v long")
    run = lambda **k: [r.scan for r in scan.scan(df, F.col("v"), ["i"], ["k"], **k).orderBy("i").collect()]
    assert run(init=10) == [15, 13, 20, 27]
    assert run(init=10, exclusive=True) == [10, 15, 13, 20]
    assert run(how="min", init=3, exclusive=True) == [3, 3, -2, -2]
    assert run(how="max", init=6) == [6, 6, 7, 7]
    assert run(exclusive=True) == [None, 5, 3, 10]


def test_gather_scatter_partition_of_unity(spark):
    e = edges(spark, [(1, 10), (1, 11), (2, 11), (3, 12)])
    v = spark.createDataFrame([(1, 6.0), (2, 4.0), (3, 1.0)], "uid long, v double")
    out = {r.dst: r.share for r in relations.scatter_share(e, v, "uid", "v").collect()}
    assert out == {10: 3.0, 11: 7.0, 12: 1.0}


def test_lookup_fatal(spark):
    items = spark.createDataFrame([(1, "a")], "uid long, n string")
    keys = spark.createDataFrame([(1,), (2,), (None,)], "key long")
    assert sorted((r.key or 0, r.n) for r in relations.lookup(keys, items, "key", "uid").collect()) == [(0, None), (1, "a"), (2, None)]
    with pytest.raises(Exception, match="no item with uid 2"):
        relations.lookup(keys, items, "key", "uid", fatal=True).collect()


def test_face_lookup_and_lists(spark):
    faces = spark.createDataFrame([(7, [3, 1, 2]), (8, [4, 5, 6])], "uid long, nodes array<long>")
    req = spark.createDataFrame([(0, [1, 2, 3]), (1, [9, 9, 9])], "pos long, nodes array<long>")
    assert sorted((r.pos, r.uid) for r in relations.by_node_tuple(req, faces).collect()) == [(0, 7), (1, None)]
    e = relations.from_lists(faces, "uid", "nodes")
    assert {r.src: list(r.targets) for r in relations.to_lists(e).collect()} == {7: [3, 1, 2], 8: [4, 5, 6]}


def test_incremental_relation(spark):
    e = edges(spark, [(1, 1), (1, 2), (2, 3)])
    out = relations.incremental(e, add=edges(spark, [(9, 9)]), remove=edges(spark, [(1, 2)]), replace=spark.createDataFrame([(2, 3, 4)], "src long, old long, new long"))
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 4), (9, 9)]


def test_canonical_nodes(spark):
    df = spark.createDataFrame([([3, 1, 2, 9],), ([9, 3, 1, 2],), ([2, 1, 3, 9],), ([5, 4],)], "n array<int>")
    got = [list(r[0]) for r in df.select(sort.canonical_nodes(F.col("n"))).collect()]
    assert got[0] == got[1] == got[2] == [1, 2, 9, 3] and got[3] == [4, 5]


def test_cuthill_mckee_reduces_bandwidth(spark):
    rng = np.random.default_rng(0)
    name = rng.permutation(60)
    pairs = spark.createDataFrame([(int(name[i]), int(name[i + 1])) for i in range(59)], "a long, b long")
    at = {r.uid: r.place for r in sort.cuthill_mckee(pairs).collect()}
    assert max(abs(at[r.a] - at[r.b]) for r in pairs.collect()) == 1


def test_graph(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (4, 3), (3, 5)])
    assert {r.uid: r.level for r in graph.levels(e).collect()} == {1: 0, 4: 0, 2: 1, 3: 2, 5: 3}
    assert not graph.has_cycle(e) and graph.has_cycle(edges(spark, [(1, 2), (2, 1)]))
    assert sorted(map(tuple, graph.spanning_tree(e).collect())) == [(1, 2), (2, 3), (3, 5)]


def test_refine_and_coarsen(spark):
    cells = spark.createDataFrame([(0, 0, True, None), (1, 0, True, None)], "uid long, level int, active boolean, parent_uid long")
    fine = edits.refine(cells, 4, F.col("uid") == 1)
    assert fine.filter("active").count() == 5 and fine.filter("level = 1 and parent_uid = 1").count() == 4
    back = edits.coarsen(fine, F.lit(True))
    assert sorted((r.uid, r.active) for r in back.collect()) == [(0, True), (1, True)]


def test_mesh_edits(spark):
    mesh = {"cell": spark.createDataFrame([(0, 9)], "uid long, type int"), "cell_node": spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "src long, pos int, dst long"), "node": spark.createDataFrame([(0,), (1,)], "uid long")}
    more = edits.add_cells(mesh, spark.createDataFrame([(5, 9, [1, 2])], "uid long, type int, nodes array<long>"))
    assert more["node"].count() == 3 and more["cell"].count() == 2
    less = edits.remove_cells(more, spark.createDataFrame([(0,)], "uid long"))
    assert sorted(r.uid for r in less["node"].collect()) == [1, 2]


def test_patches(spark):
    cells = [(i, j) for i in range(4) for j in range(3)] + [(i, j) for i in range(10, 14) for j in range(8, 12)]
    boxes = amr.patches(spark.createDataFrame(cells, "i long, j long"))
    assert boxes == [(0, 0, 4, 3), (10, 8, 14, 12)]
    assert amr.merge_patches([(0, 0, 2, 2), (2, 0, 4, 2), (9, 9, 10, 10)]) == [(0, 0, 4, 2), (9, 9, 10, 10)]


def test_rays(spark):
    faces = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 2.0, 1.0, 0.0, 2.0, 0.0, 1.0, 2.0)], "uid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    rays = spark.createDataFrame([(0, 0.2, 0.2, 0.0, 0.0, 0.0, 1.0, 5.0), (1, 3.0, 3.0, 0.0, 0.0, 0.0, 1.0, 5.0)], "uid long, px double, py double, pz double, dx double, dy double, dz double, reach double")
    got = {r.uid: (r.face_uid, r.distance) for r in spatial.ray_faces(rays, faces, 0.5).collect()}
    assert got == {0: (1, 1.0), 1: (None, None)}


def test_coordinate_uids(spark):
    known = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.05, 0.0, 0.0)], "uid long, x double, y double, z double")
    new = spark.createDataFrame([(7, 0.04, 0.0, 0.0), (8, 5.0, 0.0, 0.0)], "uid long, x double, y double, z double")
    assert {r.uid: r.found for r in spatial.coordinate_uids(new, known, 0.1).collect()} == {7: 2, 8: None}


def test_solvers(spark):
    n = 6
    m = np.diag([4.0] * n) + np.diag([-1.0] * (n - 1), 1) + np.diag([-1.0] * (n - 1), -1)
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "row long, col long, value double")
    b = spark.createDataFrame([(i, float(i + 1)) for i in range(n)], "id long, value double")
    want = np.linalg.solve(m, np.arange(1, n + 1))
    get = lambda x: np.array([r.value for r in x.orderBy("id").collect()])
    assert np.allclose(get(linalg.conjugate_gradient(a, b)[0]), want, atol=1e-8)
    assert np.allclose(get(linalg.solve_dense(a, b)), want)
    assert np.allclose(get(linalg.richardson(a, b, eps=1e-4, most=12)[0]), want, atol=1e-2)
    skew = m + np.diag([0.5] * (n - 1), 1)
    s = spark.createDataFrame([(i, j, float(skew[i, j])) for i in range(n) for j in range(n) if skew[i, j]], "row long, col long, value double")
    assert np.allclose(get(linalg.bicgstab(s, b)[0]), np.linalg.solve(skew, np.arange(1, n + 1)), atol=1e-6)


def test_block_product(spark):
    a = spark.createDataFrame([(0, 0, [[1.0, 2.0], [0.0, 1.0]]), (0, 1, [[1.0, 0.0], [0.0, 1.0]])], "row long, col long, value array<array<double>>")
    x = spark.createDataFrame([(0, [1.0, 1.0]), (1, [5.0, 7.0])], "id long, value array<double>")
    assert list(linalg.block_spmv(a, x).first().value) == [8.0, 8.0]


def test_interpolation_is_exact_on_polynomials():
    x = np.array([0.0, 1.0, 2.5, 4.0, 7.0])
    at = np.linspace(0, 7, 29)
    assert np.allclose(curves.interpolate(1, at, x, 3 * x - 1), 3 * at - 1)
    assert np.allclose(curves.interpolate(2, at, x, x**2 - x), at**2 - at)
    assert curves.interpolate(0, np.array([0.5, 1.75, 9.0]), x, x).tolist() == [1.0, 2.5, 0.0]


def test_curve_errors(spark):
    mk = lambda ys: spark.createDataFrame([("c", float(i), float(y)) for i, y in enumerate(ys)], "name string, x double, y double")
    ref, tgt = mk([-3, 2, 1, 4]), mk([-3, 2.5, -5, 4])
    got = {k: curves.errors(ref, tgt, k).first().error for k in curves.ERRORS}
    assert got["relative"] == 6.0 and got["relative_max"] == 1.5 and got["max"] == 0.25 and got["drbar"] == 0.0
    assert got["chronometry"] == 1.0 and abs(got["drift"] - abs((0.25 - 6) / 3)) < 1e-12
    assert curves.error_curves(ref, tgt, "relative", 1, 3).count() == 2


def reference_smooth(x, y, n):
    out = []
    for i in range(len(x)):
        if i in (0, len(x) - 1):
            out.append(y[i])
            continue
        zs = range(max(1, i - n), min(i + n, len(x) - 2))
        w = [(x[z + 1] + x[z - 1]) / 2 for z in zs]
        out.append(sum(a * y[z] for a, z in zip(w, zs, strict=True)) / sum(w) if w else float("nan"))
    return out


def test_smooth(spark):
    x, y = [1.0, 2.0, 4.0, 5.0, 9.0, 10.0, 12.0], [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    c = spark.createDataFrame([("a", p, q) for p, q in zip(x, y, strict=True)], "name string, x double, y double")
    for n in (1, 2, 10):
        got = [r.y for r in curves.smooth(c, n).orderBy("x").collect()]
        assert np.allclose(got, reference_smooth(x, y, n), equal_nan=True)


def test_simple_table(spark):
    t = tables.SimpleTable("t")
    t.add_row("r1")
    t.add_row("r2")
    t.add_column("c1", [1.0, 2.0])
    t.add_column("c2")
    assert t.add_in_row("r1", 5.0) and not t.add_in_row("r1", 6.0)
    assert t.row("r1") == [1.0, 5.0] and t.left() == 1.0 and t.up() is None and t.down() == 2.0
    assert t.edit("r2", "c2", 9.0) and not t.edit("zz", "c2", 1.0)
    t.add_average_column("mean")
    assert t.column("mean") == [3.0, 5.5]
    f = t.frame(spark)
    assert tables.compare(f, f).filter("not same").count() == 0 and tables.same_dimensions(f, f)
    assert not tables.compare_element(f, f, "r1", "nope") and tables.compare_element(f, f, "r1", "c1")


def test_materials(spark):
    b = spark.createDataFrame([(1, "e1", "m1", 1.0), (1, "e1", "m2", 2.0), (2, "e1", "m1", 3.0), (3, "e1", "m1", 4.0), (3, "e2", "m2", 5.0)], "cell long, env string, mat string, value double")
    p = {(r.cell, r.env, r.mat): (r.env_pure, r.mat_pure) for r in materials.purity(b).collect()}
    assert p[1, "e1", "m1"] == (True, False) and p[2, "e1", "m1"] == (True, True) and p[3, "e2", "m2"] == (False, False)
    assert materials.component(b, "pure", env="e1").count() == 3
    kept = materials.restore(materials.add_cells(b, spark.createDataFrame([(9, "e1", "m1", 0.0)], b.schema)), materials.backup(b, "value"), "value", -1.0)
    assert {r.cell: r.value for r in kept.filter("cell in (2, 9)").collect()} == {2: 3.0, 9: -1.0}


def test_distribution(spark):
    df = spark.createDataFrame([(i, i // 10 % 3) for i in range(60)], "i long, g long")
    o = distribution.grid_partition(df, {"i": (60, 4)})
    assert [r.n for r in distribution.balance(o).orderBy("owner").collect()] == [15] * 4
    c = distribution.constrained(o, "g")
    assert c.select("g", "owner").distinct().count() == 3
    rep = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 6.0), (2, 1, 1, 7.0)], "uid long, owner int, part int, v double")
    assert distribution.synchronize(rep, "uid", "owner", "part").count() == 2
    assert distribution.replica_check(rep, ["uid"], "v").count() == 1


def test_half_space_and_groups(spark):
    e = edges(spark, [(1, 1), (1, 2), (2, 2), (2, 3)])
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 2.0, 0.0, 0.0)], "uid long, x double, y double, z double")
    cells = spark.createDataFrame([(1,), (2,)], "uid long")
    assert [r.uid for r in groups.half_space(cells, e, nodes, [((1.0, 0, 0), (1.0, 0, 0))]).collect()] == [2]
    sub = groups.sub_mesh(cells, e, nodes, spark.createDataFrame([(2,)], "uid long"))
    assert sorted(r.uid for r in sub["node"].collect()) == [2, 3]


def test_checks_and_shapes(spark):
    from lattica.functions import shapes
    from lattica.operators import checks

    sides = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [2, 1])], "cell long, nodes array<long>")
    assert [tuple(r) for r in checks.misoriented(sides).collect()] == [(1, 2, 1, 2)]
    cells = spark.createDataFrame([(0, "hexaedron")], "uid long, type string")
    e = spark.createDataFrame([(0, i, i) for i in range(8)], "src long, pos int, dst long")
    assert shapes.faces(cells, e).count() == 6 and len(shapes.edges_of("hexaedron")) == 12 and len(shapes.edges_of("pyramid")) == 8
    quad = spark.createDataFrame([([[0.0, 0.0], [2.0, 0.0], [3.0, 2.0], [0.0, 1.0]], [1.0, 0.6])], "c array<array<double>>, p array<double>")
    u = shapes.inverse_map(quad, "c", "p", 2).first().iso
    corners = [dict(zip("xy", p, strict=True)) for p in ([0.0, 0.0], [2.0, 0.0], [3.0, 2.0], [0.0, 1.0])]
    back = spark.range(1).select(*(c.alias(a) for a, c in zip("xy", shapes.position([{k: F.lit(v) for k, v in p.items()} for p in corners], [F.lit(v) for v in u]), strict=True))).first()
    assert abs(back.x - 1.0) < 1e-9 and abs(back.y - 0.6) < 1e-9
    slaves = spark.createDataFrame([(1, 0.5, 0.05), (2, 5.0, 5.0)], "uid long, x double, y double")
    masters = spark.createDataFrame([(9, 0.0, 0.0, 1.0, 0.0), (8, 0.0, 0.2, 1.0, 0.2)], "uid long, ax double, ay double, bx double, by double")
    assert [(r.slave, r.master, r.t) for r in checks.tied_interface(slaves, masters, 0.1).collect()] == [(1, 9, 0.5)]
    c = spark.createDataFrame([(3, 0.5, 0.5, 1.0, 1.0)], "uid long, cx double, cy double, hx double, hy double")
    four = checks.subdivide(c, [(-0.25, -0.25), (0.25, -0.25), (0.25, 0.25), (-0.25, 0.25)])
    assert sorted((r.uid, r.cx, r.hx) for r in four.collect())[0] == (12, 0.25, 0.5)
    mesh = {"cell": cells, "cell_node": e, "node": spark.range(7).withColumnRenamed("id", "uid")}
    assert {r.check: r.n_bad for r in checks.check_mesh(mesh).collect()} == {"cell uids": 0, "node uids": 0, "cell_node": 1}
    with pytest.raises(ValueError):
        checks.Derived().add("a", ("b",), lambda b: b).add("b", ("a",), lambda a: a).dependencies("a")


def test_forces_by_blocks(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(150)] + [(150, None, 1.0, 1.0), (151, 1.0, 1.0, None), (7, 0.5, 0.5, 0.5)]
    bodies = spark.createDataFrame(rows, "uid long, x double, y double, z double")
    whole = [r for r in rows if None not in r]
    want = {150: None, 151: None}
    for u, *at in whole:
        d = np.array([o[1:] for o in whole]) - at
        want[u] = want.get(u, 0) + (d * ((d**2).sum(axis=1) + 0.5)[:, None] ** -1.5).sum(axis=0)
    for block in (40, 4096):
        got = {r.uid: r for r in spatial.n_body(bodies, 0.5, block).collect()}
        assert got.keys() == want.keys()
        for u, f in want.items():
            assert (got[u].fx is None and got[u].fz is None) if f is None else np.allclose([got[u].fx, got[u].fy, got[u].fz], f, rtol=1e-12)
    assert spatial.n_body(bodies.limit(0), 0.5).count() == 0


def test_connected_by_class(spark):
    s = spark.createDataFrame([(0,), (3,), (3,), (None,), (-3,)], "src long")
    d = spark.createDataFrame([(6,), (6,), (4,), (None,), (0,)], "dst long")
    e = spark.createDataFrame([(3, 6), (3, 6), (0, 4), (None, 6), (0, None), (0, 0)], "src long, dst long")
    got = relations.connected_by_class(s, d, e, lambda u: u % 3)
    assert sorted(tuple(r) for r in got.collect()) == [(-3, 0, False), (-3, 6, False), (0, 0, True), (0, 6, False), (3, 0, False), (3, 6, True)]
    # no pair is sent
    assert not re.search(r"hashpartitioning\(src#\d+L?, dst#", got._jdf.queryExecution().executedPlan().toString())
