import io
import tarfile

import pytest
from pyspark.sql import functions as F

from lattica.sources import files, generators, meshes, sinks

MSH = """$MeshFormat
4.1 0 8
$EndMeshFormat
$PhysicalNames
1
2 1 "top side"
$EndPhysicalNames
$Entities
1 0 1 0
1 0 0 0 0
1 0 0 0 1 1 0 1 1 0
$EndEntities
$Nodes
1 4 1 4
2 1 0 4
1
2
3
4
0 0 0
1 0 0
1 1 0
0 1 0
$EndNodes
$Elements
1 2 1 2
2 1 2 2
1 1 2 3
2 1 3 4
$EndElements
"""

VTK = """# vtk DataFile Version 2.0
title
ASCII
DATASET UNSTRUCTURED_GRID
POINTS 4 float
0 0 0 1 0 0 1 1 0 0 1 0
CELLS 1 5
4 0 1 2 3
CELL_TYPES 1
9
POINT_DATA 4
SCALARS GROUP_left int 1
LOOKUP_TABLE default
1 0 0 1
"""


def test_mesh_files(spark, tmp_path):
    (tmp_path / "a.msh").write_text(MSH)
    (tmp_path / "b.vtk").write_text(VTK)
    (tmp_path / "skip.txt").write_text("x")
    every = meshes.read(spark, str(tmp_path))
    msh = meshes.tables(every.filter(F.col("file").endswith(".msh")))
    assert msh["node"].count() == 4 and msh["cell"].count() == 2
    assert sorted((r.src, r.pos, r.dst) for r in msh["cell_node"].collect())[:3] == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert sorted(map(tuple, msh["cell_group"].collect())) == [("top side", 1), ("top side", 2)]
    vtk = meshes.tables(every.filter(F.col("file").endswith(".vtk")))
    assert vtk["cell"].first().type == 9 and sorted(r.uid for r in vtk["node_group"].collect()) == [0, 3]
    meshes.register(spark)
    again = spark.read.format("lattica_mesh").load(str(tmp_path))
    assert again.count() == every.count()
    (tmp_path / "c.vtu").write_text(sinks.vtu_text({"node": vtk["node"], "cell": vtk["cell"], "cell_node": vtk["cell_node"]}))
    vtu = meshes.tables(meshes.read(spark, str(tmp_path / "c.vtu")))
    assert vtu["node"].count() == 4 and vtu["cell_node"].count() == 4
    with pytest.raises(ValueError):
        list(meshes.parse_msh("$MeshFormat\n2.2 0 8\n"))


def test_generators(spark):
    m = generators.cartesian(spark, (3, 2, 2), (3.0, 2.0, 2.0))
    assert m["cell"].count() == 12 and m["node"].count() == 36 and m["cell_node"].count() == 96
    box = m["cell_node"].join(m["node"], F.col("dst") == F.col("uid")).groupBy("src").agg((F.max("x") - F.min("x")).alias("w"), F.countDistinct("uid").alias("n")).collect()
    assert all(abs(b.w - 1) < 1e-12 and b.n == 8 for b in box)
    faces = generators.cartesian_faces(m["cell"], (3, 2, 2))
    assert faces.count() == 4 * 4 + 3 * 3 * 2 + 3 * 2 * 3
    stretched = generators.cartesian(spark, (4,), (15.0,), ratios=(2.0,))["node"].orderBy("uid").collect()
    assert [round(n.x, 9) for n in stretched] == [0, 1, 3, 7, 15]
    assert generators.honeycomb(spark, 3, 1.0).count() == 19
    s = generators.simple_mesh(spark)
    assert s["cell"].count() == 3 and s["cell_node"].count() == 19
    tube = generators.sod_tube(spark, 4, 1, 1)
    assert {r.group for r in tube["node_group"].select("group").distinct().collect()} == {f"{a}{b}" for a in "XYZ" for b in ("MIN", "MAX")}


def test_tables_and_curves(spark, tmp_path):
    (tmp_path / "t.csv").write_text("stats;it 1;it 2\n\nrow a;1,5;2\nrow b;3.25;\n")
    rows = {(r.row, r.col): r.value for r in files.csv_table(spark, str(tmp_path / "t.csv")).collect()}
    assert rows == {("row a", "it 1"): 1.5, ("row a", "it 2"): 2.0, ("row b", "it 1"): 3.25, ("row b", "it 2"): None}
    (tmp_path / "bad.csv").write_text("t;a\nr;1;2\n")
    with pytest.raises(Exception, match="3 columns"):
        files.csv_table(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "p.gp").write_text("# t v\n0 1.5\n1\t2.5\n")
    assert sorted(map(tuple, files.gnuplot_curves(spark, str(tmp_path / "p.gp")).collect())) == [("p", 0.0, 1.5), ("p", 1.0, 2.5)]
    table = spark.createDataFrame([("r", "b", 1.0), ("r", "a", 2.0)], "row string, col string, value double")
    sinks.write_csv_table(table, str(tmp_path / "out"), "name", 2)
    back = files.csv_table(spark, str(tmp_path / "out") + "/*.csv").collect()
    assert sorted((r.table, r.row, r.col, r.value) for r in back) == [("name", "r", "a", 2.0), ("name", "r", "b", 1.0)]


def test_matrices(spark, tmp_path):
    mtx = b"%%MatrixMarket matrix coordinate real symmetric\n% note\n2 2 2\n1 1 4.0\n2 1 -1.0\n"
    (tmp_path / "m.mtx").write_bytes(mtx)
    with tarfile.open(tmp_path / "m.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d/m.mtx")
        info.size = len(mtx)
        t.addfile(info, io.BytesIO(mtx))
    rows = files.matrix_market(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and {(r.row, r.col, r.value) for r in rows} == {(1, 1, 4.0), (2, 1, -1.0), (1, 2, -1.0)}


def test_case_and_hash_database(spark, tmp_path):
    case = files.Case('<case><loop><dt>0.5</dt></loop><v><variable nom="Density" valeur="1." groupe="ZG"/></v><functions><table name="f"><value><x>0</x><y>2</y></value><value><x>4</x><y>7</y></value></table></functions></case>', {"loop.max": 9})
    assert case.get("loop.dt", float) == 0.5 and case.get("loop.max") == 9 and case.initial_values() == {"Density": {"ZG": 1.0}}
    assert case.table("f") == [(0.0, 2.0), (4.0, 7.0)]
    with pytest.raises(KeyError):
        case.get("loop.none")
    db = files.HashDatabase(spark, str(tmp_path / "db"))
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "v string")
    keys = db.write(df, "v")
    db.write(df, "v")
    assert spark.read.parquet(str(tmp_path / "db")).count() == 2
    assert {bytes(r.value) for r in db.read(keys.select("key").distinct()).collect()} == {b"a", b"b"}


def test_checkpoints(spark, tmp_path):
    store = sinks.Checkpoints(spark, str(tmp_path / "c"))
    assert store.numbers() == []
    for n in (1, 5):
        store.write(n, {"cell": spark.range(n)}, time=n / 2)
    frames, info = store.read()
    assert frames["cell"].count() == 5 and info == {"time": 2.5, "number": 5} and store.numbers() == [1, 5]
    sinks.post_process(spark.createDataFrame([(1, 2.0)], "uid long, p double"), str(tmp_path / "post"), 3, 0.3, ["p"])
    assert sinks.read_post(spark, str(tmp_path / "post")).first().iteration == 3
