"""Outputs: periods of post-processing, checkpoints, tables, curves, meshes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import formatted


def post_process(frame: DataFrame, path: str, iteration: int, time: float, variables: list[str], group: DataFrame | None = None) -> None:
    """One output step: chosen variables (of a group, if given) below ``iteration=n``; a step written again replaces itself."""
    out = frame if group is None else frame.join(group.select("uid"), "uid", "left_semi")
    out = out.select("uid", *variables).withColumn("time", F.lit(float(time)))
    out.write.mode("overwrite").parquet(f"{path}/iteration={iteration}")


def read_post(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sorted_write(frame: DataFrame, path: str, *keys: str) -> None:
    """Globally ordered files: a range partition each."""
    frame.orderBy(*keys).write.mode("overwrite").parquet(path)


class Checkpoints:
    """Numbered versions of a dict of frames with a manifest; readers see a version only once its manifest is there."""

    def __init__(self, spark: SparkSession, path: str, codec: str = "zstd"):
        self.spark, self.path, self.codec = spark, path, codec

    def write(self, number: int, frames: dict[str, DataFrame], **info) -> None:
        for name, f in frames.items():
            f.write.mode("overwrite").option("compression", self.codec).parquet(f"{self.path}/{number:08d}/{name}")
        note = json.dumps({"number": number, "frames": sorted(frames), "info": info})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{number:08d}/_manifest_")

    def numbers(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_manifest_/_SUCCESS")))

    def read(self, number: int | None = None) -> tuple[dict[str, DataFrame], dict]:
        """The frames and info of a version (the last without a number)."""
        known = self.numbers()
        if not known:
            raise ValueError(f"no checkpoint in {self.path}")
        number = known[-1] if number is None else number
        note = json.loads(self.spark.read.text(f"{self.path}/{number:08d}/_manifest_").first()[0])
        return {n: self.spark.read.parquet(f"{self.path}/{number:08d}/{n}") for n in note["frames"]}, note["info"] | {"number": number}


def write_csv_table(table: DataFrame, path: str, name: str, precision: int = 6, separator: str = ";") -> None:
    """A named table as one file: the name in the corner, columns across."""
    cols = [r[0] for r in table.select("col").distinct().orderBy("col").collect()]
    wide = table.groupBy("row").pivot("col", cols).agg(F.first("value")).orderBy("row")
    wide.select(F.col("row").alias(name), *(F.when(F.col(c).isNotNull(), formatted(F.col(c), precision)).alias(c) for c in cols)).coalesce(1).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_curves(curves: DataFrame, path: str) -> None:
    """Two columns per curve, a folder each."""
    ordered = curves.repartition("name").sortWithinPartitions("name", "x")
    ordered.select("name", F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def curves_json(curves: DataFrame) -> DataFrame:
    """``name, json``: each curve as one document; curves are bounded by their number of iterations."""
    pairs = F.array_sort(F.collect_list(F.struct("x", "y")))
    return curves.groupBy("name").agg(F.to_json(F.struct(F.transform(pairs, lambda p: p["x"]).alias("x"), F.transform(pairs, lambda p: p["y"]).alias("y"))).alias("json"))


def reference_file(frame: DataFrame, path: str, uid: str, variables: list[str]) -> None:
    """Values for later verification: ``name, uid, value``."""
    e = F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in variables))
    frame.select(F.col(uid).alias("uid"), F.explode(e).alias("e")).select("e.name", "uid", "e.value").write.mode("overwrite").parquet(path)


def vtu_text(mesh: dict[str, DataFrame], most: int = 1_000_000) -> str:
    """A small mesh as VTU text on the driver (refused beyond ``most`` cells)."""
    if mesh["cell"].count() > most:
        raise ValueError(f"more than {most} cells; write parquet instead")
    nodes = mesh["node"].orderBy("uid").collect()
    at = {n.uid: i for i, n in enumerate(nodes)}
    lists: dict[int, list[int]] = {}
    for e in mesh["cell_node"].orderBy("src", "pos").collect():
        lists.setdefault(e.src, []).append(at[e.dst])
    cells = mesh["cell"].orderBy("uid").collect()
    kind = "type" in mesh["cell"].columns
    ends, n = [], 0
    for c in cells:
        n += len(lists.get(c.uid, []))
        ends.append(n)
    array = lambda name, t, vs, k=1: f'<DataArray type="{t}" Name="{name}" NumberOfComponents="{k}" format="ascii">{" ".join(map(str, vs))}</DataArray>'
    points = [v for p in nodes for v in (p.x, p.y, p.z if "z" in mesh["node"].columns else 0.0)]
    body = array("Points", "Float64", points, 3)
    conn = array("connectivity", "Int64", [v for c in cells for v in lists.get(c.uid, [])])
    kinds = [c["type"] if kind else {4: 9, 8: 12, 3: 5, 6: 13, 5: 14}.get(len(lists.get(c.uid, [])), 7) for c in cells]
    return f'<VTKFile type="UnstructuredGrid" version="1.0" header_type="UInt64"><UnstructuredGrid><Piece NumberOfPoints="{len(nodes)}" NumberOfCells="{len(cells)}"><Points>{body}</Points><Cells>{conn}{array("offsets", "Int64", ends)}{array("types", "UInt8", kinds)}</Cells></Piece></UnstructuredGrid></VTKFile>'


def last_versions(frame: DataFrame, key: str, version: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return frame.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
