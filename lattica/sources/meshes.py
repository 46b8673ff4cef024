"""Mesh files: MSH 4.1, legacy VTK and VTU, as frames.

A file is read by Spark (``binaryFile``, so any file system Spark knows) and
parsed in the task that holds it, one file a task, many files at once.  Every
reader gives rows ``(file, kind, uid, type, nodes, x, y, z, group, parent)`` of
kinds node, cell, node_group, cell_group and entity, which ``tables`` splits.
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, kind string, uid long, type int, nodes array<long>, x double, y double, z double, group string, parent long"
_FIELDS = ("file", "kind", "uid", "type", "nodes", "x", "y", "z", "group", "parent")


def _row(**k) -> dict:
    return {f: k.get(f) for f in _FIELDS}


class Words:
    """Numbers and words of a text file in order; comments from a mark to the end of line are skipped."""

    def __init__(self, text: str, comment: str = "#"):
        self.lines = [line.split(comment)[0].split() if comment else line.split() for line in text.splitlines()]
        self.words = [w for line in self.lines for w in line]
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def word(self) -> str:
        self.at += 1
        return self.words[self.at - 1]

    def integer(self) -> int:
        return int(self.word())

    def real(self) -> float:
        return float(self.word())

    def find(self, name: str) -> bool:
        """Move behind the next occurrence of a word."""
        try:
            self.at = self.words.index(name, self.at) + 1
        except ValueError:
            return False
        return True


# ---------------------------------------------------------------- MSH 4.1

#: Nodes of each element type of the format (fixed values).
MSH_NODES = {1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 6: 6, 7: 5, 8: 3, 9: 6, 10: 9, 11: 10, 12: 27, 13: 18, 14: 14, 15: 1, 16: 8, 17: 20, 18: 15, 19: 13}


def parse_msh(text: str) -> Iterator[dict]:
    w = Words(text, "")
    if not w.find("$MeshFormat"):
        raise ValueError("not an MSH file")
    version, binary = w.real(), w.integer()
    if int(version) != 4 or binary:
        raise ValueError(f"MSH {version}{' binary' if binary else ''} is not supported; ASCII 4.1 is")
    physical: dict[tuple[int, int], str] = {}
    w.at = 0
    if w.find("$PhysicalNames"):
        for _ in range(w.integer()):
            dim, tag = w.integer(), w.integer()
            name = w.word()
            while name.count('"') < 2:
                name += " " + w.word()
            physical[dim, tag] = name.strip('"')
    groups: dict[tuple[int, int], list[str]] = {}
    w.at = 0
    if w.find("$Entities"):
        counts = [w.integer() for _ in range(4)]
        for dim, n in enumerate(counts):
            for _ in range(n):
                tag = w.integer()
                for _ in range(3 if dim == 0 else 6):
                    w.real()
                tags = [w.integer() for _ in range(w.integer())]
                if dim:
                    for _ in range(w.integer()):
                        w.integer()
                groups[dim, tag] = [physical.get((dim, abs(p)), f"physical_{abs(p)}") for p in tags]
                yield _row(kind="entity", uid=tag, type=dim, group=",".join(groups[dim, tag]) or None)
    w.at = 0
    if w.find("$Nodes"):
        blocks, _, _, _ = (w.integer() for _ in range(4))
        for _ in range(blocks):
            dim, tag, parametric, n = (w.integer() for _ in range(4))
            uids = [w.integer() for _ in range(n)]
            for uid in uids:
                x, y, z = w.real(), w.real(), w.real()
                for _ in range(dim if parametric else 0):
                    w.real()
                yield _row(kind="node", uid=uid, x=x, y=y, z=z, parent=tag)
    w.at = 0
    if w.find("$Elements"):
        blocks, _, _, _ = (w.integer() for _ in range(4))
        for _ in range(blocks):
            dim, tag, kind, n = (w.integer() for _ in range(4))
            if kind not in MSH_NODES:
                raise ValueError(f"element type {kind} is not known")
            for _ in range(n):
                uid = w.integer()
                yield _row(kind="cell", uid=uid, type=kind, nodes=[w.integer() for _ in range(MSH_NODES[kind])], parent=tag)
                for g in groups.get((dim, tag), []):
                    yield _row(kind="cell_group", uid=uid, group=g)
    w.at = 0
    if w.find("$Periodic"):
        for _ in range(w.integer()):
            w.integer(), w.integer(), w.integer()
            for _ in range(w.integer()):
                w.real()
            for _ in range(w.integer()):
                slave, master = w.integer(), w.integer()
                yield _row(kind="periodic", uid=slave, parent=master)


# ---------------------------------------------------------------- VTK


def parse_vtk(data: bytes) -> Iterator[dict]:
    """Legacy ASCII 2.0 to 4.2, UNSTRUCTURED_GRID; integer scalars named GROUP_* are groups."""
    lines = data.decode("utf-8", "replace").split("\n", 4)
    if not lines[0].startswith("# vtk DataFile"):
        raise ValueError("not a VTK file")
    if lines[2].strip().upper() != "ASCII" or "UNSTRUCTURED_GRID" not in lines[3].upper():
        raise ValueError("only ASCII unstructured grids")
    w = Words(lines[4], "")
    w.find("POINTS")
    n = w.integer()
    w.word()
    for uid in range(n):
        yield _row(kind="node", uid=uid, x=w.real(), y=w.real(), z=w.real())
    w.find("CELLS")
    n_cells, _ = w.integer(), w.integer()
    lists = [[w.integer() for _ in range(w.integer())] for _ in range(n_cells)]
    w.find("CELL_TYPES")
    w.integer()
    types = [w.integer() for _ in range(n_cells)]
    for uid, (nodes, kind) in enumerate(zip(lists, types, strict=True)):
        yield _row(kind="cell", uid=uid, type=kind, nodes=nodes)
    size, what = 0, ""
    while w.peek() is not None:
        word = w.word().upper()
        if word in ("POINT_DATA", "CELL_DATA"):
            what, size = ("node_group" if word == "POINT_DATA" else "cell_group"), w.integer()
        elif word == "SCALARS":
            name, kind = w.word(), w.word()
            if w.peek() != "LOOKUP_TABLE":
                w.word()
            w.word(), w.word()
            values = [w.word() for _ in range(size)]
            if name.upper().startswith("GROUP_") and kind.lower() in ("int", "long", "short"):
                for uid, v in enumerate(values):
                    if int(v):
                        yield _row(kind=what, uid=uid, group=name[6:])


def parse_vtu(data: bytes) -> Iterator[dict]:
    """XML unstructured grids with ASCII or raw inline base64 arrays (no compression)."""
    import base64

    root = ET.fromstring(data)
    formats = {"Float64": "d", "Float32": "f", "Int64": "q", "Int32": "i", "UInt8": "B", "Int8": "b", "UInt32": "I", "UInt64": "Q", "Int16": "h"}
    head = 8 if root.get("header_type") == "UInt64" else 4

    def array(node) -> list:
        text = (node.text or "").strip()
        code = formats[node.get("type")]
        if node.get("format") == "ascii":
            return [float(v) if code in "df" else int(v) for v in text.split()]
        if root.get("compressor"):
            raise ValueError("compressed arrays are not supported")
        raw = base64.b64decode(text)[head:]
        return list(struct.unpack(f"<{len(raw) // struct.calcsize(code)}{code}", raw))

    base_node = base_cell = 0
    for piece in root.iter("Piece"):
        points = array(piece.find("Points/DataArray"))
        named = {a.get("Name"): array(a) for a in piece.find("Cells").iter("DataArray")}
        for i in range(len(points) // 3):
            yield _row(kind="node", uid=base_node + i, x=float(points[3 * i]), y=float(points[3 * i + 1]), z=float(points[3 * i + 2]))
        at = 0
        for i, (end, kind) in enumerate(zip(named["offsets"], named["types"], strict=True)):
            yield _row(kind="cell", uid=base_cell + i, type=int(kind), nodes=[base_node + n for n in named["connectivity"][at:end]])
            at = end
        for tag, what, base in (("PointData", "node_group", base_node), ("CellData", "cell_group", base_cell)):
            for a in piece.find(tag) if piece.find(tag) is not None else ():
                if (a.get("Name") or "").upper().startswith("GROUP_"):
                    for i, v in enumerate(array(a)):
                        if v:
                            yield _row(kind=what, uid=base + i, group=a.get("Name")[6:])
        base_node += len(points) // 3
        base_cell += len(named["types"])


PARSERS: dict[str, Callable[[bytes], Iterator[dict]]] = {"msh": lambda b: parse_msh(b.decode()), "vtk": parse_vtk, "vtu": parse_vtu}


def allows(path: str) -> bool:
    return path.rpartition(".")[2].lower() in PARSERS


def read(spark: SparkSession, path: str) -> DataFrame:
    """All mesh files under a path, by their endings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                ending = name.rpartition(".")[2].lower()
                if ending in PARSERS:
                    rows = [r | {"file": name} for r in PARSERS[ending](bytes(content))]
                    if rows:
                        yield pd.DataFrame(rows, columns=list(_FIELDS)).astype({"uid": "Int64", "type": "Int32", "parent": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def tables(mesh: DataFrame) -> dict[str, DataFrame]:
    """The frames of one mesh."""
    of = lambda k: mesh.filter(F.col("kind") == k)
    return {
        "node": of("node").select("uid", "x", "y", "z", F.col("parent").alias("entity")),
        "cell": of("cell").select("uid", F.col("type").cast("short").alias("type"), F.col("parent").alias("entity")),
        "cell_node": of("cell").select(F.col("uid").alias("src"), F.posexplode("nodes").alias("pos", "dst")),
        "node_group": of("node_group").select("group", "uid"),
        "cell_group": of("cell_group").select("group", "uid"),
        "entity": of("entity").select(F.col("type").alias("dim"), F.col("uid").alias("tag"), F.col("group").alias("physical")),
        "periodic": of("periodic").select(F.col("uid").alias("slave"), F.col("parent").alias("master")),
    }


class _Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = files.get_file_info(path)
        found = [path] if info.is_file else [i.path for i in files.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        return [_Part(scheme + p) for p in sorted(found) if allows(p)]

    def read(self, partition):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(partition.path)
        with files.open_input_file(path) as f:
            content = f.read()
        for r in PARSERS[path.rpartition(".")[2].lower()](content):
            r["file"] = partition.path
            yield tuple(r[c] for c in _FIELDS)


class MeshSource(DataSource):
    """``spark.read.format("lattica_mesh").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "lattica_mesh"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeshSource)
