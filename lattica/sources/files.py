"""Other inputs: tables, curves, matrices, cases, databases."""

from __future__ import annotations

import io
import re
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text_files(spark: SparkSession, path: str, run, schema: str) -> DataFrame:
    """Whole files to rows, a file a task."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def csv_table(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """Named tables ``table, row, col, value``: cell (0, 0) names the table, row 0 the columns, column 0 the rows.

    Decimal commas are accepted, empty lines skipped, a wrong number of columns is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                lines = [x.split(separator) for x in bytes(content).decode().splitlines() if x.strip()]
                if not lines:
                    continue
                title, *cols = (c.strip() for c in lines[0])
                out = []
                for i, line in enumerate(lines[1:]):
                    if len(line) != len(lines[0]):
                        raise ValueError(f"{name}, row {i + 1}: {len(line)} columns, not {len(lines[0])}")
                    out += [(title, line[0].strip(), c, float(v.strip().replace(",", ".")) if v.strip() else None) for c, v in zip(cols, line[1:], strict=True)]
                yield pd.DataFrame(out, columns=["table", "row", "col", "value"])

    return _text_files(spark, path, run, "table string, row string, col string, value double")


def gnuplot_curves(spark: SparkSession, path: str) -> DataFrame:
    """Two-column text files: ``name`` (file name without its ending), ``x, y``."""
    t = spark.read.text(path).select(F.input_file_name().alias("f"), F.split(F.trim("value"), r"\s+").alias("w"))
    t = t.filter((F.size("w") >= 2) & ~F.col("w")[0].startswith("#"))
    return t.select(F.regexp_extract("f", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), F.col("w")[0].cast("double").alias("x"), F.col("w")[1].cast("double").alias("y"))


def parse_matrix_market(text: str) -> tuple[tuple[int, int], list[tuple[int, int, float]]]:
    """Coordinate real or integer matrices, general, symmetric or skew-symmetric; indices from 1."""
    lines = iter(text.splitlines())
    head = next(lines).lower().split()
    if head[:3] != ["%%matrixmarket", "matrix", "coordinate"]:
        raise ValueError("not a coordinate Matrix Market file")
    body = (x.split() for x in lines if x.strip() and not x.startswith("%"))
    rows, cols, _ = map(int, next(body))
    out = []
    for w in body:
        i, j, v = int(w[0]), int(w[1]), float(w[2]) if len(w) > 2 else 1.0
        out.append((i, j, v))
        if i != j and head[4] in ("symmetric", "skew-symmetric"):
            out.append((j, i, -v if head[4].startswith("skew") else v))
    return (rows, cols), out


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """``.mtx`` files and tar archives of them: ``file, row, col, value``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                content, found = bytes(content), []
                if re.search(r"\.(tar|tgz|tar\.\w+)$", name):
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        found = [(f"{name}/{m.name}", t.extractfile(m).read()) for m in t.getmembers() if m.isfile() and m.name.endswith(".mtx")]
                elif name.endswith(".mtx"):
                    found = [(name, content)]
                for label, raw in found:
                    _, entries = parse_matrix_market(raw.decode())
                    yield pd.DataFrame([(label, *e) for e in entries], columns=["file", "row", "col", "value"])

    return _text_files(spark, path, run, "file string, row long, col long, value double")


class Case:
    """A case document: options by dotted path with defaults, tables, initial values and mesh generators."""

    def __init__(self, text: str, defaults: dict | None = None, names: dict[str, str] | None = None):
        self.root = ET.fromstring(text)
        self.defaults, self.names = defaults or {}, names or {}

    def _find(self, path: str) -> list[ET.Element]:
        nodes = [self.root]
        for part in path.split("."):
            nodes = [k for n in nodes for k in n if k.tag == part or self.names.get(k.tag) == part]
        return nodes

    def all(self, path: str) -> list[str]:
        return [(n.text or "").strip() for n in self._find(path)]

    def get(self, path: str, kind: type = str):
        """The option's value, its default, or an error."""
        found = self.all(path)
        if found:
            return found[0].lower() in ("true", "1", "yes") if kind is bool else kind(found[0])
        if path in self.defaults:
            return self.defaults[path]
        raise KeyError(f"option {path} is not set and has no default")

    def attribute(self, path: str, name: str) -> list[str | None]:
        return [n.get(name) for n in self._find(path)]

    def table(self, name: str) -> list[tuple[float, float]]:
        """Breakpoints of the table function of a name: elements with ``x`` and ``y``, or ``value`` pairs."""
        for t in self.root.iter("table"):
            if t.get("name") == name or t.get("nom") == name:
                return [(float(v.findtext("x")), float(v.findtext("y"))) for v in t if v.find("x") is not None]
        raise KeyError(f"no table {name}")

    def initial_values(self) -> dict[str, dict[str, float]]:
        """variable -> group -> constant, from elements with a name, a value and a group."""
        out: dict[str, dict[str, float]] = {}
        for v in self.root.iter("variable"):
            name, value, group = (v.get(a) or v.get(b) for a, b in (("name", "nom"), ("value", "valeur"), ("group", "groupe")))
            if name and value and group:
                out.setdefault(name, {})[group] = float(value)
        return out


def xpath_string(c: Column, path: str) -> Column:
    return F.xpath_string(c, F.lit(path))


def json_field(c: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(c, path).cast(kind)


class HashDatabase:
    """Content-addressed values: parquet files of ``key`` (a digest) and ``value``; a value is stored once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, values: DataFrame, column: str) -> DataFrame:
        """Store values that are not there yet; returns the frame with ``key``."""
        keyed = values.withColumn("key", F.sha2(F.col(column).cast("binary"), 256))
        new = keyed.select("key", F.col(column).cast("binary").alias("value")).dropDuplicates(["key"])
        try:
            new = new.join(self.spark.read.parquet(self.path).select("key"), "key", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(self.path)
        return keyed

    def read(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.spark.read.parquet(self.path), "key", "left")
