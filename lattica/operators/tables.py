"""Named tables (long form ``row, col, value``) and tolerant comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import nearly_equal, relative_difference, select_name


class SimpleTable:
    """Rows and columns by name with a cursor; built on the driver, compared and written as frames."""

    def __init__(self, name: str = "table"):
        self.name, self.rows, self.cols, self.values = name, [], [], {}
        self.cursor = (0, 0)

    def add_row(self, name: str, values: list[float] = ()) -> int:
        self.rows.append(name)
        for c, v in zip(range(len(self.cols)), values, strict=False):
            self.values[len(self.rows) - 1, c] = v
        self.cursor = (len(self.rows) - 1, max(len(values) - 1, 0))
        return len(self.rows) - 1

    def add_column(self, name: str, values: list[float] = ()) -> int:
        self.cols.append(name)
        for r, v in zip(range(len(self.rows)), values, strict=False):
            self.values[r, len(self.cols) - 1] = v
        self.cursor = (max(len(values) - 1, 0), len(self.cols) - 1)
        return len(self.cols) - 1

    def _index(self, names: list[str], at: str | int, make) -> int | None:
        if isinstance(at, int):
            return at if 0 <= at < len(names) else None
        return names.index(at) if at in names else (make(at) if make else None)

    def add_in_row(self, row: str | int, value: float, create: bool = True) -> bool:
        """At the row's next free column; false if there is none."""
        r = self._index(self.rows, row, self.add_row if create else None)
        free = None if r is None else next((c for c in range(len(self.cols)) if (r, c) not in self.values), None)
        if free is None:
            return False
        self.values[r, free], self.cursor = value, (r, free)
        return True

    def add_in_column(self, col: str | int, value: float, create: bool = True) -> bool:
        c = self._index(self.cols, col, self.add_column if create else None)
        free = None if c is None else next((r for r in range(len(self.rows)) if (r, c) not in self.values), None)
        if free is None:
            return False
        self.values[free, c], self.cursor = value, (free, c)
        return True

    def add_in_same_row(self, value: float) -> bool:
        return self.add_in_row(self.cursor[0], value)

    def add_in_same_column(self, value: float) -> bool:
        return self.add_in_column(self.cursor[1], value)

    def edit(self, row: str | int, col: str | int, value: float) -> bool:
        r, c = self._index(self.rows, row, None), self._index(self.cols, col, None)
        if r is None or c is None:
            return False
        self.values[r, c], self.cursor = value, (r, c)
        return True

    def element(self, row: str | int, col: str | int) -> float:
        r, c = self._index(self.rows, row, None), self._index(self.cols, col, None)
        return self.values.get((r, c), 0.0)

    def move(self, dr: int, dc: int) -> float | None:
        """Up, down, left, right of the cursor; null at the border (the cursor stays)."""
        r, c = self.cursor[0] + dr, self.cursor[1] + dc
        if not (0 <= r < len(self.rows) and 0 <= c < len(self.cols)):
            return None
        self.cursor = (r, c)
        return self.values.get((r, c), 0.0)

    def up(self):
        return self.move(-1, 0)

    def down(self):
        return self.move(1, 0)

    def left(self):
        return self.move(0, -1)

    def right(self):
        return self.move(0, 1)

    def row(self, row: str | int) -> list[float]:
        return [self.element(row, c) for c in range(len(self.cols))]

    def column(self, col: str | int) -> list[float]:
        return [self.element(r, col) for r in range(len(self.rows))]

    def rename_row(self, old: str, new: str) -> None:
        self.rows[self.rows.index(old)] = new

    def rename_column(self, old: str, new: str) -> None:
        self.cols[self.cols.index(old)] = new

    def add_average_column(self, name: str) -> int:
        """The mean of each row."""
        n = len(self.cols)
        return self.add_column(name, [sum(self.row(r)) / n if n else 0.0 for r in range(len(self.rows))])

    def frame(self, spark: SparkSession) -> DataFrame:
        data = [(self.rows[r], self.cols[c], float(self.values.get((r, c), 0.0))) for r in range(len(self.rows)) for c in range(len(self.cols))]
        return spark.createDataFrame(data, "row string, col string, value double")


def average_column(table: DataFrame, name: str) -> DataFrame:
    """Long form with the mean of each row appended as a column."""
    return table.unionByName(table.groupBy("row").agg(F.avg("value").alias("value")).select("row", F.lit(name).alias("col"), "value"))


def wide(table: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return table.groupBy("row").pivot("col", cols).agg(F.first("value"))


def formatted(c: Column, precision: int, kind: str = "fixed") -> Column:
    return F.format_string(f"%.{precision}{'e' if kind == 'scientific' else 'f'}", c)


def epsilon_map(values: dict[str, float] | None, key: str) -> Column:
    e = F.lit(-1.0)
    for name, eps in (values or {}).items():
        e = F.when(F.col(key) == name, F.lit(float(eps))).otherwise(e)
    return e


def compare(reference: DataFrame, target: DataFrame, rows: dict | None = None, cols: dict | None = None, eps_rows: dict[str, float] | None = None, eps_cols: dict[str, float] | None = None) -> DataFrame:
    """Cells of both tables that are selected: ``row, col, ref, target, rel, same``.

    ``rows`` and ``cols`` are arguments of ``select_name``; a cell's epsilon is the larger of its row's and column's,
    and where neither is set the machine's holds.
    """
    r = reference.select("row", "col", F.col("value").alias("ref"))
    if rows:
        r = r.filter(select_name(F.col("row"), **rows))
    if cols:
        r = r.filter(select_name(F.col("col"), **cols))
    j = r.join(target.select("row", "col", F.col("value").alias("target")), ["row", "col"])
    eps = F.greatest(epsilon_map(eps_rows, "row"), epsilon_map(eps_cols, "col"))
    same = F.when(eps >= 0, nearly_equal(F.col("ref"), F.col("target"), eps)).otherwise(nearly_equal(F.col("ref"), F.col("target")))
    return j.select("row", "col", "ref", "target", relative_difference(F.col("ref"), F.col("target")).alias("rel"), same.alias("same"))


def same_dimensions(reference: DataFrame, target: DataFrame) -> bool:
    size = lambda t: t.agg(F.countDistinct("row"), F.countDistinct("col")).first()
    return tuple(size(reference)) == tuple(size(target))


def compare_element(reference: DataFrame, target: DataFrame, row: str, col: str, eps: float | None = None) -> bool:
    """False if either table lacks the cell."""
    cell = lambda t: t.filter((F.col("row") == row) & (F.col("col") == col))
    found = compare(cell(reference), cell(target), eps_rows={row: eps} if eps is not None else None).select("same").first()
    return bool(found and found.same)


# ------------------------------------------------------------ variables


def compare_variable(a: DataFrame, b: DataFrame, uid: str, column: str, method: str = "relative", part: str | None = None) -> DataFrame:
    """Items of both whose values differ: ``uid, v1, v2, diff``; missing on one side counts as different (diff null).

    ``relative`` divides by the first value; ``local_norm_max`` by the largest magnitude of the part (of all rows
    without one).
    """
    left = a.select(uid, F.col(column).cast("double").alias("v1"), *([F.col(part).alias("part")] if part else []))
    right = b.select(uid, F.col(column).cast("double").alias("v2"))
    j = left.join(right, uid, "full_outer")
    if method == "relative":
        scale = F.col("v1")
        j = j.withColumn("_scale", scale)
    else:
        keys = ["part"] if part else []
        most = left.groupBy(*keys).agg(F.max(F.abs("v1")).alias("_scale"))
        j = j.join(F.broadcast(most), keys, "left") if keys else j.join(F.broadcast(most))
    d = F.col("v1") - F.col("v2")
    diff = F.when(F.col("_scale") == 0, d).otherwise(F.try_divide(d, F.col("_scale")))
    return j.filter(~F.col("v1").eqNullSafe(F.col("v2"))).select(uid, "v1", "v2", diff.alias("diff"))


def verify(reference: DataFrame, target: DataFrame, eps: float) -> DataFrame:
    """Per variable in both ``(name, uid, value)`` frames: values and how many are not nearly equal."""
    j = reference.select("name", "uid", F.col("value").alias("ref")).join(target.select("name", "uid", F.col("value").alias("got")), ["name", "uid"])
    return j.groupBy("name").agg(F.count("*").alias("n"), F.sum((~nearly_equal(F.col("ref"), F.col("got"), eps)).cast("long")).alias("n_different"))
