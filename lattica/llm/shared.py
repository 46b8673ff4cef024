"""Shared folder, intermediate tables and input sizes."""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lets Spark remove an execution's shuffle files when it ends; nothing reads them after a table is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode and a folder in the warehouse on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lattica_shared", None)
    if not known:
        if spark.sparkContext.master.startswith("local"):
            known = "file://" + tempfile.mkdtemp(prefix="lattica-")
        else:
            known = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lattica_shared"
        spark._lattica_shared = known
    return known.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone; the folder is then left
        pass


#: Intermediate tables that are still there: path -> the name under which ``owned`` wrote it, or None.
_intermediate: dict[str, str | None] = {}
_owner: list[str | None] = [None]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _intermediate[path] = _owner[-1]
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    path = getattr(df, "_lattica_path", None)
    if path in _intermediate:
        del _intermediate[path]
        _remove(df.sparkSession, path)


@contextlib.contextmanager
def owned(spark: SparkSession, name: str) -> Iterator[None]:
    """Remove the intermediate tables that earlier blocks of this name wrote, and own those written in this one.

    For callers that have stored what they asked for; tables written elsewhere stay until the process ends.
    """
    for path in [p for p, owner in _intermediate.items() if owner == name]:
        del _intermediate[path]
        _remove(spark, path)
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def text_stats(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return n, size


def group_of(df: DataFrame, rows: int, size: int, group_bytes: int, text: str = "text") -> Column:
    """A number for the group of documents of each row, for groups of about ``group_bytes`` of text, the same in every job.

    Rows that stand next to each other in a Parquet file form a group, so a task that reads them meets few groups, and
    a word that every text has is told once per group.  Texts of four times the mean length or more, sixteen times, and
    so on form smaller groups by themselves, which bounds a group at four times ``group_bytes`` or one text, whatever
    the order of the rows.  (Two groups in four billion pairs get one number.)  Where rows do not come straight from
    files, they are dealt by a hash.
    """
    mean = max(1.0, size / max(1, rows))
    per = max(1.0, group_bytes / mean)
    long = F.greatest(F.lit(0.0), F.floor(F.log(4.0, F.greatest(F.octet_length(text), F.lit(1)) / F.lit(mean))))
    long = F.coalesce(long, F.lit(0.0)).cast("int")
    block = F.col("_metadata.row_index") / F.greatest(F.lit(1.0), F.lit(per) / F.pow(F.lit(4.0), long))
    try:
        df.select(block)
        return F.xxhash64(F.col("_metadata.file_path"), long, F.floor(block)).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    except AnalysisException:
        return F.pmod(F.xxhash64(F.octet_length(text), F.xxhash64(text)), F.lit(max(1, math.ceil(size / group_bytes)))).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
