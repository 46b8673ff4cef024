"""Structured Streaming forms of histories and output periods."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1, schema: str = EVENTS) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def periods(events: DataFrame, period: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts and sums per period and name; late rows count until the watermark passes their period."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", period), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("bucket"), F.col("event_type").alias("name"), "n", "total")


def _keep_last(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, value = state.get if state.exists else (-1, 0.0)
    for f in rows:
        best = f.loc[f.seq.idxmax()]
        if best.seq > seq:
            seq, value = int(best.seq), float(best.value)
    state.update((seq, value))
    yield pd.DataFrame({"name": [key[0]], "iteration": [key[1]], "seq": [seq], "value": [value]})


def last_wins(history: DataFrame) -> DataFrame:
    """Upserts of ``(name, iteration)`` by the largest ``seq``: state is one (seq, value) a key; emits a key's current value with every batch that touches it."""
    h = history.select("name", "iteration", "seq", "value")
    return h.groupBy("name", "iteration").applyInPandasWithState(_keep_last, "name string, iteration long, seq long, value double", "seq long, value double", "update", GroupStateTimeout.NoTimeout)


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run ``step(frame, number)`` for every micro-batch; restart continues behind the last finished one."""
    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def upsert_into(path: str, keys: list[str], seq: str) -> Callable[[DataFrame, int], None]:
    """A batch step that keeps the last version per key in two alternating folders (a reader takes the newer complete one)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, path, number - 1)
        every = batch if old is None else batch.unionByName(old.select(*batch.columns))
        rest = [c for c in batch.columns if c not in keys]
        last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))
        last.write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return step


def current(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    if number < 0:
        return None
    return spark.read.parquet(f"{path}/{number % 2}")
