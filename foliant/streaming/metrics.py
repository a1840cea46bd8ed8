"""The metrics module as Structured Streaming: counters, threshold alerts with cooldown, windows, callbacks.

Streams carry (name, ts, value). State is one number or one time a key, so it grows with the number of metrics and not
with the points; late points are cut off by a watermark, whose default is the retention of 30 days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.functions import lexicons as lx
from foliant.operators.metrics import breaches, rules_frame

RETENTION = "30 days"


def points_stream(spark: SparkSession, folder: str, schema: str = "name string, ts timestamp, value double", **options: Any) -> DataFrame:
    """Points from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def window_stats(points: DataFrame, width: str = "30 minutes", slide: str | None = None, late: str = RETENTION) -> DataFrame:
    """Count, extremes, mean and approximate percentiles for each metric and window."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    v = F.col("value")
    return (
        points.withWatermark("ts", late)
        .groupBy(span.alias("span"), "name")
        .agg(
            F.count("*").alias("count"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.avg(v).alias("mean"),
            F.percentile_approx(v, 0.95, 10_000).alias("p95"),
        )
        .select("name", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "count", "min", "max", "mean", "p95")
    )


def _count_up(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total = state.get[0] if state.exists else 0.0
    rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
    running = rows["value"].cumsum() + total
    if len(running):
        state.update((float(running.iloc[-1]),))
    yield pd.DataFrame({"name": rows["name"], "ts": rows["ts"], "total": running})


def counters(points: DataFrame) -> DataFrame:
    """The running total of each metric after each point, over all batches."""
    return points.groupBy("name").applyInPandasWithState(
        _count_up, "name string, ts timestamp, total double", "total double", "append", GroupStateTimeout.NoTimeout
    )


def alerts(points: DataFrame, rules: dict | None = None, cooldown: float = lx.COOLDOWN_SECONDS) -> DataFrame:
    """Breaches of the rules, at most one for each metric and level within the cooldown."""
    spark = points.sparkSession
    found = breaches(points, rules_frame(spark, rules)).select("name", "level", "ts", "value", "threshold", "message")

    def quiet(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        keep = []
        for ts in rows["ts"]:
            emit = last is None or (ts - last).total_seconds() > cooldown
            last = ts if emit else last
            keep.append(emit)
        if last is not None:
            state.update((last.to_pydatetime(),))
        yield rows[keep]

    return found.groupBy("name", "level").applyInPandasWithState(
        quiet,
        "name string, level string, ts timestamp, value double, threshold double, message string",
        "last timestamp",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def run_callbacks(found: DataFrame, callbacks: list[Callable[[dict], None]], checkpoint: str, interval: str = "30 seconds"):
    """Start a query that hands each alert to every callback; one that raises doesn't stop the others."""

    def each(batch: DataFrame, _: int) -> None:
        for row in batch.toLocalIterator():
            for call in callbacks:
                try:
                    call(row.asDict())
                except Exception:  # a callback's failure is its own
                    continue

    writer = found.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start()


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now into Parquet files, and stop."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
