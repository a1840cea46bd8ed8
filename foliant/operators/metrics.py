"""Metrics over tables: trailing summaries, counters, threshold alerts with cooldown, health, dashboard.

A metric point has the columns name, value and ts. Nothing reads the clock: trailing windows end at ``as_of``, by default
at the last point.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.functions import lexicons as lx


def trailing(points: DataFrame, minutes: int, as_of=None) -> DataFrame:
    """The points of the last ``minutes`` before ``as_of``."""
    end = F.lit(as_of) if as_of is not None else F.lit(points.agg(F.max("ts")).first()[0])
    return points.where(F.col("ts") > end - F.make_dt_interval(mins=F.lit(minutes)))


def summary(points: DataFrame) -> DataFrame:
    """For each metric count, extremes, mean, exact percentiles, spread and the last value."""
    v = F.col("value")
    return points.groupBy("name").agg(
        F.count("*").alias("count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.median(v).alias("median"),
        F.stddev_pop(v).alias("std"),
        F.percentile(v, 0.95).alias("p95"),
        F.percentile(v, 0.99).alias("p99"),
        F.max_by(v, F.struct("ts", "point_id") if "point_id" in points.columns else F.col("ts")).alias("last_value"),
    )


def running_counter(points: DataFrame, *order: str) -> DataFrame:
    """``points`` with the running total of each name, whatever the tags."""
    upto = Window.partitionBy("name").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn("total", F.sum("value").over(upto))


def last_points(points: DataFrame, n: int, *order: Column) -> DataFrame:
    """The latest ``n`` points of each metric; each task keeps no more before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return points.withColumn("rank", rank).where(F.col("rank") <= n)


def rules_frame(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    """Alert rules as a table (name, threshold, level, message, shown)."""
    rules = lx.ALERT_RULES if rules is None else rules
    rows = [(name, float(t), level, message, shown) for name, (t, level, message, shown) in rules.items()]
    return spark.createDataFrame(rows, "name string, threshold double, level string, message string, shown string")


def _shown(value: Column, how: Column) -> Column:
    return (
        F.when(how == "percent2", F.format_string("%.2f%%", value * 100))
        .when(how == "percent1", F.format_string("%.1f%%", value * 100))
        .otherwise(F.format_string("%.2f", value))
    )


def breaches(points: DataFrame, rules: DataFrame) -> DataFrame:
    """Points over their metric's threshold, with level and message; rules are a small dimension."""
    met = points.join(F.broadcast(rules), "name").where(F.col("value") > F.col("threshold"))
    message = F.replace(F.col("message"), F.lit("%s"), _shown(F.col("value"), F.col("shown")))
    return met.withColumn("message", message).drop("shown")


def cooled_down(found: DataFrame, seconds: float = lx.COOLDOWN_SECONDS) -> DataFrame:
    """Of the breaches (name, level, ts, ...) those more than ``seconds`` after the last that was kept.

    Each kept breach depends on the one before, so a metric's breaches are walked in order; they stream through
    sorted partitions, and one time for each metric is all that is held.
    """
    columns = found.columns

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for frame in frames:
            keep = []
            for name, level, ts in zip(frame["name"], frame["level"], frame["ts"], strict=True):
                if (name, level) != key:
                    key, last = (name, level), None
                emit = last is None or (ts - last).total_seconds() > seconds
                last = ts if emit else last
                keep.append(emit)
            yield frame[keep]

    # Of breaches at the same time the first by their other columns counts, so that a rerun keeps the same ones.
    others = [c for c in columns if c not in ("name", "level", "ts")]
    ordered = found.repartition("name", "level").sortWithinPartitions("name", "level", "ts", *others)
    return ordered.mapInPandas(walk, found.schema).select(*columns)


def recent_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    """The latest ``n`` alerts, and of those the unresolved ones; of alerts at one time the largest by their other columns."""
    others = [F.col(c).desc() for c in alerts.columns if c != "ts"]
    return alerts.orderBy(F.col("ts").desc(), *others).limit(n).where(~F.col("resolved"))


def health(alerts: DataFrame) -> DataFrame:
    """One row: critical, warning or healthy."""
    worst = (
        F.when(F.max((F.col("level") == "critical").cast("int")) == 1, "critical")
        .when(F.max((F.col("level") == "warning").cast("int")) == 1, "warning")
        .otherwise("healthy")
    )
    return alerts.agg(worst.alias("system_health"))


def dashboard(points: DataFrame, alerts: DataFrame, names: list[str], minutes: int = 30, as_of=None) -> DataFrame:
    """The summaries of key metrics over a trailing window, beside the state of the system."""
    key = trailing(points, minutes, as_of).where(F.col("name").isin(*names))
    return summary(key).join(F.broadcast(health(recent_alerts(alerts))))


def retained(points: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    return trailing(points, days * 24 * 60, as_of)


def by_metric_json(points: DataFrame, unit: str = "day") -> DataFrame:
    """JSON arrays of points for export, one for each metric and ``unit`` of time, so that none grows with the history."""
    point = F.struct("ts", "value")
    chunk = F.date_trunc(unit, F.col("ts")).alias("chunk")
    return points.groupBy("name", chunk).agg(F.to_json(F.sort_array(F.collect_list(point))).alias("points"))
