"""Windowed and latest-value aggregates of a stream of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.freshness import latest_arrival  # noqa: F401  the same aggregate, over a stream
from fleetlens.operators.keys import SERIES_KEY, present
from fleetlens.operators.predicates import valid_point


def with_event_time(points: DataFrame, delay: str) -> DataFrame:
    """The watermark only bounds state. A late point is not wrong: it merely expires early, so choose the
    delay as long as points may be under way."""
    return points.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", delay)


def _per_window(points: DataFrame, window: Column, delay: str, keys: Sequence[str]) -> DataFrame:
    by = present(points, keys)
    return (
        with_event_time(points.filter(valid_point()), delay)
        .groupBy(*by, window.alias("window"))
        .agg(
            F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.sum("value").alias("sum"), F.count("value").alias("n"),
        )
        .withColumn("start_us", F.unix_micros("window.start"))
        .drop("window")
    )


def resample(points: DataFrame, period: str, delay: str, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    return _per_window(points, F.window("event_time", period), delay, keys)


def sliding(points: DataFrame, length: str, step: str, delay: str, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    return _per_window(points, F.window("event_time", length, step), delay, keys)


def latest(points: DataFrame, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Newest valid point per series; in update mode each batch yields the series that changed."""
    by = present(points, keys)
    newest = F.max(F.struct("ts_us", "pos", "value")).alias("newest")
    return points.filter(valid_point()).groupBy(*by).agg(newest).select(*by, "newest.value", "newest.ts_us")

