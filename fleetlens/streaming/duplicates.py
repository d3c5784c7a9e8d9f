"""Points that arrive more than once: kept once, and counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.keys import SERIES_KEY, present
from fleetlens.streaming.aggregates import with_event_time


def unique(points: DataFrame, delay: str, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """The first arrival of each series and time. State is held until the watermark has passed the point by ``delay``.

    A copy that comes later than that is taken for a new point, unless the watermark drops it.
    """
    by = present(points, keys)
    return with_event_time(points.filter("ts_us IS NOT NULL"), delay).dropDuplicatesWithinWatermark([*by, "ts_us"]).drop("event_time")


def repeated(points: DataFrame, delay: str, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """(keys, ts_us, copies) of what ``unique`` drops, in append mode: a row once the watermark has passed the point."""
    by = present(points, keys)
    counted = with_event_time(points.filter("ts_us IS NOT NULL"), delay).groupBy(*by, "event_time").agg(F.count(F.lit(1)).alias("copies"))
    return counted.filter("copies > 1").select(*by, F.unix_micros("event_time").alias("ts_us"), "copies")
