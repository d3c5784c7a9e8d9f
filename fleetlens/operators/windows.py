"""Sliding windows over points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.aggregates import resample
from fleetlens.operators.keys import SERIES_KEY, present


def sliding(points: DataFrame, length_us: int, step_us: int, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Count, mean, smallest and largest value of each series in windows ``[start, start + length)``.

    Points are reduced to one row per step first; only these rows are repeated for the windows they lie in.
    """
    if length_us % step_us:
        raise ValueError("the window must be a whole number of steps")
    by = present(points, keys)
    steps = resample(points, step_us, keys)
    starts = F.sequence(F.col("period_us") - F.lit(length_us - step_us), F.col("period_us"), F.lit(step_us).cast("bigint"))
    return (
        steps.withColumn("start_us", F.explode(starts))
        .groupBy(*by, "start_us")
        .agg(
            F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("avg"),
            F.min("min").alias("min"), F.max("max").alias("max"),
        )
    )
