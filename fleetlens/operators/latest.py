"""Newest points per series, and what follows from the newest two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.operators.keys import SERIES_KEY, present
from fleetlens.operators.predicates import valid_point


def latest_n(points: DataFrame, n: int, keys=SERIES_KEY) -> DataFrame:
    """The newest ``n`` valid points of each series, numbered from 1 in ``rn``.

    The limit on the row number is applied before the shuffle too, so a series that holds a third of
    all points sends ``n`` rows per input split.
    """
    by = present(points, keys)
    newest_first = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in present(points, ("ts_us", "pos"))])
    return (
        points.filter(valid_point())
        .withColumn("rn", F.row_number().over(newest_first))
        .filter(F.col("rn") <= max(n, 0))
    )


def newest_in_responses(raw: DataFrame, n: int) -> DataFrame:
    """Responses with the newest ``n`` valid points of their own list only, newest first; of one time the last in the list comes first.

    A response is cut where it is read: nothing is exploded and nothing exchanged. What a response gives to the newest
    ``n`` of its series is among what is kept, so ``latest_n`` over the flattened rest equals ``latest_n`` over all points.
    A null list stays null.
    """
    numbered = F.transform("DataPoints", lambda p, i: F.struct(p["Timestamp"].alias("Timestamp"), i.alias("_at"), p["Value"].alias("Value")))
    valid = F.filter(numbered, lambda p: p["Timestamp"].isNotNull() & p["Value"].isNotNull())
    newest = F.slice(F.sort_array(valid, asc=False), 1, max(n, 0))
    return raw.withColumn("DataPoints", F.transform(newest, lambda p: F.struct(p["Timestamp"].alias("Timestamp"), p["Value"].alias("Value"))))


def latest_valid(points: DataFrame, keys=SERIES_KEY) -> DataFrame:
    """The newest valid point of each series, by partial aggregation.

    ``pos`` settles points of one time. A table without it has one point per series and time; then the
    aggregate keeps plain numbers and needs no sort.
    """
    by = present(points, keys)
    valid = points.filter(valid_point())
    if "pos" not in points.columns:
        return valid.groupBy(*by).agg(F.max_by("value", "ts_us").alias("value"), F.max("ts_us").alias("ts_us"))
    newest = F.max(F.struct("ts_us", "pos", "value")).alias("newest")
    return valid.groupBy(*by).agg(newest).select(*by, "newest.value", "newest.ts_us")


def dynamic_ttl(newest_us: Column, previous_us: Column) -> Column:
    """Collection interval seen in the data: distance of the newest two points, 0 without two."""
    return F.coalesce(F.greatest(newest_us - previous_us, F.lit(0)), F.lit(0)).cast("bigint")


def latest_with_interval(points: DataFrame, keys=SERIES_KEY) -> DataFrame:
    """Newest value, its time and the dynamic TTL per series, in one shuffle."""
    by = present(points, keys)
    return (
        latest_n(points, 2, keys)
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("value"),
            F.max(F.when(F.col("rn") == 1, F.col("ts_us"))).alias("ts_us"),
            F.max(F.when(F.col("rn") == 2, F.col("ts_us"))).alias("previous_us"),
        )
        .withColumn("dynamic_ttl_us", dynamic_ttl(F.col("ts_us"), F.col("previous_us")))
        .drop("previous_us")
    )

