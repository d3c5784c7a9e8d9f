"""Resampling, catalogue reduction, collection statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from fleetlens.functions.metrics import split_metric
from fleetlens.operators.keys import INSTANCE_KEY, SERIES_KEY, present
from fleetlens.operators.predicates import valid_point

COUNTER_PERIOD_US = 1_000_000
DIMENSION_PERIOD_US = 60_000_000


def period_start(ts_us: Column, period_us: int) -> Column:
    return ts_us - F.pmod(ts_us, F.lit(period_us))


def resample(points: DataFrame, period_us: int, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """All four statistics of each series per period; partial sums are formed before the shuffle."""
    by = present(points, keys)
    return (
        points.filter(valid_point())
        .withColumn("period_us", period_start(F.col("ts_us"), period_us))
        .groupBy(*by, "period_us")
        .agg(
            F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.sum("value").alias("sum"), F.count("value").alias("n"),
        )
    )


def resample_by_statistic(points: DataFrame, period_us: int) -> DataFrame:
    """Resampled value by the statistic the metric's name asks for; names without one drop out."""
    statistic = split_metric(F.col("metric")).statistic
    chosen = F.lit(None).cast("double")
    for name in ("avg", "min", "max", "sum"):
        chosen = F.when(F.col("statistic") == name, F.col(name)).otherwise(chosen)
    sampled = resample(points, period_us).withColumn("statistic", statistic).filter(F.col("statistic") != "")
    return sampled.withColumn("value", chosen).drop("avg", "min", "max", "sum")


FIRST_SEEN = ("seen_at_us", "ordinal", "resource_id", "description")


def unique_definitions(catalogue: DataFrame) -> DataFrame:
    """One row per instance and metric: the last definition wins."""
    return _definitions(catalogue).drop("first_seen")


def _definitions(catalogue: DataFrame) -> DataFrame:
    """The last definition of each instance and metric, with where its description was first seen.

    The filter keeps both aggregates alive in whatever is built on this, so that all of it shares one exchange.
    """
    keys = present(catalogue, SERIES_KEY)
    rest = [c for c in catalogue.columns if c not in (*keys, "ordinal")]
    folded = catalogue.groupBy(*keys).agg(
        F.max(F.struct("ordinal", *rest)).alias("last"), F.min(F.struct(*FIRST_SEEN)).alias("first_seen")
    )
    return folded.where("last IS NOT NULL AND first_seen IS NOT NULL").select(*keys, "last.*", "first_seen")


def canonical_definitions(catalogue: DataFrame) -> DataFrame:
    """``unique_definitions`` with the canonical description of region, engine and metric, from one scan."""
    unique = _definitions(catalogue)
    first = F.min("first_seen").alias("first")
    canonical = (
        unique.groupBy("region", "engine", F.lower("metric").alias("metric_lower")).agg(first)
        .select("region", "engine", "metric_lower", F.col("first.description").alias("canonical_description"))
    )
    return with_canonical_description(unique.drop("first_seen"), canonical)


def canonical_descriptions(catalogue: DataFrame) -> DataFrame:
    """First description seen per region, engine and metric, whatever the metric's spelling.

    There are few such groups, so nearly all rows fold together before the shuffle.
    """
    first = F.min(F.struct(*FIRST_SEEN)).alias("first")
    return (
        catalogue.groupBy("region", "engine", F.lower("metric").alias("metric_lower")).agg(first)
        .select("region", "engine", "metric_lower", F.col("first.description").alias("canonical_description"))
    )


def with_canonical_description(unique: DataFrame, canonical: DataFrame) -> DataFrame:
    """``canonical`` has a few rows per region and engine: adaptive execution sees that and broadcasts them."""
    keys = ["region", "engine", "metric_lower"]
    keyed = unique.withColumn("metric_lower", F.lower("metric")).join(canonical, keys)
    return keyed.withColumn("description", F.col("canonical_description")).drop("metric_lower", "canonical_description")


def collection_statistics(split: DataFrame) -> DataFrame:
    """Requested, served and missing series per instance, from ``lookups.split_fresh``."""
    return split.groupBy(*present(split, INSTANCE_KEY)).agg(
        F.count(F.lit(1)).alias("requested"), F.count_if("is_hit").alias("hits"),
        F.count_if(~F.col("is_hit")).alias("misses"),
    )


def observe_collection(split: DataFrame, observation: Observation) -> DataFrame:
    """``lookups.split_fresh`` as it is; requested, served and missing series of the run come with its action."""
    return split.observe(
        observation, F.count(F.lit(1)).alias("requested"), F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses")
    )


def point_statistics(points: DataFrame) -> DataFrame:
    """Datapoints, valid datapoints and series per instance.

    Grouped by series first, so that the distinct count needs no second copy of the points.
    """
    per_series = points.groupBy(*present(points, SERIES_KEY)).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(valid_point()).alias("valid_points")
    )
    return per_series.groupBy(*present(points, INSTANCE_KEY)).agg(
        F.count(F.lit(1)).alias("series"), F.sum("points").alias("points"), F.sum("valid_points").alias("valid_points")
    )
