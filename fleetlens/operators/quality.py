"""Findings about the data, kept as tables instead of log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from fleetlens.operators.keys import SERIES_KEY, present, shared
from fleetlens.operators.lookups import with_base
from fleetlens.operators.predicates import supported_group, valid_point


def sample_rejects(points: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per series that yields no sample, with the reason.

    Points are reduced to one row per series before anything is joined.
    """
    keys = present(points, SERIES_KEY)
    series = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.count_if(valid_point()).alias("valid_points"))
    known_keys = [*shared(points, catalogue), "base"]
    known = catalogue.withColumnRenamed("metric", "base").select(*known_keys).distinct()
    joined = with_base(series).join(known.withColumn("known", F.lit(True)), known_keys, "left")
    reason = (
        F.when(F.col("metric").isNull(), "missing_key")
        .when(F.col("valid_points") == 0, "no_valid_point")
        .when(F.col("base") == "", "no_statistic")
        .when(F.col("known").isNull(), "not_in_catalogue")
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*keys, "points", "reason")


def unsupported_groups(dim_points: DataFrame) -> DataFrame:
    bad = dim_points.filter(~supported_group(F.col("dim_group")))
    return bad.groupBy("dim_group").agg(F.count(F.lit(1)).alias("points")).withColumn("reason", F.lit("unsupported_group"))


def conflicting_help(samples: DataFrame) -> DataFrame:
    """Names published with more than one help text.

    Distinct pairs first: they combine before the shuffle, and a hot name leaves a handful of them.
    """
    pairs = samples.select("name", "help").filter(F.col("help").isNotNull()).distinct()
    return pairs.groupBy("name").agg(F.count(F.lit(1)).alias("descriptions")).filter(F.col("descriptions") > 1)


def duplicate_series(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Name and label set published more than once in one evaluation."""
    return samples.groupBy("name", *labels).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def failure_summary(rejects: DataFrame, source: str) -> DataFrame:
    """Rejects per reason, with the first of them in the order of ``source``."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rejects"), F.min(source).alias("first_source"))


def require_reject_share(rejects: int, total: int, limit: float) -> None:
    """Fail a job only when too much was rejected."""
    if total and rejects / total > limit:
        raise ValueError(f"{rejects} of {total} rows rejected, more than {limit:.2%}")


def observe_rejects(rows: DataFrame, observation: Observation, rejected: Column) -> DataFrame:
    """``rows`` as they are; how many there were and how many are rejected comes with the action that runs the plan."""
    return rows.observe(observation, F.count(F.lit(1)).alias("total"), F.count_if(rejected).alias("rejects"))


def require_observed_share(observation: Observation, limit: float) -> None:
    """``require_reject_share`` after the action, without a second scan."""
    seen = observation.get
    require_reject_share(seen["rejects"], seen["total"], limit)
