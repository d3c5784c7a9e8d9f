"""Heaviest statements and wait events by load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.labels import (
    DIMENSION_HELP, DIMENSION_LABELS, dimension_sample_name, dimension_value, truncate_label,
)
from fleetlens.operators.aggregates import DIMENSION_PERIOD_US, period_start
from fleetlens.operators.keys import INSTANCE_KEY, present
from fleetlens.operators.lookups import join_instances
from fleetlens.operators.predicates import LOOKBACK_US, has_dimensions, in_lookback, supported_group, valid_point
from fleetlens.operators.ranking import top_n_per_group
from fleetlens.plans.collection import PREFIX

GROUPS = tuple(DIMENSION_LABELS)


def load_by_dimension(points: DataFrame, now_us: int, groups: Sequence[str] = GROUPS, lookback_us: int = LOOKBACK_US) -> DataFrame:
    """Mean load over the lookback per dimension value, with the newest one-minute average."""
    usable = points.filter(
        in_lookback(now_us, lookback_us) & F.col("dim_group").isin(*groups) & supported_group(F.col("dim_group"))
        & has_dimensions() & valid_point()
    )
    by = [*present(points, INSTANCE_KEY), "dim_group", "dims_key"]
    minutes = (
        usable.withColumn("dims_key", F.array_sort(F.map_entries("dims")))
        .withColumn("period_us", period_start(F.col("ts_us"), DIMENSION_PERIOD_US))
        .groupBy(*by, "period_us")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    )
    newest = F.max_by(F.col("total") / F.col("n"), "period_us").alias("value")
    loads = minutes.groupBy(*by).agg((F.sum("total") / F.sum("n")).alias("load"), newest, F.max("period_us").alias("ts_us"))
    return loads.withColumn("dims", F.map_from_entries("dims_key")).drop("dims_key")


def top_load(loads: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest dimension values of each instance and group; ties in the order of their text."""
    dims = F.concat_ws("\u0001", F.map_values("dims"))
    group = [*present(loads, INSTANCE_KEY), "dim_group"]
    return top_n_per_group(loads.withColumn("_dims", dims), group, [F.desc("load"), F.asc("_dims")], n).drop("_dims")


def publish_dimensions(ranked: DataFrame, instances: DataFrame, prefix: str = PREFIX) -> DataFrame:
    rows = join_instances(ranked, instances)
    labels = []
    for group, names in DIMENSION_LABELS.items():
        for label, key in names.items():
            text = dimension_value(F.col("dims"), key)
            text = truncate_label(text) if label == "statement" else text
            labels.append(F.when(F.col("dim_group") == group, text).alias(label))
    return rows.select(
        dimension_sample_name(prefix, F.col("engine"), F.col("dim_group")).alias("name"),
        F.concat(F.lit(DIMENSION_HELP), "dim_group").alias("help"),
        "identifier", "cluster_identifier", "region", "engine", *labels, "value", "ts_us",
    )


def top_load_by_dimension(
    points: DataFrame, instances: DataFrame, now_us: int, n: int, groups: Sequence[str] = GROUPS, prefix: str = PREFIX,
) -> DataFrame:
    return publish_dimensions(top_load(load_by_dimension(points, now_us, groups), n), instances, prefix)
