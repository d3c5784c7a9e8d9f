"""From raw inventory to the instances that are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.engines import normalize_engine
from fleetlens.operators.asof import snapshot_at
from fleetlens.operators.predicates import instance_defect
from fleetlens.operators.ranking import oldest_instances
from fleetlens.operators.rules import Rules, pattern_filter

INVENTORY = (
    "region", "resource_id", "identifier", "cluster_identifier", "endpoint", "port", "engine", "creation_us", "tags",
)


def _rules_column(include: Rules | None, exclude: Rules | None) -> Column:
    fields = {"identifier": F.col("identifier"), "engine": normalize_engine(F.col("engine_raw"))}
    return pattern_filter(fields, F.col("tags"), include, exclude)


def discovered_instances(flat: DataFrame, include: Rules | None = None, exclude: Rules | None = None) -> DataFrame:
    """Usable instances that pass the rules, before any cap."""
    usable = flat.filter(instance_defect().isNull() & _rules_column(include, exclude))
    return usable.withColumn("engine", normalize_engine(F.col("engine_raw"))).select(*INVENTORY)


def discover_instances(
    flat: DataFrame, include: Rules | None = None, exclude: Rules | None = None, max_instances: int | None = None,
    at_us: int | None = None,
) -> DataFrame:
    """The oldest ``max_instances`` of each region among the usable ones that pass the rules; None keeps all.

    Of an inventory with several snapshots (``fetched_at_us``) the one usable at ``at_us`` counts, per region.
    """
    if at_us is not None:
        flat = snapshot_at(flat, ["region"], at_us)
    found = discovered_instances(flat, include, exclude)
    if max_instances is None:
        return found
    return oldest_instances(found, max_instances).select(*INVENTORY)


def instance_rejects(flat: DataFrame, include: Rules | None = None, exclude: Rules | None = None) -> DataFrame:
    """Records that are not usable, or not wanted, with the reason; defects are named first."""
    reason = F.coalesce(instance_defect(), F.when(~_rules_column(include, exclude), "filtered_out"))
    rows = flat.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return rows.select("region", "resource_id", "identifier", "engine_raw", "reason")


def statistics_of_discovery(flat: DataFrame, include: Rules | None, exclude: Rules | None, max_instances: int) -> DataFrame:
    """Discovered and kept instances per region; what the cap keeps is known from the count alone."""
    found = discovered_instances(flat, include, exclude).groupBy("region").agg(F.count(F.lit(1)).alias("discovered"))
    return found.withColumn("kept", F.least("discovered", F.lit(max_instances).cast("bigint")))
