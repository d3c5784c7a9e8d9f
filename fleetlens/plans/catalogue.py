"""From raw metric catalogues to the metrics and statistics that are requested."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetlens.operators.aggregates import canonical_definitions
from fleetlens.operators.asof import snapshot_at
from fleetlens.operators.keys import INSTANCE_KEY, present, shared
from fleetlens.operators.predicates import requested_type, valid_catalogue_row
from fleetlens.operators.rules import Rules, metric_fields, pattern_filter, select_statistics

# The load metric, which no catalogue lists but every instance has.
LOAD_METRIC = "db.load"
LOAD_DESCRIPTION = "Database load (DB load) measures the level of session activity in your database"
LOAD_UNIT = "Average Active Sessions"


INSTANCE_LABELS = ("region", "engine", "identifier", "cluster_identifier")


def of_instances(raw: DataFrame, instances: DataFrame) -> DataFrame:
    """Catalogue rows of known instances, with the instance's labels."""
    keys = shared(raw, instances)
    rows = raw.join(instances.select(*keys, *[n for n in INSTANCE_LABELS if n not in keys]), keys)
    return rows if "seen_at_us" in rows.columns else rows.withColumn("seen_at_us", F.lit(0).cast("bigint"))


def with_load_metric(catalogue: DataFrame) -> DataFrame:
    """Put the load metric before the entries of every catalogue that has any.

    Each entry brings the load metric along, and ``unique_definitions`` folds these copies into one before
    the shuffle: no second scan to find the instances.
    """
    entry = ("ordinal", "metric", "description", "unit")
    load = (F.lit(-1), F.lit(LOAD_METRIC), F.lit(LOAD_DESCRIPTION), F.lit(LOAD_UNIT))
    itself = F.struct(*[F.col(n) for n in entry])
    first = F.struct(*[value.alias(n) for n, value in zip(entry, load)])
    rest = [n for n in catalogue.columns if n not in entry]
    return catalogue.select(*rest, F.inline(F.array(first, itself)))


def chosen_entries(catalogue: DataFrame, default: str, include: Rules | None, exclude: Rules | None) -> DataFrame:
    """Valid entries with the statistics to request; entries without any drop out."""
    statistics = select_statistics(F.col("metric"), default, include, exclude)
    return catalogue.filter(valid_catalogue_row()).withColumn("statistics", statistics).filter(F.size("statistics") > 0)


def build_catalogue(
    raw: DataFrame, instances: DataFrame, default: str = "avg",
    include: Rules | None = None, exclude: Rules | None = None, at_us: int | None = None,
) -> DataFrame:
    """One row per instance and requested metric: canonical description, unit, statistics, instance labels.

    Of a catalogue with several snapshots (``fetched_at_us``) the one usable at ``at_us`` counts, per instance.
    """
    if at_us is not None:
        raw = snapshot_at(raw, present(raw, INSTANCE_KEY), at_us)
    requested = raw.filter(F.col("metric").isNull() | requested_type(F.col("metric")))
    entries = chosen_entries(with_load_metric(of_instances(requested, instances)), default, include, exclude)
    unique = canonical_definitions(entries)
    wanted = pattern_filter(metric_fields(F.col("metric"), F.col("unit")), None, include, exclude)
    return unique.filter(wanted).select(
        "region", "resource_id", "engine", "identifier", "cluster_identifier", "metric", "description", "unit", "statistics"
    )


def requested_series(catalogue: DataFrame) -> DataFrame:
    """Each metric once per statistic, as ``metric.statistic``."""
    rows = catalogue.withColumn("statistic", F.explode("statistics"))
    return rows.withColumn("series", F.concat_ws(".", "metric", "statistic")).drop("statistics")


def empty_catalogues(raw: DataFrame, instances: DataFrame) -> DataFrame:
    """Instances without any catalogue entry: an error for the instance, not for the run."""
    keys = shared(raw, instances)
    missing = instances.join(raw.select(*keys).distinct(), keys, "left_anti")
    return missing.select("region", "resource_id", "identifier", F.lit("empty_catalogue").alias("reason"))
