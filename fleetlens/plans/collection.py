"""Counter metrics: the newest value per series, labelled and named."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.metrics import emitted_name
from fleetlens.operators.freshness import effective_ttl, expires_at, is_expired
from fleetlens.operators.keys import SERIES_KEY, present, shared
from fleetlens.operators.latest import latest_valid, latest_with_interval
from fleetlens.operators.lookups import join_catalogue, join_instances, requested_only
from fleetlens.operators.predicates import LOOKBACK_US, has_series_key, identifier_in, in_lookback
from fleetlens.operators.rules import TtlRules, pattern_ttl
from fleetlens.schemas import COUNTER_LABELS

PREFIX = "dbi"


def publish(samples: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Samples with instance labels, unit and description, in the shape of the exposition table."""
    return samples.select(
        emitted_name(prefix, F.col("engine"), F.col("metric")).alias("name"),
        F.col("description").alias("help"), *COUNTER_LABELS, "value", "ts_us",
    )


def recent(points: DataFrame, now_us: int, lookback_us: int = LOOKBACK_US) -> DataFrame:
    return points.filter(in_lookback(now_us, lookback_us) & has_series_key())


def collect_metrics(points: DataFrame, catalogue: DataFrame, instances: DataFrame, now_us: int, prefix: str = PREFIX) -> DataFrame:
    """Points are cut to the lookback at the scan and to one row per series before any join.

    A catalogue that carries the instance labels (as ``build_catalogue`` returns) saves the second join.
    """
    latest = latest_valid(recent(points, now_us))
    requested = requested_only(join_catalogue(latest, catalogue))
    return publish(join_instances(requested, instances), prefix)


def collect_metrics_for(
    identifiers: Sequence[str], points: DataFrame, catalogue: DataFrame, instances: DataFrame, now_us: int,
    prefix: str = PREFIX,
) -> DataFrame:
    """Counters of at most five named instances; only their points are read into the aggregate."""
    chosen = instances.filter(identifier_in(identifiers))
    keys = shared(points, chosen)
    mine = points.join(chosen.select(*keys), keys, "left_semi")
    return collect_metrics(mine, catalogue, chosen, now_us, prefix)


def freshness(points: DataFrame, rules: TtlRules, now_us: int, lookback_us: int = LOOKBACK_US) -> DataFrame:
    """Newest value per series with its effective TTL and expiry; series without a TTL are not kept."""
    newest = latest_with_interval(recent(points, now_us, lookback_us))
    ttl = effective_ttl(pattern_ttl(F.col("metric"), rules), F.col("dynamic_ttl_us"))
    kept = newest.withColumn("ttl_us", ttl).filter(F.col("ttl_us") > 0)
    keys = present(kept, SERIES_KEY)
    return (
        kept.withColumn("expires_at_us", expires_at(F.col("ts_us"), F.col("ttl_us")))
        .withColumn("expired", is_expired(F.col("expires_at_us"), now_us))
        .select(*keys, "value", "ts_us", "dynamic_ttl_us", "ttl_us", "expires_at_us", "expired")
    )
