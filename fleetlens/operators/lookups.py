"""Joins of samples, inventory, catalogue and policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.metrics import split_metric
from fleetlens.operators.keys import shared


def with_base(samples: DataFrame) -> DataFrame:
    parts = split_metric(F.col("metric"))
    return samples.withColumn("base", parts.base).withColumn("statistic", parts.statistic)


def _catalogue_side(samples: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, list[str]]:
    keys = shared(samples, catalogue)
    return catalogue.withColumnRenamed("metric", "base"), [*keys, "base"]


def join_catalogue(samples: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Samples with the description and unit of their metric; others drop out (see ``not_in_catalogue``)."""
    side, keys = _catalogue_side(samples, catalogue)
    return with_base(samples).join(side, keys)


def requested_only(joined: DataFrame) -> DataFrame:
    return joined.filter(F.array_contains("statistics", F.col("statistic")))


def not_in_catalogue(samples: DataFrame, catalogue: DataFrame) -> DataFrame:
    side, keys = _catalogue_side(samples, catalogue)
    return with_base(samples).join(side.select(*keys), keys, "left_anti")


def join_instances(samples: DataFrame, instances: DataFrame) -> DataFrame:
    """Samples with the label columns of their instance. Spark broadcasts the inventory if it is small."""
    extra = ("region", "identifier", "cluster_identifier", "engine")
    labels = [name for name in extra if name not in samples.columns]
    if not labels:
        return samples
    keys = shared(samples, instances)
    return samples.join(instances.select(*keys, *[n for n in labels if n not in keys]), keys)


def policy_for_clusters(instances: DataFrame, policy: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Policy attributes per instance, null where no row applies.

    The first row naming the instance's cluster wins; otherwise the last default row (cluster ``""``).
    ``policy`` carries ``ordinal`` to tell first from last. The default is a scalar, not a join.
    """
    row = F.struct(*attributes)
    per_cluster = policy.groupBy(F.col("cluster").alias("cluster_identifier")).agg(
        F.min_by(row, "ordinal").alias("_specific")
    )
    default = policy.filter(F.col("cluster") == "").agg(F.max_by(row, "ordinal")).scalar()
    return (
        instances.join(per_cluster, "cluster_identifier", "left")
        .withColumn("_policy", F.coalesce("_specific", default))
        .select(*instances.columns, *[F.col(f"_policy.{name}").alias(name) for name in attributes])
    )


def with_policy_only(instances: DataFrame, policy: DataFrame) -> DataFrame:
    """Instances some policy row applies to; the others are left out silently."""
    found = policy_for_clusters(instances, policy.withColumn("_applies", F.lit(True)), ["_applies"])
    return found.filter("_applies").drop("_applies")


def split_fresh(requested: DataFrame, fresh: DataFrame, keys: Sequence[str], now_us: int) -> DataFrame:
    """Requested series with what the fresh state holds for them: ``is_hit`` tells served from fetched."""
    live = fresh.filter(F.col("expires_at_us") >= now_us).select(*keys, "value", "ts_us")
    return requested.join(live.withColumn("is_hit", F.lit(True)), list(keys), "left").withColumn(
        "is_hit", F.coalesce("is_hit", F.lit(False))
    )


def hits(requested: DataFrame, fresh: DataFrame, keys: Sequence[str], now_us: int) -> DataFrame:
    live = fresh.filter(F.col("expires_at_us") >= now_us)
    return live.join(requested.select(*keys), list(keys), "left_semi")


def misses(requested: DataFrame, fresh: DataFrame, keys: Sequence[str], now_us: int) -> DataFrame:
    live = fresh.filter(F.col("expires_at_us") >= now_us).select(*keys)
    return requested.join(live, list(keys), "left_anti")
