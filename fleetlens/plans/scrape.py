"""Everything one evaluation publishes: counters, load by dimension, statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fleetlens.plans.collection import PREFIX, collect_metrics
from fleetlens.plans.dimensions import top_load_by_dimension
from fleetlens.plans.statements import top_statements
from fleetlens.schemas import EXPOSITION


def union_families(*families: DataFrame) -> DataFrame:
    """Sample families in one table; a label a family does not have is null."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)
    missing = [F.lit(None).cast("string").alias(n) for n in EXPOSITION if n not in rows.columns]
    return rows.select("*", *missing).select(*EXPOSITION)


def scrape_all(
    points: DataFrame, dim_points: DataFrame, digests: DataFrame, statements: DataFrame,
    catalogue: DataFrame, instances: DataFrame, policy: DataFrame, now_us: int, dimensions: int, prefix: str = PREFIX,
) -> DataFrame:
    return union_families(
        collect_metrics(points, catalogue, instances, now_us, prefix),
        top_load_by_dimension(dim_points, instances, now_us, dimensions, prefix=prefix),
        top_statements(digests, statements, instances, policy, prefix),
    )
