"""Frames that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators.asof import Grid
from fleetlens.operators.latest import latest_valid
from fleetlens.operators.predicates import LOOKBACK_US
from fleetlens.plans.catalogue import build_catalogue
from fleetlens.plans.collection import collect_metrics, recent
from fleetlens.plans.inventory import discover_instances, discovered_instances
from fleetlens.plans.scrape import scrape_all, union_families
from fleetlens.plans.statements import top_statements
from fleetlens.queries import inputs as I
from fleetlens.session import materialize

NOW = I.NOW_US
HOUR_GRID = Grid(NOW - 3_600_000_000, NOW, 60_000_000)
SCRAPES = Grid(I.START_US, NOW, 60_000_000)


def eligible(spark: SparkSession, d: str) -> DataFrame:
    return discovered_instances(I.flat_instances(spark, d))


def fleet(spark: SparkSession, d: str) -> DataFrame:
    return discover_instances(I.flat_instances(spark, d), max_instances=None)


def recent_points(spark: SparkSession, d: str) -> DataFrame:
    return recent(I.fx_datapoints(spark, d, NOW - LOOKBACK_US, NOW), NOW)


def recent_dims(spark: SparkSession, d: str) -> DataFrame:
    return I.dim_points(spark, d, NOW - LOOKBACK_US, NOW)


def latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_valid(recent_points(spark, d))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return build_catalogue(I.fx_catalogue(spark, d), fleet(spark, d), "avg", *I.METRIC_RULES)


def counters(spark: SparkSession, d: str) -> DataFrame:
    return collect_metrics(recent_points(spark, d), catalogue(spark, d), fleet(spark, d), NOW)


def statement_samples(spark: SparkSession, d: str) -> DataFrame:
    return top_statements(I.fx_mysql_digests(spark, d), I.fx_pg_statements(spark, d), fleet(spark, d), I.policy(spark))


def exposition(spark: SparkSession, d: str) -> DataFrame:
    """Inventory and catalogue are small tables that every family needs: they are discovered once and stored."""
    known = materialize(fleet(spark, d), "inventory")
    metrics = materialize(build_catalogue(I.fx_catalogue(spark, d), known, "avg", *I.METRIC_RULES), "catalogue")
    return scrape_all(
        recent_points(spark, d), recent_dims(spark, d), I.fx_mysql_digests(spark, d), I.fx_pg_statements(spark, d),
        metrics, known, I.policy(spark), NOW, dimensions=10,
    )


def board(spark: SparkSession, d: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    return I.fx_board(spark, d, since_us, until_us)


def published(spark: SparkSession, d: str) -> DataFrame:
    return union_families(board(spark, d), statement_samples(spark, d))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.round(name, 6))
    return df


def big(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.col(name).cast("bigint"))
    return df
