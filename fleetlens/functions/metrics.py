"""Metric names: statistic suffix, category, sanitised and emitted form."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

from fleetlens.functions.engines import engine_short_name

# Statistics, in the order in which suffixes are checked.
STATISTICS = ("avg", "min", "max", "sum")
_SUFFIXED = r"(?s)\A(.+)\.(" + "|".join(STATISTICS) + r")\z"


class MetricParts(NamedTuple):
    base: Column
    statistic: Column


def parse_statistic(text: Column) -> Column:
    return F.when(text.isin(*STATISTICS), text).otherwise(F.lit(""))


def split_metric(metric: Column) -> MetricParts:
    """``base.statistic`` taken apart; both parts are ``""`` without a recognised suffix or a base."""
    return MetricParts(F.regexp_extract(metric, _SUFFIXED, 1), F.regexp_extract(metric, _SUFFIXED, 2))


def metric_category(metric: Column) -> Column:
    return (
        F.when(metric.startswith("os."), F.lit("os"))
        .when(metric.startswith("db."), F.lit("db"))
        .otherwise(F.lit("other"))
    )


def sanitize(metric: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(metric, F.lit("."), F.lit("_")), "[^a-zA-Z0-9_:]+", ""))


def emitted_name(prefix: str, engine: Column, metric: Column) -> Column:
    """Name under which a sample is published; only ``db.`` metrics carry the engine."""
    engine_part = F.when(
        metric.startswith("db."), F.concat(F.lit("_"), engine_short_name(engine))
    ).otherwise(F.lit(""))
    return F.concat(F.lit(prefix), engine_part, F.lit("_"), sanitize(metric))


