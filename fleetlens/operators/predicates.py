"""Row predicates. All are plain columns, so Catalyst pushes them down to the scan where it can."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions.engines import normalize_engine, statement_family
from fleetlens.functions.labels import DIMENSION_LABELS
from fleetlens.functions.metrics import metric_category
from fleetlens.functions.text import java_regex

# Lookback of a request, most identifiers in one request, zero creation time (year 1).
LOOKBACK_US = 180_000_000
MAX_IDENTIFIERS = 5
ZERO_TIME_US = -62_135_596_800_000_000


def instance_defect() -> Column:
    """First reason why a flattened inventory record cannot be used; null when it can."""
    c = F.col
    engine = normalize_engine(c("engine_raw"))
    return (
        F.when(c("engine_raw").isNull(), "missing_engine")
        .when(c("status").isNull(), "missing_status")
        .when(c("resource_id").isNull(), "missing_resource_id")
        .when(c("identifier").isNull(), "missing_identifier")
        .when(c("creation_us").isNull() | (c("creation_us") == ZERO_TIME_US), "missing_creation_time")
        .when(~c("insights_enabled"), "insights_disabled")
        .when(engine == "", "unknown_engine")
        .when((c("resource_id") == "") | (c("identifier") == ""), "empty_identity")
    )


def valid_catalogue_row() -> Column:
    return F.col("metric").isNotNull() & F.col("description").isNotNull() & F.col("unit").isNotNull()


def valid_point() -> Column:
    return F.col("value").isNotNull() & F.col("ts_us").isNotNull()


def has_series_key() -> Column:
    return F.col("metric").isNotNull()


def has_dimensions() -> Column:
    return F.coalesce(F.size("dims") > 0, F.lit(False))


def supported_group(group: Column) -> Column:
    return F.coalesce(group.isin(*DIMENSION_LABELS), F.lit(False))


def clean_identifiers(identifiers: Sequence[str]) -> list[str]:
    """Trim; more than MAX_IDENTIFIERS is an error."""
    if len(identifiers) > MAX_IDENTIFIERS:
        raise ValueError(f"at most {MAX_IDENTIFIERS} identifiers, got {len(identifiers)}")
    return [text.strip() for text in identifiers]


def identifier_in(identifiers: Sequence[str]) -> Column:
    """Instances named in a request; unknown names are ignored, an empty list selects nothing."""
    ids = clean_identifiers(identifiers)
    return F.col("identifier").isin(*ids) if ids else F.lit(False)


def mysql_digest_usable() -> Column:
    return F.col("digest").isNotNull() & F.col("schema_name").isNotNull()


def pg_statement_usable() -> Column:
    return F.col("queryid").isNotNull()


def in_lookback(now_us: int, lookback_us: int = LOOKBACK_US) -> Column:
    return F.col("ts_us").between(F.lit(now_us - lookback_us), F.lit(now_us))


def label_matches(label: Column, pattern: str) -> Column:
    """Label matcher of dashboards: the whole label must match."""
    return F.coalesce(label.rlike(java_regex(f"^(?:{pattern})$")), F.lit(False))


def requested_type(metric: Column) -> Column:
    """Metrics of the two requested types, whatever the case in which a service spells them."""
    return metric_category(F.lower(metric)).isin("os", "db")


def statement_source_usable() -> Column:
    return (F.col("endpoint") != "") & (F.col("port") != 0) & statement_family(F.col("engine")).isNotNull()


def reject(df: DataFrame, reason: Column) -> DataFrame:
    """Rows with a reason, as a table."""
    return df.withColumn("reason", reason).filter(F.col("reason").isNotNull())
