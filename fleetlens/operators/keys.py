"""Column names that identify instances and series, as far as a table carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.schemas import LABELS

INSTANCE_KEY = ("region", "resource_id")
SERIES_KEY = (*INSTANCE_KEY, "metric")


def present(df: DataFrame, names) -> list[str]:
    return [name for name in names if name in df.columns]


def shared(left: DataFrame, right: DataFrame, names=INSTANCE_KEY) -> list[str]:
    """Key columns both sides have; a table of one region need not repeat it."""
    found = [name for name in names if name in left.columns and name in right.columns]
    if not found:
        raise ValueError(f"no common key among {names}")
    return found


def label_columns(df: DataFrame) -> list[str]:
    return present(df, LABELS)
