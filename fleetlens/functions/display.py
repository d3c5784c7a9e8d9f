"""What a dashboard shows: ratios, status colours, series names, rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: a valid name for a published metric.
VALID_NAME = r"\A[a-zA-Z_:][a-zA-Z0-9_:]*\z"

Steps = Sequence[tuple[float | None, str]]


def percent_used(free: Column, total: Column) -> Column:
    """``(1 - free / total) * 100``; null, not infinity, when the total is zero."""
    return (F.lit(1.0) - F.try_divide(free, total)) * F.lit(100.0)


def threshold_colour(value: Column, steps: Steps) -> Column:
    """Colour of the last step whose lower bound does not exceed the value; a null bound has no limit."""
    result = None
    for bound, colour in reversed(steps):
        holds = value.isNotNull() if bound is None else value >= F.lit(float(bound))
        result = F.when(holds, F.lit(colour)) if result is None else result.when(holds, F.lit(colour))
    return result


def threshold_colour_from(value: Column, steps: Column) -> Column:
    """The same with the steps as an array of ``struct(bound, colour)`` held in the data."""
    reached = F.filter(steps, lambda s: s["bound"].isNull() | (value >= s["bound"]))
    return F.when(value.isNotNull(), F.try_element_at(reached, F.lit(-1))["colour"])


def display_name(label: Column, suffix: str = "") -> Column:
    return F.concat_ws(" ", label, F.lit(suffix)) if suffix else label


def panel_round(value: Column, decimals: int | None) -> Column:
    """The value with the decimals a panel sets; as it is where the panel sets none."""
    return value if decimals is None else F.round(value, decimals)


def is_valid_prefix(name: Column) -> Column:
    return F.coalesce(name.rlike(VALID_NAME) & ~name.startswith("_"), F.lit(False))
