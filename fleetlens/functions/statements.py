"""Statement statistics: text, digest, units."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TEXT_LIMIT = 200
PICOS_PER_MILLI = 1_000_000_000
PICOS_PER_SECOND = 1_000_000_000_000


def statement_text(text: Column) -> Column:
    return F.coalesce(F.left(text, F.lit(TEXT_LIMIT)), F.lit(""))


def query_digest(digest: Column) -> Column:
    return F.coalesce(digest.cast("string"), F.lit(""))


def wait_ms(picos: Column) -> Column:
    return picos.cast("double") / F.lit(float(PICOS_PER_MILLI))


def lock_time_ms(picos: Column) -> Column:
    """Published under a milliseconds name, although the divisor yields seconds."""
    return picos.cast("double") / F.lit(float(PICOS_PER_SECOND))


def lock_time_ms_true(picos: Column) -> Column:
    return picos.cast("double") / F.lit(float(PICOS_PER_MILLI))


def io_time_ms(read_ms: Column, write_ms: Column) -> Column:
    return F.coalesce(read_ms, F.lit(0.0)) + F.coalesce(write_ms, F.lit(0.0))
