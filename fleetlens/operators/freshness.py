"""Freshness of fetched samples: effective TTL, expiry, eviction, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.operators.ranking import earliest_k


def effective_ttl(pattern_ttl_us: Column, dynamic_ttl_us: Column) -> Column:
    """The longer of rule and observed interval; 0 means the sample is not kept."""
    return F.greatest(pattern_ttl_us, dynamic_ttl_us)


def expires_at(ts_us: Column, ttl_us: Column) -> Column:
    """Counted from the time of measurement, so an old sample may be expired when it arrives."""
    return ts_us + ttl_us


def is_expired(expires_at_us: Column, now_us: int | Column) -> Column:
    """Strictly after: at the very moment of expiry a sample is still fresh."""
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    return now > expires_at_us


def fresh_only(state: DataFrame, now_us: int) -> DataFrame:
    return state.filter(~is_expired(F.col("expires_at_us"), now_us))


def peek(state: DataFrame, now_us: int) -> DataFrame:
    return state.withColumn("expired", is_expired(F.col("expires_at_us"), now_us))


def evicted(state: DataFrame, keys: Sequence[str], now_us: int, limit: int) -> DataFrame:
    """Up to ``limit`` expired entries, the earliest expiry first."""
    expired = state.filter(is_expired(F.col("expires_at_us"), now_us))
    return earliest_k(expired, "expires_at_us", keys, limit)


def retained(state: DataFrame, keys: Sequence[str], now_us: int, max_size: int) -> DataFrame:
    """What a store of ``max_size`` entries keeps: nothing expired, then the latest expiries."""
    live = fresh_only(state, now_us).withColumn("_until_us", -F.col("expires_at_us"))
    return earliest_k(live, "_until_us", keys, max_size).drop("_until_us")


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the latest arrival (``arrival_seq``) wins, over state and changes together."""
    return latest_arrival(state.unionByName(changes), keys)


def latest_arrival(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "arrival_seq")]
    last = F.max(F.struct("arrival_seq", *rest)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")
