"""As-of selection: the newest row at one time, or at every time of a grid, without a range join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: how far back an instant query looks for a sample.
INSTANT_LOOKBACK_US = 300_000_000


@dataclass(frozen=True)
class Grid:
    """Evaluation times ``start, start + step, ...`` up to and including ``end`` (microseconds)."""

    start_us: int
    end_us: int
    step_us: int

    def __post_init__(self):
        if self.step_us <= 0 or self.end_us < self.start_us:
            raise ValueError(f"not a grid: {self}")

    @property
    def last_slot(self) -> int:
        return (self.end_us - self.start_us) // self.step_us

    def _steps(self, distance_us: Column) -> Column:
        # taking the remainder off first keeps the division exact
        step = F.lit(self.step_us)
        return ((distance_us - F.pmod(distance_us, step)) / step).cast("bigint")

    def first_slot_at_or_after(self, time_us: Column) -> Column:
        ahead = self._steps(time_us - F.lit(self.start_us) + F.lit(self.step_us - 1))
        return F.greatest(ahead, F.lit(0).cast("bigint"))

    def last_slot_at_or_before(self, time_us: Column) -> Column:
        behind = self._steps(time_us - F.lit(self.start_us))
        return F.least(behind, F.lit(self.last_slot).cast("bigint"))

    def time_of(self, slot: Column) -> Column:
        return (F.lit(self.start_us) + slot * F.lit(self.step_us)).cast("bigint")


def _newest(order: Sequence[str], payload: Sequence[str]) -> list[Column]:
    """Aggregates that keep the newest row's columns.

    One ordering column needs plain numbers only, and Spark hashes; several need a struct, and it sorts.
    """
    if len(order) == 1:
        return [F.max(order[0]).alias(order[0]), *[F.max_by(c, order[0]).alias(c) for c in payload]]
    return [F.max(F.struct(*order, *[c for c in payload if c not in order])).alias("newest")]


def _one_value_a_time(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of values of one series and time the largest: what is newest is then settled, and stays a hash aggregate."""
    return samples.groupBy(*keys, "ts_us").agg(F.max("value").alias("value"))


def _unpacked(folded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return folded.select(*keys, "newest.*") if "newest" in folded.columns else folded


def instant(
    samples: DataFrame, keys: Sequence[str], at_us: int, lookback_us: int = INSTANT_LOOKBACK_US, order: Sequence[str] = ("ts_us",),
) -> DataFrame:
    """Newest sample of each series with ``at - lookback < ts <= at``.

    Of values that disagree at one time (see ``quality.duplicate_series``) the largest counts.
    """
    seen = samples.filter((F.col("ts_us") <= at_us) & (F.col("ts_us") > at_us - lookback_us))
    if order == ("ts_us",):
        seen = _one_value_a_time(seen, keys)
    return _unpacked(seen.groupBy(*keys).agg(*_newest(order, ["value"])), keys).select(*keys, "value", "ts_us")


def newest_per_slot(rows: DataFrame, keys: Sequence[str], grid: Grid, order: Sequence[str], lookback_us: int) -> DataFrame:
    """Put each row into the first slot that sees it and keep the newest of each (key, slot).

    Grouping by slot as well as by key spreads a hot key over the cluster, and what is left of a key is
    at most one row per slot, however many rows it had.
    """
    payload = [c for c in rows.columns if c not in (*keys, *order)]
    slotted = (
        rows.filter((F.col("ts_us") > grid.start_us - lookback_us) & (F.col("ts_us") <= grid.end_us))
        .withColumn("slot", grid.first_slot_at_or_after(F.col("ts_us")))
        .filter(F.col("slot") <= grid.last_slot)
    )
    # the number first: a sort for the aggregate then compares it before any text
    return _unpacked(slotted.groupBy("slot", *keys).agg(*_newest(order, payload)), ["slot", *keys])


def over_grid(
    samples: DataFrame, keys: Sequence[str], grid: Grid, lookback_us: int = INSTANT_LOOKBACK_US,
    order: Sequence[str] = ("ts_us",), inclusive: bool = False,
) -> DataFrame:
    """The as-of row of each key at every grid time (``at_us``); for ``order`` see ``instant``.

    A slot's row stays current until the key's next non-empty slot or until the lookback ends, so it is
    repeated for just those slots. Nothing is joined with the grid.
    """
    reach_us = lookback_us + (1 if inclusive else 0)
    if order == ("ts_us",) and set(samples.columns) == {*keys, "ts_us", "value"}:
        samples = _one_value_a_time(samples.filter((F.col("ts_us") > grid.start_us - reach_us) & (F.col("ts_us") <= grid.end_us)), keys)
    folded = newest_per_slot(samples, keys, grid, order, reach_us)
    following = F.lead("slot").over(Window.partitionBy(*keys).orderBy("slot"))
    reach = F.col("ts_us") + F.lit(lookback_us if inclusive else lookback_us - 1)
    until = F.least(F.coalesce(following - 1, F.lit(grid.last_slot)), grid.last_slot_at_or_before(reach))
    spread = folded.withColumn("until", until).filter(F.col("until") >= F.col("slot"))
    return (
        spread.withColumn("slot", F.explode(F.sequence("slot", "until")))
        .withColumn("at_us", grid.time_of(F.col("slot")))
        .drop("slot", "until")
    )


def usable_snapshots(snapshots: DataFrame, keys: Sequence[str], grid: Grid, ttl_us: int) -> DataFrame:
    """Newest snapshot of each key at each grid time, and whether it has outlived its TTL.

    ``snapshots`` carries ``fetched_at_us``. A stale snapshot is still the newest one there is.
    """
    rows = snapshots.select(*keys, F.col("fetched_at_us").alias("ts_us"))
    forever = 2 * 10**17  # longer than any two times lie apart
    return (
        over_grid(rows, keys, grid, forever, inclusive=True)
        .withColumnRenamed("ts_us", "fetched_at_us")
        .withColumn("is_stale", F.col("at_us") > F.col("fetched_at_us") + F.lit(ttl_us))
    )


def snapshot_at(rows: DataFrame, keys: Sequence[str], at_us: int, ttl_us: int | None = None) -> DataFrame:
    """The rows of each key's newest snapshot at one time, and ``is_stale`` where a TTL is given.

    ``rows`` carry ``fetched_at_us``, the time of the snapshot they belong to; a null time belongs to none. What is
    joined back is one row per key.
    """
    newest = rows.filter(F.col("fetched_at_us") <= at_us).groupBy(*keys).agg(F.max("fetched_at_us").alias("_newest_us"))
    a, b = rows.alias("a"), newest.alias("b")
    same = F.col("a.fetched_at_us") == F.col("b._newest_us")
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    found = a.join(b, same).select("a.*")
    return found if ttl_us is None else found.withColumn("is_stale", F.lit(at_us) > F.col("fetched_at_us") + F.lit(ttl_us))
