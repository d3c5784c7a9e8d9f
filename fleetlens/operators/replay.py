"""Replay of scrapes over stored datapoints: which value each scrape serves, and from where.

At every scrape a series is served from the stored value while that is fresh; otherwise the newest point
of the lookback is fetched, stored until its expiry, and served. The next fetch depends on the last one,
so the scrapes of one series form a chain. What a fetch *would* return does not depend on the chain:
it is reduced first, by slot, over the whole cluster, to at most one row per series and scrape. Only
these rows, never the datapoints, are walked per series.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.operators.asof import Grid
from fleetlens.operators.keys import INSTANCE_KEY, SERIES_KEY, present
from fleetlens.operators.predicates import LOOKBACK_US, valid_point
from fleetlens.operators.ranking import top_n_per_group
from fleetlens.operators.rules import TtlRules, pattern_ttl
from fleetlens.session import ship_library

RUN_COLUMNS = ("from_slot", "to_slot", "value", "ts_us", "from_store")
RUN_SCHEMA = "from_slot bigint, to_slot bigint, value double, ts_us bigint, from_store boolean"
NO_TIME = -(2**62)
Entry = tuple[float, int, int]  # stored value, its time of measurement, its expiry


def fetchable(points: DataFrame, grid: Grid, lookback_us: int = LOOKBACK_US) -> DataFrame:
    """Newest value per (series, slot) with its time and the time of the point before it."""
    keys = present(points, SERIES_KEY)
    seen = (
        points.filter(valid_point())
        .filter((F.col("ts_us") >= grid.start_us - lookback_us) & (F.col("ts_us") <= grid.end_us))
        .withColumn("slot", grid.first_slot_at_or_after(F.col("ts_us")))
        .filter(F.col("slot") <= grid.last_slot)
    )
    two = top_n_per_group(seen, [*keys, "slot"], [F.desc("ts_us"), F.desc("pos")], 2)
    per_slot = two.groupBy(*keys, "slot").agg(
        F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("value"),
        F.max(F.when(F.col("rn") == 1, F.col("ts_us"))).alias("ts_us"),
        F.max(F.when(F.col("rn") == 2, F.col("ts_us"))).alias("second_us"),
    )
    before = F.lag("ts_us").over(Window.partitionBy(*keys).orderBy("slot"))
    return per_slot.repartition(*keys).withColumn("previous_us", F.coalesce("second_us", before, F.lit(NO_TIME))).drop("second_us")


def serve(
    slots: Sequence[int], values: Sequence[float], times: Sequence[int], previous: Sequence[int], ttl_us: int,
    grid: Grid, lookback_us: int, first_slot: int, last_slot: int, entry: Entry | None = None,
) -> tuple[list[tuple], Entry | None]:
    """Runs of scrapes served alike for one series, and the stored entry after the last of them."""
    runs: list[tuple] = []
    slot = first_slot
    while slot <= last_slot:
        now = grid.start_us + slot * grid.step_us
        if entry is not None and now <= entry[2]:
            until = min((entry[2] - grid.start_us) // grid.step_us, last_slot)
            runs.append((slot, until, entry[0], entry[1], True))
            slot = until + 1
            continue
        entry = None
        at = bisect_right(slots, slot) - 1
        if at < 0 or times[at] < now - lookback_us:
            if at + 1 >= len(slots):
                break
            slot = slots[at + 1]
            continue
        value, ts = values[at], times[at]
        observed = ts - previous[at] if previous[at] >= now - lookback_us else 0
        ttl = max(ttl_us, observed)
        if ttl > 0:
            entry = (value, ts, ts + ttl)
        runs.append((slot, slot, value, ts, False))
        slot += 1
    return runs, entry


def _runs_of_partition(keys: Sequence[str], grid: Grid, lookback_us: int):
    """Walk a partition sorted by series and slot, batch by batch.

    Of a series that goes on in the next batch only its last row, its stored entry and the next slot are carried, so
    memory does not grow with the length of a series.
    """
    columns = ("slot", "value", "ts_us", "previous_us", "pattern_ttl_us")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: tuple | None = None  # key, last row, ttl, next slot, entry

        def finish(owners: list, out: list) -> None:
            key, row, ttl, next_slot, entry = carried
            runs, _ = serve(*([v] for v in row), ttl, grid, lookback_us, next_slot, grid.last_slot, entry)
            owners += [key] * len(runs)
            out += runs

        def frame(owners: list, out: list) -> pd.DataFrame:
            named = pd.DataFrame(owners, columns=list(keys))
            return named.join(pd.DataFrame(out, columns=list(RUN_COLUMNS)))

        for rows in batches:
            if rows.empty:
                continue
            owners: list[tuple] = []
            out: list[tuple] = []
            ids = [rows[k].to_numpy() for k in keys]
            changed = np.logical_or.reduce([i[1:] != i[:-1] for i in ids])
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1, [len(rows)]]).tolist()
            slot, value, ts, previous, ttl = (rows[c].to_numpy() for c in columns)
            for start, end in zip(starts[:-1], starts[1:]):
                key = tuple(i[start] for i in ids)
                own = [a[start:end].tolist() for a in (slot, value, ts, previous)]
                first, own_ttl, entry = own[0][0], int(ttl[start]), None
                if carried is not None:
                    if carried[0] == key:
                        own = [[v, *a] for v, a in zip(carried[1], own)]
                        own_ttl, first, entry = carried[2:]
                    else:
                        finish(owners, out)
                last = own[0][-1]
                runs, entry = serve(*own, own_ttl, grid, lookback_us, first, last, entry)
                owners += [key] * len(runs)
                out += runs
                carried = (key, [a[-1] for a in own], own_ttl, last + 1, entry)
            if out:
                yield frame(owners, out)
        if carried is not None:
            owners, out = [], []
            finish(owners, out)
            if out:
                yield frame(owners, out)

    return walk


def replay(points: DataFrame, grid: Grid, rules: TtlRules = (), lookback_us: int = LOOKBACK_US) -> DataFrame:
    """The sample each series serves at each scrape of the grid; ``from_store`` tells hits from fetches."""
    keys = present(points, SERIES_KEY)
    rows = (
        fetchable(points, grid, lookback_us)
        .withColumn("pattern_ttl_us", pattern_ttl(F.col("metric"), rules))
        .sortWithinPartitions(*keys, "slot")
    )
    key_schema = ", ".join(f"{k} string" for k in keys)
    ship_library(points.sparkSession)
    runs = rows.mapInPandas(_runs_of_partition(keys, grid, lookback_us), f"{key_schema}, {RUN_SCHEMA}")
    return (
        runs.withColumn("slot", F.explode(F.sequence("from_slot", "to_slot")))
        .withColumn("at_us", grid.time_of(F.col("slot")))
        .select(*keys, "at_us", "value", "ts_us", "from_store")
    )


def replay_statistics(served: DataFrame) -> DataFrame:
    """Samples served per instance, from the store and by fetching."""
    return served.groupBy(*present(served, INSTANCE_KEY)).agg(
        F.count(F.lit(1)).alias("served"), F.count_if("from_store").alias("hits"),
        F.count_if(~F.col("from_store")).alias("fetches"),
    )
