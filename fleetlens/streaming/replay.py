"""Scrapes over a stream of points: the stored values live in the streaming state.

The state is grouped by a hash bucket of the series, not by series: a call into Python then serves many
series, and the series of a busy instance spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.operators.asof import Grid
from fleetlens.operators.keys import SERIES_KEY, present
from fleetlens.operators.predicates import LOOKBACK_US, valid_point
from fleetlens.operators.replay import NO_TIME, RUN_COLUMNS, RUN_SCHEMA, serve
from fleetlens.operators.rules import TtlRules, pattern_ttl
from fleetlens.session import ship_library
from fleetlens.streaming.aggregates import with_event_time

# Several per shuffle partition. Part of the state's layout: a checkpoint must go on with its number.
BUCKETS = 4096
POINT = np.dtype([("owner", "i8"), ("slot", "i8"), ("ts_us", "i8"), ("pos", "i8"), ("value", "f8")])
SERIES = np.dtype([("ttl", "i8"), ("next_slot", "i8"), ("stored", "f8"), ("stored_ts", "i8"), ("expires", "i8")])


def _state_schema(keys: Sequence[str]) -> str:
    """Names as they are; numbers as the bytes of their records, which neither side takes apart one by one."""
    return ", ".join([*(f"key_{k} array<string>" for k in keys), "series binary", "points binary"])


def _records(dtype: np.dtype, columns: Sequence) -> np.ndarray:
    columns = [np.asarray(column) for column in columns]
    out = np.empty(len(columns[0]), dtype=dtype)
    for name, column in zip(dtype.names, columns):
        out[name] = column
    return out


def newest_two_per_slot(points: np.ndarray) -> np.ndarray:
    """The newest two points of each series and slot, sorted by series, slot, time and position."""
    points = points[np.lexsort((points["pos"], points["ts_us"], points["slot"], points["owner"]))]
    keep = np.ones(len(points), dtype=bool)
    keep[:-2] = (points["slot"][:-2] != points["slot"][2:]) | (points["owner"][:-2] != points["owner"][2:])
    return points[keep]


def per_slot(points: np.ndarray) -> tuple[np.ndarray, list, list, list, list]:
    """Of sorted points the newest of each series and slot: owners, slots, values, times, and the time of the point before each."""
    owners, slots, times = points["owner"], points["slot"], points["ts_us"]
    same_owner = owners[1:] == owners[:-1]
    last = np.ones(len(points), dtype=bool)
    last[:-1] = ~same_owner | (slots[1:] != slots[:-1])
    before = np.full(len(points), NO_TIME, dtype="i8")
    before[1:][same_owner] = times[:-1][same_owner]
    return owners[last], slots[last].tolist(), points["value"][last].tolist(), times[last].tolist(), before[last].tolist()


class _Bucket:
    """The series of one bucket, their stored entries and the points still within reach of a scrape."""

    def __init__(self, keys: Sequence[str], state: tuple | None):
        self.keys = list(keys)
        *names, series, points = state if state else ([], b"", b"")
        self.names = list(zip(*names))
        self.series = np.frombuffer(bytes(series), SERIES).copy()
        self.points = np.frombuffer(bytes(points), POINT).copy()

    def add(self, batch: pd.DataFrame, unserved: int) -> None:
        """Fold a batch in; only two points per series and slot are ever held.

        A point that comes late brings the next scrape of its series forward, to ``unserved`` at the earliest, the
        first slot that no scrape has served.
        """
        known = {name: number for number, name in enumerate(self.names)}
        codes = batch.groupby(self.keys, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(codes, return_index=True)[1]
        owners, added = np.empty(len(first), dtype="i8"), []
        ids = list(zip(*(batch[k].to_numpy()[first] for k in self.keys)))
        ttls = batch["pattern_ttl_us"].to_numpy()[first]
        for code, name in enumerate(ids):
            if name not in known:
                known[name] = len(self.names)
                self.names.append(name)
                added.append((ttls[code], -1, 0.0, 0, NO_TIME))
            owners[code] = known[name]
        self.series = np.concatenate([self.series, np.array(added, dtype=SERIES)])
        fresh = _records(POINT, [owners[codes], *(batch[n].to_numpy() for n in POINT.names[1:])])
        self.points = newest_two_per_slot(np.concatenate([self.points, fresh]))
        edges = np.searchsorted(self.points["owner"], np.arange(len(self.names) + 1))
        held = np.flatnonzero(edges[1:] > edges[:-1])
        first, following = self.points["slot"][edges[held]], self.series["next_slot"][held]
        self.series["next_slot"][held] = np.where(following < 0, first, np.minimum(following, np.maximum(first, unserved)))

    def scrape(self, grid: Grid, lookback_us: int, done: int) -> Iterator[tuple]:
        """Serve every series up to the scrape ``done`` and forget what no later scrape can use."""
        owners, *newest = per_slot(self.points)
        edges = np.searchsorted(owners, np.arange(len(self.names) + 1)).tolist()
        series = self.series.tolist()
        for number in np.flatnonzero(self.series["next_slot"] <= done).tolist():
            ttl, slot, stored, stored_ts, expires = series[number]
            entry = None if expires == NO_TIME else (stored, stored_ts, expires)
            own = [column[edges[number]:edges[number + 1]] for column in newest]
            runs, entry = serve(*own, ttl, grid, lookback_us, slot, done, entry)
            self.series[number] = (ttl, done + 1, *(entry or (0.0, 0, NO_TIME)))
            yield from ((*self.names[number], *run) for run in runs)
        reach = grid.start_us + self.series["next_slot"] * grid.step_us
        self.points = self.points[self.points["ts_us"] >= reach[self.points["owner"]] - lookback_us]
        alive = (self.series["expires"] >= reach) & (self.series["next_slot"] <= grid.last_slot)
        alive[self.points["owner"]] = True
        renumbered = np.cumsum(alive) - 1
        self.points["owner"] = renumbered[self.points["owner"]]
        self.names = [name for name, lives in zip(self.names, alive) if lives]
        self.series = self.series[alive]

    def as_state(self) -> tuple:
        names = [list(column) for column in zip(*self.names)]
        return (*names, self.series.tobytes(), self.points.tobytes())


def _scrape_bucket(keys: list[str], grid: Grid, lookback_us: int):
    def scrape(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = _Bucket(keys, state.get if state.exists else None)
        watermark_ms = state.getCurrentWatermarkMs()
        done = min((watermark_ms * 1000 - grid.start_us) // grid.step_us, grid.last_slot)
        for batch in batches:
            if not batch.empty:  # a timeout brings no points
                bucket.add(batch, done + 1)
        runs = list(bucket.scrape(grid, lookback_us, done))
        if runs:
            yield pd.DataFrame(runs, columns=[*keys, *RUN_COLUMNS])
        if not bucket.names or done >= grid.last_slot:
            state.remove()
            return
        state.update(bucket.as_state())
        next_us = grid.start_us + int(bucket.series["next_slot"].min()) * grid.step_us
        state.setTimeoutTimestamp(max(next_us // 1000, watermark_ms + 1))

    return scrape


def replay(
    points: DataFrame, grid: Grid, rules: TtlRules, delay: str, lookback_us: int = LOOKBACK_US, buckets: int = BUCKETS,
) -> DataFrame:
    """As ``operators.replay.replay``, for every scrape the watermark has passed."""
    ship_library(points.sparkSession)
    keys = present(points, SERIES_KEY)
    # In terms of the event time, these filters stay above the watermark: points after the last scrape
    # are not kept, but they do tell that its time has passed.
    time_us = F.unix_micros("event_time")
    slotted = (
        with_event_time(points.filter(valid_point()), delay)
        .filter((time_us >= grid.start_us - lookback_us) & (time_us <= grid.end_us))
        .withColumn("slot", grid.first_slot_at_or_after(time_us))
        .filter(F.col("slot") <= grid.last_slot)
        .withColumn("pattern_ttl_us", pattern_ttl(F.col("metric"), rules))
        .withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    )
    key_schema = ", ".join(f"{k} string" for k in keys)
    runs = slotted.groupBy("bucket").applyInPandasWithState(
        _scrape_bucket(keys, grid, lookback_us), f"{key_schema}, {RUN_SCHEMA}", _state_schema(keys),
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return (
        runs.withColumn("slot", F.explode(F.sequence("from_slot", "to_slot")))
        .withColumn("at_us", grid.time_of(F.col("slot")))
        .select(*keys, "at_us", "value", "ts_us", "from_store")
    )
