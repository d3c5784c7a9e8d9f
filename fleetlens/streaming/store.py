"""The store of fresh values on a stream: a bounded map with expiry, whose evictions are the output.

The store is dealt over shards by a hash of the series, so that a busy instance spreads over all of them; each shard holds at
most ``max_size`` series. Points wait in the state until the watermark has passed them and are then applied in the
order of their time, so what is evicted does not depend on how the stream is cut into files. One timer a shard wakes it when the
watermark passes the first time it waits for, a point's or an entry's expiry; all that is due by then is done in this one call. Points
and entries lie in the state as blocks of columns, so a call reads and writes them once, by the block.

An entry leaves the store

* ``expired``: the watermark, or a later point, has passed its expiry (strictly), and nothing replaced it before;
* ``displaced``: a new series found the shard full of fresh entries, and this one had the earliest expiry.

A newer point of the series replaces an entry without a trace. Points whose TTL is zero are not kept. Points later than the watermark
when they arrive are applied at once, in their order, and can only replace what is still there.
"""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.freshness import expires_at
from fleetlens.operators.predicates import valid_point
from fleetlens.operators.rules import TtlRules, pattern_ttl
from fleetlens.session import ship_library
from fleetlens.streaming.aggregates import with_event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHARDS = 4096
KEY = "resource_id string, metric string"
BLOCK = 10_000
WAITING = ("resource_id", "metric", "ts_us", "pos", "value", "expires_at_us")
ENTRY = ("resource_id", "metric", "value", "ts_us", "expires_at_us")
TYPES = {"resource_id": "string", "metric": "string", "ts_us": "long", "pos": "long", "value": "double", "expires_at_us": "long"}
EVICTION = f"{KEY}, value double, ts_us long, expires_at_us long, reason string, at_us long"


@contextlib.contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store that has timers; the session is left as it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def tie_break(series: tuple) -> str:
    """As batch eviction: the md5 of the key settles equal expiries."""
    import hashlib

    return hashlib.md5("\u0001".join(k for k in series if k is not None).encode("utf-8")).hexdigest()


def applied(entries: dict, points: list, upto_us: int, max_size: int) -> list[tuple]:
    """Apply points in the order of time to ``entries`` (series: value, ts, expiry) and expire up to ``upto_us``; the evictions."""
    out: list[tuple] = []
    heap = [(e[2], tie_break(s), s) for s, e in entries.items()]
    heapq.heapify(heap)

    def current() -> bool:
        """Whether the top of the heap is an entry as it stands; others have been replaced."""
        expiry, _, series = heap[0]
        return series in entries and entries[series][2] == expiry

    def expire(now: int) -> None:
        while heap and (heap[0][0] < now or not current()):
            if current():
                out.append((*heap[0][2], *entries.pop(heap[0][2]), "expired", now))
            heapq.heappop(heap)

    for ts, pos, series, value, expiry in sorted(points, key=lambda p: (p[0], p[1] is None, p[1] or 0)):
        expire(ts)
        if series in entries and entries[series][1] > ts:
            continue
        if series not in entries and len(entries) >= max_size:
            while not current():
                heapq.heappop(heap)
            first = heapq.heappop(heap)[2]
            out.append((*first, *entries.pop(first), "displaced", ts))
        entries[series] = (value, ts, expiry)
        heapq.heappush(heap, (expiry, tie_break(series), series))
    expire(upto_us)
    return out


def _block_schema(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} array<{TYPES[n]}>" for n in names)


def _blocks(rows: list[tuple]) -> list[tuple]:
    """Rows as blocks of columns."""
    return [tuple(list(column) for column in zip(*rows[i : i + BLOCK])) for i in range(0, len(rows), BLOCK)]


def _rows(blocks: Iterator[tuple]) -> Iterator[tuple]:
    for block in blocks:
        yield from zip(*block)


class _Store(StatefulProcessor):
    def __init__(self, max_size: int) -> None:
        self.max_size = max_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", _block_schema(ENTRY))
        self.waiting = handle.getListState("waiting", _block_schema(WAITING))

    def _wake(self, us: int, watermark_ms: int) -> None:
        """Once the watermark is behind the time; never at once, as that timer would not fire any more."""
        at = max(us // 1000 + 1, watermark_ms + 1)
        ahead = [t for t in self.handle.listTimers() if t > watermark_ms]
        if any(t <= at for t in ahead):
            return
        for later in ahead:
            self.handle.deleteTimer(later)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, watermark = None, timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            plain = frame[list(WAITING)].astype(object)
            self.waiting.appendList(_blocks(list(plain.where(plain.notna(), None).itertuples(index=False, name=None))))
            low = int(frame["ts_us"].min())
            first = low if first is None else min(first, low)
        # A timer that the watermark has passed fires in this batch, after the input, and sets the next one.
        if first is not None and all(t > watermark for t in self.handle.listTimers()):
            self._wake(first, watermark)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        upto = watermark * 1000
        due, later = [], []
        for r in _rows(self.waiting.get()):
            (due if r[2] <= upto else later).append(r)
        entries = {(resource, metric): (value, ts, expiry) for resource, metric, value, ts, expiry in _rows(self.entries.get())}
        points = [(ts, pos, (resource, metric), value, expiry) for resource, metric, ts, pos, value, expiry in due]
        evicted = applied(entries, points, upto, self.max_size)
        for state, names, rows in ((self.waiting, WAITING, later), (self.entries, ENTRY, [(*series, *entry) for series, entry in entries.items()])):
            state.clear()
            if rows:
                state.put(_blocks(rows))
        awaited = [r[2] for r in later] + [entry[2] for entry in entries.values()]
        if awaited:
            self._wake(min(awaited), watermark)
        if evicted:
            yield pd.DataFrame(evicted, columns=["resource_id", "metric", "value", "ts_us", "expires_at_us", "reason", "at_us"])

    def close(self) -> None:
        pass


def evictions(points: DataFrame, rules: TtlRules, delay: str, max_size: int = 1 << 30, shards: int = SHARDS) -> DataFrame:
    """What leaves the store, in append mode; start the query inside ``state_with_timers``."""
    ship_library(points.sparkSession)
    ttl = pattern_ttl(F.col("metric"), rules)
    kept = (
        with_event_time(points.filter(valid_point()), delay).filter(ttl > 0).withColumn("expires_at_us", expires_at(F.col("ts_us"), ttl))
        .select("resource_id", "metric", "ts_us", "pos", "value", "expires_at_us", "event_time", F.pmod(F.xxhash64("resource_id", "metric"), F.lit(shards)).alias("shard"))
    )
    return kept.groupBy("shard").transformWithStateInPandas(_Store(max_size), EVICTION, "Append", "EventTime")
