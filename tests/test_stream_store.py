"""The store on a stream: evictions against a walk over all points in the order of time."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from fleetlens.streaming import store

SCHEMA = "resource_id string, metric string, ts_us long, pos long, value double"
RULES = [(1, "^a", 60_000_000), (2, "^b", 300_000_000), (3, "^n", 0), (4, ".", 7_000_000)]
TTL = {"a": 60_000_000, "b": 300_000_000, "c": 7_000_000}
END = 10**9 * 3600


def points(rng, n, step):
    return [(f"r{rng.randrange(4)}", rng.choice("abcn") + str(rng.randrange(3)), 10**15 + rng.randrange(n * step) // 10**6 * 10**6, k, float(k)) for k in range(n)]


def plain(rows, shard_of, max_size):
    """Sorted lists instead of a heap: (evictions, entries left)."""
    out, stores = [], {}
    for r, m, ts, pos, value in sorted(rows, key=lambda p: (p[2], p[3])):
        if m[0] == "n":
            continue
        held = stores.setdefault(shard_of[r, m], {})
        for key in [k for k, e in held.items() if e[2] < ts]:
            out.append((*key, *held.pop(key), "expired"))
        if (r, m) not in held and len(held) >= max_size:
            key = min(held, key=lambda k: (held[k][2], store.tie_break(k)))
            out.append((*key, *held.pop(key), "displaced"))
        held[r, m] = (value, ts, ts + TTL[m[0]])
    out += [(*key, *e, "expired") for held in stores.values() for key, e in held.items()]
    return sorted(out)


@pytest.mark.parametrize(("max_size", "shards", "files"), [(3, 2, 4), (1000, 3, 5)])
def test_evictions_and_state(spark, tmp_path, max_size, shards, files):
    rng = random.Random(max_size)
    rows = points(rng, 400, 3_000_000)
    frame = spark.createDataFrame(rows, SCHEMA)
    shard_of = {(r.resource_id, r.metric): r.s for r in frame.selectExpr("resource_id", "metric", f"pmod(xxhash64(resource_id, metric), {shards}) AS s").distinct().collect()}
    # A quarter of the points comes a file late; the last file drives the watermark past all expiries.
    part = {p[3]: min(files - 1, (p[2] - 10**15) * files // (400 * 3_000_000) + (rng.random() < 0.25)) for p in rows}
    for k in range(files):
        spark.createDataFrame([p for p in rows if part[p[3]] == k], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("r0", "n0", 10**15 + END, 10**6, 0.0), ("r0", "c9", 10**15 + END, 10**6, 0.0)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with store.state_with_timers(spark):
        query = (
            store.evictions(stream, RULES, "20 minutes", max_size, shards).writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    out = spark.read.schema(store.EVICTION).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.resource_id, r.metric, r.value, r.ts_us, r.expires_at_us, r.reason) for r in out) == plain(rows, shard_of, max_size)
    assert max_size > 3 or any(r.reason == "displaced" for r in out)
    # Of all that was held, the closing point alone still waits.
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 4


def test_equal_expiries_go_in_the_order_of_the_hash():
    entries = {}
    rows = [(0, k, (f"r{k}", "m"), 1.0, 50) for k in range(6)] + [(10, 9, ("x", "m"), 2.0, 99)]
    out = store.applied(entries, rows, 40, 6)
    first = min([(f"r{k}", "m") for k in range(6)], key=store.tie_break)
    assert [(o[:2], o[5]) for o in out] == [(first, "displaced")]
    assert [o[5] for o in store.applied(entries, [], 60, 6)] == ["expired"] * 5 and list(entries) == [("x", "m")]


class _Handle:
    """The state of one shard in memory, with what is read of it counted."""

    def __init__(self):
        self.timers, self.lists, self.read = set(), {}, 0

    def getListState(self, name, schema):
        rows = self.lists.setdefault(name, [])

        def get():
            self.read += len(rows)
            return iter(list(rows))

        return SimpleNamespace(get=get, appendList=rows.extend, clear=rows.clear, put=lambda new: rows.__setitem__(slice(None), new))

    def listTimers(self):
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_a_shard_has_one_timer_and_reads_its_state_once_a_watermark():
    handle, shard = _Handle(), store._Store(1 << 30)
    shard.init(handle)
    rng, out, watermark = random.Random(5), [], 0
    rows = [(f"r{rng.randrange(9000)}", "b0", rng.randrange(10**9), k, float(k), 0) for k in range(25_000)]
    rows = sorted(((r, m, ts, pos, v, ts + rng.randrange(1, 3 * 10**8)) for r, m, ts, pos, v, _ in rows), key=lambda p: p[2])
    for number in range(6):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        part = rows[number * 5000 : (number + 1) * 5000]
        if part:
            shard.handleInputRows(None, iter([pd.DataFrame(part, columns=list(store.WAITING))]), now)
        assert len(handle.timers) == 1
        before = handle.read
        for at in [t for t in handle.listTimers() if t <= watermark]:
            out += [r for frame in shard.handleExpiredTimer(None, now, None) for r in frame.itertuples(index=False, name=None)]
            handle.deleteTimer(at)
        assert handle.read - before <= 8  # blocks, not points, and all of them once
        watermark = part[-1][2] // 1000 if part else watermark
        watermark = 10**7 if number >= 4 else watermark
    entries: dict = {}
    want = store.applied(entries, [(ts, pos, (r, m), v, e) for r, m, ts, pos, v, e in rows], 10**10, 1 << 30)
    assert sorted(o[:6] for o in out) == sorted(o[:6] for o in want) and not entries and not handle.timers
    assert not handle.lists["entries"] and not handle.lists["waiting"]
