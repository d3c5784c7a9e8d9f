import random

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.operators import replay as replay_module
from fleetlens.operators.asof import Grid, over_grid, usable_snapshots
from fleetlens.operators.replay import replay, replay_statistics
from fleetlens.streaming import changes, replay as stream_replay

POINTS = "resource_id string, metric string, ts_us bigint, value double, pos bigint"
RULES = ((1, "slow", 90), (2, "zero", 0))


def scrape_by_scrape(rows, grid, rules, lookback):
    """The definition, one scrape after the other over all datapoints."""
    out, stored = [], {}
    for slot in range(grid.last_slot + 1):
        now = grid.start_us + slot * grid.step_us
        for key in sorted({r[:2] for r in rows}):
            entry = stored.get(key)
            if entry and now <= entry[2]:
                out.append((*key, now, entry[0], entry[1], True))
                continue
            seen = sorted((r[2], r[4], r[3]) for r in rows if r[:2] == key and r[3] is not None and now - lookback <= r[2] <= now)
            if not seen:
                continue
            ts, _, value = seen[-1]
            dynamic = max(ts - seen[-2][0], 0) if len(seen) > 1 else 0
            pattern = next((ttl for _, p, ttl in rules if p in key[1]), 0)
            if max(pattern, dynamic) > 0:
                stored[key] = (value, ts, ts + max(pattern, dynamic))
            out.append((*key, now, value, ts, False))
    return sorted(out)


def some_points(seed, n=300, span=1000):
    rng = random.Random(seed)
    keys = [("hot", "slow")] * 3 + [("a", "fast"), ("b", "zero"), ("c", "slow"), ("d", "fast"), ("e", "x")]
    return [(*rng.choice(keys), rng.randrange(span), None if rng.random() < 0.1 else float(rng.randrange(99)), i) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_scrape_by_scrape(spark, seed):
    rows, grid = some_points(seed, n=60 + 80 * seed), Grid(100, 1000, 30)
    frame = spark.createDataFrame(rows, POINTS)
    got = sorted(tuple(r) for r in replay(frame, grid, RULES, lookback_us=70).collect())
    assert got == scrape_by_scrape(rows, grid, RULES, 70)
    stats = replay_statistics(replay(frame, grid, RULES, 70)).collect()
    assert sum(r.served for r in stats) == len(got) and sum(r.hits for r in stats) == sum(r[5] for r in got)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 7))
def test_series_may_span_batches(seed, size):
    grid = Grid(0, 300, 10)
    rng = random.Random(seed)
    rows = []
    for key in ("a", "b", "c"):
        previous = replay_module.NO_TIME
        for slot in sorted(rng.sample(range(31), rng.randrange(1, 12))):
            ts = slot * 10 - rng.randrange(10)
            rows.append((key, slot, float(slot), ts, previous, rng.choice([0, 25])))
            previous = ts
    frame = pd.DataFrame(rows, columns=["k", "slot", "value", "ts_us", "previous_us", "pattern_ttl_us"])
    walk = replay_module._runs_of_partition(["k"], grid, 40)

    def served(batches):
        # a batch may end inside a run: what counts is the scrapes
        runs = pd.concat(list(walk(iter(batches)))).values.tolist()
        return [(key, slot, *rest) for key, begin, end, *rest in runs for slot in range(begin, end + 1)]

    assert served([frame.iloc[i:i + size] for i in range(0, len(frame), size)]) == served([frame])


@pytest.mark.parametrize("files, late", [(1, 0), (4, 0), (4, 5_000_000)])
def test_stream_serves_what_the_batch_serves(spark, tmp_path, files, late):
    rows = sorted(some_points(7, n=200, span=60_000_000), key=lambda r: r[2] + (late if r[4] % 4 == 0 else 0))
    rows = [r for r in rows if r[3] is not None]
    grid, rules = Grid(5_000_000, 60_000_000, 2_000_000), ((1, "slow", 9_000_000),)
    source, size = tmp_path / "in", -(-len(rows) // files)
    for i in range(files):  # in the order of time, one file per micro-batch
        spark.createDataFrame(rows[i * size:(i + 1) * size], POINTS).coalesce(1).write.mode("append").parquet(str(source))
    closing = [tuple(10**9 if k == 2 else v for k, v in enumerate(rows[0]))]  # a point that comes long after all others
    spark.createDataFrame(closing, POINTS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    served = stream_replay.replay(stream, grid, rules, f"{late // 1_000_000} seconds", lookback_us=6_000_000, buckets=3)
    changes.run_to_end(served, str(tmp_path / "out"), "append")
    got = sorted(tuple(r)[:6] for r in changes.read_changes(spark, str(tmp_path / "out"), served.schema).collect())
    assert got == scrape_by_scrape(rows, grid, rules, 6_000_000)


@pytest.mark.parametrize("seed", range(3))
def test_grid_equals_instant_selection_at_each_step(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(-200, 1000), float(rng.randrange(9))) for _ in range(300)]
    grid = Grid(0, 900, 25)
    frame = spark.createDataFrame(rows, "k string, ts_us bigint, value double")
    got = sorted(((r.k or "", r.at_us, r.value, r.ts_us) for r in over_grid(frame, ["k"], grid, 60, ("ts_us", "value")).collect()))
    same_time = frame.groupBy("k", "ts_us").agg(F.max("value").alias("value"))
    assert sorted((r.k or "", r.at_us, r.value, r.ts_us) for r in over_grid(same_time, ["k"], grid, 60).collect()) == got
    want = []
    for at in range(0, 901, 25):
        for key in {r[0] for r in rows}:
            seen = [(r[1], r[2]) for r in rows if r[0] == key and at - 60 < r[1] <= at]
            if seen:
                want.append((key or "", at, max(seen)[1], max(seen)[0]))
    assert got == sorted(want)


def test_snapshots(spark):
    rows = spark.createDataFrame([("r", 0), ("r", 95), ("s", 250)], "region string, fetched_at_us bigint")
    got = sorted(tuple(r) for r in usable_snapshots(rows, ["region"], Grid(0, 300, 100), 100).select("region", "at_us", "fetched_at_us", "is_stale").collect())
    assert got == [("r", 0, 0, False), ("r", 100, 95, False), ("r", 200, 95, True), ("r", 300, 95, True), ("s", 300, 250, False)]


def test_a_bucket_goes_through_its_state_as_bytes_and_is_cut_once_for_all_series(monkeypatch):
    import numpy as np
    import pandas as pd

    from fleetlens.streaming import replay as streamed

    rng, grid = np.random.default_rng(4), Grid(0, 1_200_000_000, 60_000_000)
    ts, series = rng.integers(0, 1_190_000_000, 3000), rng.integers(0, 200, 3000)
    rows = pd.DataFrame({
        "resource_id": [f"r{k}" if k else None for k in series], "metric": "m", "slot": -(-ts // 60_000_000), "ts_us": ts, "pos": np.arange(3000),
        "value": rng.random(3000), "pattern_ttl_us": np.array([0, 30_000_000, 200_000_000])[series % 3],
    })
    cuts = []
    cut = streamed.per_slot
    monkeypatch.setattr(streamed, "per_slot", lambda points: cuts.append(len(points)) or cut(points))
    got, state = [], None
    for before, done in ((-1, 4), (4, 9), (9, 9), (9, 20)):
        bucket = streamed._Bucket(["resource_id", "metric"], state)
        part = rows[(rows["slot"] > before) & (rows["slot"] <= done)]
        if len(part):
            bucket.add(part, before + 1)
        got += list(bucket.scrape(grid, 180_000_000, done))
        state = bucket.as_state()
    assert len(cuts) == 4 and [type(column) for column in state] == [list, list, bytes, bytes]
    # One walk per series over all points in the order of time.
    want = []
    for name, own in rows.sort_values(["ts_us", "pos"]).groupby("resource_id", dropna=False):
        newest = own.assign(previous=own["ts_us"].shift(fill_value=streamed.NO_TIME)).groupby("slot").last()
        columns = (newest.index.tolist(), newest["value"].tolist(), newest["ts_us"].tolist(), newest["previous"].tolist())
        want += [(name, *run) for run in streamed.serve(*columns, int(own["pattern_ttl_us"].iloc[0]), grid, 180_000_000, columns[0][0], 20)[0]]

    def scrapes(runs):
        return sorted((name if isinstance(name, str) else "", slot, *rest) for name, *_, first, last, value, at, stored in runs for slot in range(first, last + 1) for rest in [(value, at, stored)])

    assert scrapes(got) == scrapes(want)
