import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import freshness, ranking
from fleetlens.operators.latest import latest_n, latest_valid, latest_with_interval
from fleetlens.plans.statements import top_per_instance

POINTS = "resource_id string, metric string, ts_us bigint, value double, pos bigint"


def points(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def test_newest_valid_point_skips_nulls_and_settles_ties(spark):
    rows = [("a", "m", 10, 1.0, 0), ("a", "m", 20, 2.0, 1), ("a", "m", 20, 3.0, 2), ("a", "m", 30, None, 3), ("a", "m", None, 9.0, 4), ("b", "m", 5, None, 0)]
    assert [tuple(r) for r in latest_valid(points(spark, rows)).collect()] == [("a", "m", 3.0, 20)]


def test_without_positions_the_aggregate_needs_no_sort(spark):
    rows = points(spark, [("a", "m", 10, 1.0, 0), ("a", "m", 20, 2.0, 1), ("a", "m", 30, None, 2)]).drop("pos")
    newest = latest_valid(rows)
    assert [tuple(r) for r in newest.collect()] == [("a", "m", 2.0, 20)]
    assert "SortAggregate" not in newest._jdf.queryExecution().executedPlan().toString()
    assert latest_with_interval(rows).first().dynamic_ttl_us == 10


def test_latest_n(spark):
    rows = points(spark, [("a", "m", t, float(t), t) for t in (3, 1, 2)])
    assert [(r.rn, r.value) for r in latest_n(rows, 2).orderBy("rn").collect()] == [(1, 3.0), (2, 2.0)]
    assert latest_n(rows, 0).count() == 0 and latest_n(rows, -1).count() == 0 and latest_n(rows, 9).count() == 3


@pytest.mark.parametrize("times, want", [([10, 25], 15), ([10], 0), ([10, 10], 0), ([1, 5, 12], 7)])
def test_dynamic_ttl(spark, times, want):
    rows = points(spark, [("a", "m", t, 1.0, i) for i, t in enumerate(times)])
    assert latest_with_interval(rows).first().dynamic_ttl_us == want


STATE = "resource_id string, metric string, expires_at_us bigint"


def state(spark, n=400, seed=1):
    rng = random.Random(seed)
    # a third of the entries expires at one moment
    return spark.createDataFrame(
        [(f"db-{i}", "m", 5_000_000 if i % 3 == 0 else rng.randrange(0, 9_000_000)) for i in range(n)], STATE)


@pytest.mark.parametrize("k", [0, 1, 50, 140, 250, 401, 1000])
def test_top_k_equals_a_sort(spark, k):
    rows = state(spark).unionByName(spark.createDataFrame([("none", "m", None)], STATE))

    def order(r):  # rows without a time come last, ties by the md5 of the key
        return r.expires_at_us is None, r.expires_at_us or 0, hashlib.md5(f"{r.resource_id}\x01{r.metric}".encode()).hexdigest()

    want = sorted(rows.collect(), key=order)[:k]
    got = ranking.earliest_k(rows, "expires_at_us", ["resource_id", "metric"], k).collect()
    assert len(got) == min(k, 401) and set(got) == set(want)


def test_expiry_is_strict(spark):
    rows = spark.createDataFrame([("a", "m", 99), ("b", "m", 100), ("c", "m", 101)], STATE)
    assert {r.resource_id for r in freshness.fresh_only(rows, 100).collect()} == {"b", "c"}
    assert {r.resource_id: r.expired for r in freshness.peek(rows, 100).collect()} == {"a": True, "b": False, "c": False}


def test_eviction_order_and_retention(spark):
    rows = spark.createDataFrame([(f"db-{i}", "m", i) for i in range(10)], STATE)
    keys = ["resource_id", "metric"]
    assert sorted(r.expires_at_us for r in freshness.evicted(rows, keys, 6, 3).collect()) == [0, 1, 2]
    assert sorted(r.expires_at_us for r in freshness.retained(rows, keys, 6, 2).collect()) == [8, 9]
    assert sorted(r.expires_at_us for r in freshness.retained(rows, keys, 6, 99).collect()) == [6, 7, 8, 9]


def test_upsert_replaces_by_arrival(spark):
    schema = "resource_id string, metric string, arrival_seq bigint, value double"
    old = spark.createDataFrame([("a", "m", 1, 1.0), ("b", "m", 2, 2.0)], schema)
    new = spark.createDataFrame([("a", "m", 5, 5.0), ("c", "m", 6, 6.0)], schema)
    got = {r.resource_id: r.value for r in freshness.upsert(old, new, ["resource_id", "metric"]).collect()}
    assert got == {"a": 5.0, "b": 2.0, "c": 6.0}


def test_statements_first_list_wins(spark):
    schema = ("resource_id string, family string, digest string, digest_text string, calls bigint, avg_duration_ms double, "
              "sum_lock_time_ms double, rows_examined bigint, rows_sent bigint, errors bigint")
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"db-{i % 5}", "mysql", f"q{i % 60}", f"t{i}", rng.randrange(50), float(rng.randrange(50)), 0.0, 1, 1, 0) for i in range(600)]
    got = {(r.resource_id, r.digest): (r.rank_source, r.rank) for r in top_per_instance(spark.createDataFrame(rows, schema), 4).collect()}
    want = {}
    for instance in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == instance]
        for source, key in (("duration", 5), ("calls", 4)):
            for rank, r in enumerate(sorted(own, key=lambda r: (-r[key], r[2], r[3]))[:4], 1):
                want.setdefault((instance, r[2]), (source, rank))
    assert got == want
