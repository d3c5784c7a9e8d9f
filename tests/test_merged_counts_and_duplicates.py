"""Counts that merge, subtotals, responses cut where they lie, points that arrive twice."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import vector
from fleetlens.operators.latest import latest_n, newest_in_responses
from fleetlens.schemas import RAW_DATAPOINTS
from fleetlens.sources import readers
from fleetlens.streaming import changes, duplicates

MINUTE = 60_000_000


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_merged_sketches_are_close_to_exact_counts(spark, tmp_path):
    """Ten ranges, up to 60,000 values each; the ranges read the stored sketches alone."""
    rows = spark.range(400_000).select(
        F.lit("m").alias("name"), (F.col("id") % 20 * MINUTE + 5).alias("ts_us"), F.concat(F.lit("db-"), F.xxhash64("id") % 61_000).alias("identifier"))
    vector.distinct_sketches(rows, "identifier", MINUTE).write.parquet(str(tmp_path / "sketches"))
    sketches = spark.read.parquet(str(tmp_path / "sketches"))
    for begin in range(10):
        since, until = begin * MINUTE, (2 * begin + 1) * MINUTE
        exact = rows.where((F.col("ts_us") >= since) & (F.col("ts_us") < until)).agg(F.count_distinct("identifier")).first()[0]
        merged = vector.distinct_from_sketches(sketches, since, until)
        assert abs(merged.first().value / exact - 1) < 0.03
        assert "sketches" in executed(merged) and "Range" not in executed(merged)


def test_sketches_of_few_null_or_no_values(spark):
    rows = spark.createDataFrame([("m", 1, "a"), ("m", 2, "a"), ("m", 3, None), ("n", 1, None), ("m", MINUTE, "b")], "name string, ts_us long, identifier string")
    sketches = vector.distinct_sketches(rows, "identifier", MINUTE)
    assert sorted((r.name, r.period_us) for r in sketches.collect()) == [("m", 0), ("m", MINUTE)]
    assert [tuple(r) for r in vector.distinct_from_sketches(sketches, 0, 2 * MINUTE).collect()] == [("m", 2)]
    assert vector.distinct_from_sketches(sketches, 0, 0).count() == 0


def test_subtotals_equal_separate_reports(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["eu", "us", None]), rng.choice(["c1", "c2", ""]), rng.choice("abcd"), rng.choice([1.0, 2.5, None])) for _ in range(200)]
    samples = spark.createDataFrame(rows, "region string, cluster string, identifier string, value double")
    levels = {"region": "region", "cluster": "cluster", "identifier": "instance"}
    report = vector.subtotals(samples, levels)
    got = {(r.level, r.region, r.cluster, r.identifier): (r["sum"], r.n) for r in report.collect()}
    want = {}
    for depth, level in enumerate(["total", "region", "cluster", "instance"]):
        for key in {row[:depth] for row in rows}:
            values = [row[3] for row in rows if row[:depth] == key and row[3] is not None]
            if values:
                want[(level, *key, *[None] * (3 - depth))] = (sum(values), len(values))
    assert got == want and report.count() == len(want)
    assert executed(vector.subtotals(samples, levels)).count("Scan") == 1 and vector.subtotals(samples.limit(0), levels).count() == 0


def test_newest_in_responses_needs_no_generate_and_no_exchange(spark, tmp_path):
    rng = random.Random(5)
    stamp = "2024-01-01T00:00:{:02d}Z"
    records = []
    for number in range(60):
        listed = [{"Timestamp": rng.choice([None, *map(stamp.format, range(12))]), "Value": rng.choice([None, 1.0, 2.0, 3.0])} for _ in range(rng.randrange(9))]
        records.append({"resource_id": f"r{number}", "Key": {"Metric": "m"}, "DataPoints": None if number == 7 else listed})
    spark.createDataFrame([(json.dumps(r),) for r in records], "value string").coalesce(2).write.text(str(tmp_path / "raw"))
    raw = spark.read.schema(RAW_DATAPOINTS).json(str(tmp_path / "raw"))
    cut = newest_in_responses(raw, 3)
    assert cut.schema["DataPoints"].dataType.simpleString() == raw.schema["DataPoints"].dataType.simpleString()
    plan = executed(cut)
    assert "Generate" not in plan and "Exchange" not in plan and "Python" not in plan

    def newest(rows):
        return sorted((r.resource_id, r.ts_us, r.value, r.rn) for r in latest_n(readers.flatten_datapoints(rows), 3).collect())

    # Positions count in a list, newest first after the cut: turned around they settle ties as before.
    turned = cut.withColumn("DataPoints", F.reverse("DataPoints"))
    assert newest(turned) == newest(raw) and len(newest(raw)) > 100
    assert all(r.DataPoints is None if r.resource_id == "r7" else len(r.DataPoints) <= 3 for r in cut.collect())
    assert {len(r.DataPoints) for r in newest_in_responses(raw, -1).collect() if r.DataPoints is not None} == {0}


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_over_several_batches_are_found_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    batches = [[(f"r{rng.randrange(6)}", "m", (86_400 + 60 * b + rng.randrange(40)) * 1_000_000) for _ in range(80)] for b in range(3)]
    batches[1] += batches[0][:20]  # copies that come a batch later
    batches.append([("last", "m", 10**12)])
    schema = "resource_id string, metric string, ts_us bigint"
    points = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    once, again = duplicates.unique(points, "10 minutes"), duplicates.repeated(points, "10 minutes")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / str(number)))
        changes.run_to_end(once, str(tmp_path / "once"), "append")
        changes.run_to_end(again, str(tmp_path / "again"), "append")
    count = Counter(row for rows in batches for row in rows)
    kept = [tuple(r)[:3] for r in changes.read_changes(spark, str(tmp_path / "once"), once.schema).collect()]
    assert sorted(kept) == sorted(count)
    dropped = [tuple(r)[:4] for r in changes.read_changes(spark, str(tmp_path / "again"), again.schema).collect()]
    assert sorted(dropped) == sorted((*key, n) for key, n in count.items() if n > 1)


def test_state_of_copies_goes_with_the_watermark(spark, tmp_path):
    schema = "resource_id string, metric string, ts_us bigint"
    points = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    held = []
    for number, second in enumerate((90_000, 100_000, 110_000)):
        spark.createDataFrame([(f"r{i}", "m", second * 1_000_000) for i in range(50)], schema).write.parquet(str(tmp_path / "in" / str(number)))
        query = duplicates.unique(points, "10 minutes").writeStream.outputMode("append").foreachBatch(lambda rows, _: rows.write.format("noop").mode("overwrite").save())
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held == [50, 50, 50]
