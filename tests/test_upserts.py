"""The table of latest rows: only touched buckets are rewritten, and a batch run again changes nothing."""

import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from fleetlens.streaming import changes
from fleetlens.streaming.upserts import LatestTable

SCHEMA = T.StructType().add("resource_id", "string").add("metric", "string").add("arrival_seq", "long").add("value", "double")
KEYS = ["resource_id", "metric"]


def rows_of(rng, n, start, series):
    return [(f"r{rng.randrange(series)}", rng.choice("ab"), start + k, rng.random()) for k in range(n)]


def latest(rows):
    return sorted({(r[0], r[1]): r for r in sorted(rows, key=lambda r: r[2])}.values())


def held(table):
    return sorted(tuple(r) for r in table.read().collect())


def files(path):
    return {str(p) for p in Path(path).rglob("data/**/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return LatestTable(spark, str(tmp_path / "table"), SCHEMA, KEYS, buckets=8)


def test_batches_fold_in(spark, table):
    rng, every = random.Random(4), []
    for batch in range(4):
        rows = rows_of(rng, 60, batch * 100, 30)
        rng.shuffle(rows)
        every += rows
        table.write(spark.createDataFrame(rows, SCHEMA), batch)
        assert held(table) == latest(every)


def test_untouched_files_stay_and_late_rows_do_not_win(spark, table):
    rows = rows_of(random.Random(5), 200, 100, 60)
    table.write(spark.createDataFrame(rows, SCHEMA), 0)
    before, manifest = files(table.path), table.manifest()
    one = ("r1", "a", 5000, 1.5)
    table.write(spark.createDataFrame([one, ("r1", "a", 1, 9.0)], SCHEMA), 1)
    assert held(table) == latest([*rows, one]) and before <= files(table.path)
    changed = {k for k, b in table.manifest().items() if manifest.get(k) != b}
    assert len(changed) == 1 and len(files(table.path) - before) == 1


def test_a_batch_run_again(spark, table, tmp_path):
    first, second = spark.createDataFrame(rows_of(random.Random(6), 50, 0, 20), SCHEMA), spark.createDataFrame(rows_of(random.Random(7), 50, 100, 20), SCHEMA)
    table.write(first, 0)
    table.write(second, 1)
    want, there = held(table), files(table.path)
    table.write(second, 1)
    assert held(table) == want and files(table.path) == there
    # Stopped before its manifest was whole: what it wrote does not count, and its rerun replaces it.
    Path(table.path, "manifests", "batch=1", "_SUCCESS").unlink()
    assert held(table) == latest([tuple(r) for r in first.collect()])
    table.write(second, 1)
    assert held(table) == want


def test_old_versions_go_and_nothing_is_a_batch_too(spark, table):
    frame = spark.createDataFrame([("r", "a", 1, 1.0)], SCHEMA)
    assert held(table) == []
    table.write(frame.limit(0), 0)
    for batch in range(1, 6):
        table.write(frame.selectExpr("resource_id", "metric", f"{batch}L AS arrival_seq", "value"), batch)
    assert len(files(table.path)) == 2 and held(table) == [("r", "a", 5, 1.0)]


def test_as_a_sink(spark, table, tmp_path):
    rows = rows_of(random.Random(8), 300, 0, 40)
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.run_batches(stream, str(tmp_path / "query"), table.write)
    assert held(table) == latest(rows) and len(table._batches()) == 2
