"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from fleetlens.queries import catalog, inputs  # noqa: F401
from fleetlens.queries.registry import QUERIES
from fleetlens.queries.inputs import TABLES
from fleetlens.sources import readers

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    state, _, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert state == "ok"


def test_every_query_has_a_check():
    assert all(registered.sql for registered in QUERIES.values()) and QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    assert {"name", "help", "value", "ts_us"} <= set(entry.entry(spark).columns)


def test_all_instances_are_read(spark):
    got = entry.queries()["src_6"](spark, SF_DIR)
    assert got.select("resource_id").distinct().count() == inputs.fx_pg_statements(spark, SF_DIR).select("resource_id").distinct().count() > 1
    got = entry.queries()["jn_12_rows"](spark, SF_DIR)
    assert got.count() == inputs.fx_instances(spark, SF_DIR).count()


def test_one_system_view_is_named_by_the_caller(spark, tmp_path):
    one = inputs.fx_pg_statements(spark, SF_DIR).filter("resource_id = 'db-1'").drop("resource_id")
    one.write.parquet(str(tmp_path / "view"))
    got = readers.read_pg_statements(spark, str(tmp_path / "view"), region="south", resource_id="db-1")
    assert got.count() == one.count() > 0 and [tuple(r) for r in got.select("region", "resource_id").distinct().collect()] == [("south", "db-1")]
