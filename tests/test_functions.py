import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens import functions as fn


def test_engines(column):
    raw = ["aurora-postgresql", "postgres", "Postgres", "oracle-se2", "custom-ORACLE-ee", "sqlserver-web", "docdb", "", None]
    want = ["aurora-postgresql", "postgres", "", "oracle", "oracle", "sqlserver", "", "", ""]
    assert column(fn.normalize_engine, raw) == want
    assert column(fn.is_valid_engine, want) == [e != "" for e in want]


def test_engine_short_names(column):
    engines = ["aurora-postgresql", "aurora-mysql", "postgres", "mysql", "mariadb", "oracle", "sqlserver", "db2", "", None]
    assert column(fn.engine_short_name, engines) == ["apg", "ams", "pg", "mysql", "mariadb", "oracle", "sqlserver", "", "", ""]


def test_statistic_is_case_sensitive(column):
    assert column(fn.parse_statistic, ["avg", "AVG", "sum", "p99", ""]) == ["avg", "", "sum", "", ""]


def test_split_metric(column):
    names = ["db.load.avg", "a.b.max.min", ".avg", "avg", "x.p99", "x.avg\n", "x\ny.sum", ""]
    assert column(lambda c: fn.split_metric(c).base, names) == ["db.load", "a.b.max", "", "", "", "", "x\ny", ""]
    assert column(lambda c: fn.split_metric(c).statistic, names) == ["avg", "min", "", "", "", "", "sum", ""]


def test_category_needs_the_dot(column):
    assert column(fn.metric_category, ["os.x", "db.y", "osx", "DB.y", ""]) == ["os", "db", "other", "other", "other"]


def test_sanitize(column):
    assert column(fn.sanitize, ["db.SQL.Q-1", "a b:c", "é.ü", "x__y", ""]) == ["db_sql_q1", "ab:c", "_", "x__y", ""]


@pytest.mark.parametrize(
    "metric, engine, want",
    [
        ("db.load.avg", "aurora-mysql", "dbi_ams_db_load_avg"),
        ("os.cpu.total.avg", "aurora-mysql", "dbi_os_cpu_total_avg"),
        ("db.load.avg", "unknown", "dbi__db_load_avg"),
        ("dbx.load", "postgres", "dbi_dbx_load"),
    ],
)
def test_emitted_name(column, metric, engine, want):
    assert column(lambda c: fn.emitted_name("dbi", F.lit(engine), c), [metric]) == [want]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aé€😀", max_size=12), min_size=1, max_size=8))
def test_truncation_by_bytes_keeps_characters_whole(column, texts):
    def want(text, limit=10):
        if len(text.encode()) <= limit:
            return text
        return text.encode()[:limit].decode(errors="ignore") + "..."

    assert column(lambda c: fn.truncate_label(c, 10, by_bytes=True), texts) == [want(t) for t in texts]
    assert column(lambda c: fn.truncate_label(c, 3), texts) == [t if len(t) <= 3 else t[:3] + "..." for t in texts]


def test_tags_skip_incomplete_and_keep_the_last(spark):
    tags = [("a", "1"), (None, "x"), ("b", None), ("a", "2"), ("c", "")]
    rows = spark.createDataFrame([(tags,), ([],), (None,)], "t array<struct<Key:string,Value:string>>")
    assert [r.m for r in rows.select(fn.tag_map(F.col("t")).alias("m")).collect()] == [{"a": "2", "c": ""}, {}, {}]


def test_dimension_names_and_lookup(column):
    groups = ["db.sql_tokenized", "db.wait_event", "db.user"]
    name = lambda c: fn.dimension_sample_name("p", F.lit("postgres"), c)
    assert column(name, groups) == ["p_pg_top_sql_load_avg", "p_pg_wait_event_load_avg", None]
    assert column(lambda c: fn.dimension_value(c, "k"), [{"k": "v"}, {}, None], "map<string,string>") == ["v", "", ""]


def test_statement_units(column):
    assert column(fn.wait_ms, [1_500_000_000], "bigint") == [1.5]
    assert column(fn.lock_time_ms, [2_000_000_000_000], "bigint") == [2.0]
    assert column(fn.lock_time_ms_true, [2_000_000_000_000], "bigint") == [2000.0]
    assert column(fn.statement_text, ["x" * 201, None]) == ["x" * 200, ""]
    assert column(fn.query_digest, [-(2**63), None], "bigint") == [str(-(2**63)), ""]


def test_thresholds(column):
    rising = ((None, "red"), (95, "yellow"), (99, "green"))
    assert column(lambda c: fn.threshold_colour(c, rising), [94.9, 95.0, 99.0, None, -math.inf], "double") == [
        "red", "yellow", "green", None, "red"]


def test_percent_used_of_nothing_is_null(column):
    assert column(lambda c: fn.percent_used(c, F.lit(0.0)), [1.0], "double") == [None]


def test_prefix(column):
    assert column(fn.is_valid_prefix, ["dbi", "_dbi", "9x", "a:b", "a-b", "", "a\n", None]) == [
        True, False, False, True, False, False, False, False]


def test_numbers_in_exposition_form(column):
    values = [1.0, 0.0, -2.5, 100000.0, 123456.75, 1e6, 1234567.0, -1.5e10, 1e21, 0.001, 0.00015, 1e-4, 1e-5, 2.5e-7, 999999.0]
    want = ["1", "0", "-2.5", "100000", "123456.75", "1e+06", "1.234567e+06", "-1.5e+10", "1e+21", "0.001", "0.00015", "0.0001", "1e-05", "2.5e-07", "999999"]
    assert column(fn.exposition_number, values, "double") == want
    assert column(fn.exposition_number, [math.inf, -math.inf, math.nan, None], "double") == ["+Inf", "-Inf", "NaN", None]


def test_regex_dialect(column):
    patterns = {r"(?P<n>a)b$": [True, False], r"[[:digit:]]": [False, False], r"b\$": [False, False], r"[$]": [False, False]}
    for pattern, want in patterns.items():
        assert column(lambda c: c.rlike(fn.java_regex(pattern)), ["ab", "ab\n"]) == want
