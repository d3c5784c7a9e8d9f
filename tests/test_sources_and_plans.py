import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import Observation, functions as F, types as T

from fleetlens.functions.display import is_valid_prefix
from fleetlens.operators import lookups, quality, vector
from fleetlens.operators.asof import Grid, instant, over_grid, snapshot_at
from fleetlens.plans import catalogue as cat, collection, dashboards, dimensions, inventory
from fleetlens.plans.catalogue import build_catalogue
from fleetlens.plans.dimensions import top_load_by_dimension
from fleetlens.plans.scrape import union_families
from fleetlens.plans.statements import checked_top_n
from fleetlens import schemas
from fleetlens.schemas import COUNTER_LABELS, PG_STATEMENTS
from fleetlens.session import scratch_dir
from fleetlens.sources import readers, writers
from fleetlens.streaming import snapshots

NOW = 1_700_000_000_000_000
SECOND = 1_000_000


def dump(path, records):
    path.mkdir()
    (path / "part.json").write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


def stamp(us):
    return datetime.fromtimestamp(us / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def instance(name, engine="postgres", created=NOW, **more):
    record = {
        "DBInstanceIdentifier": name, "DbiResourceId": f"db-{name}", "Engine": engine, "DBInstanceStatus": "available",
        "InstanceCreateTime": stamp(created), "PerformanceInsightsEnabled": True, "Endpoint": {"Address": f"{name}.x", "Port": 5432},
        "TagList": [{"Key": "Team", "Value": "a"}, {"Key": "Team", "Value": "b"}, {"Key": None, "Value": "c"}],
    }
    return {**record, **more}


def test_inventory_from_json(spark, tmp_path):
    records = [
        instance("new", created=NOW), instance("old", created=NOW - SECOND), instance("older", "SQLServer-ee", created=NOW - 2 * SECOND),
        instance("off", PerformanceInsightsEnabled=None), instance("odd", "docdb"), instance("nostatus", DBInstanceStatus=None),
        instance("noengine", None), instance("", DbiResourceId="db-empty"), instance("bare", Endpoint=None, TagList=None),
        instance("nodate", InstanceCreateTime=None), instance("noid", DbiResourceId=None, Engine=None),
    ]
    flat = readers.read_instances(spark, dump(tmp_path / "i", records), region="eu")
    kept = inventory.discover_instances(flat, max_instances=2)
    assert [(r.identifier, r.engine, r.region) for r in kept.orderBy("creation_us").collect()] == [
        ("older", "sqlserver", "eu"), ("old", "postgres", "eu")]
    bare = flat.filter("identifier = 'bare'").first()
    assert (bare.endpoint, bare.port, bare.cluster_identifier, bare.tags) == ("", 0, "", {})
    assert flat.filter("identifier = 'new'").first().tags == {"Team": "b"}
    reasons = {r.identifier: r.reason for r in inventory.instance_rejects(flat, {"identifier": ["^o|^n|^b"]}, {"tag.Team": ["zz"]}).collect()}
    assert reasons == {
        "off": "insights_disabled", "odd": "unknown_engine", "nostatus": "missing_status", "noengine": "missing_engine",
        "": "empty_identity", "nodate": "missing_creation_time", "noid": "missing_engine"}
    assert [tuple(r) for r in inventory.statistics_of_discovery(flat, None, None, 2).collect()] == [("eu", 4, 2)]


def test_uncapped_inventory_and_regions_are_ranked_apart(spark, tmp_path):
    one = readers.read_instances(spark, dump(tmp_path / "a", [instance("a1"), instance("a2", created=NOW - 1)]), region="a")
    two = readers.read_instances(spark, dump(tmp_path / "b", [instance("b1"), instance("b2", created=NOW - 1)]), region="b")
    both = one.unionByName(two)
    assert {r.identifier for r in inventory.discover_instances(both, max_instances=1).collect()} == {"a2", "b2"}
    assert inventory.discover_instances(both, max_instances=None).count() == 4


@pytest.fixture
def fleet(spark, tmp_path):
    records = [instance("pg1", created=NOW - 9), instance("pg2", created=NOW - 8), instance("my1", "mysql", created=NOW - 7)]
    return inventory.discover_instances(readers.read_instances(spark, dump(tmp_path / "fleet", records), region="eu"))


def metrics(*rows):
    return [{"Metric": m, "Description": d, "Unit": u} for m, d, u in rows]


def test_catalogue(spark, tmp_path, fleet):
    raw = readers.read_catalogue(spark, dump(tmp_path / "c", [
        {"resource_id": "db-pg1", "Metrics": metrics(("db.Q", "first", "N"), ("os.m", "M", "KB"), ("os.m", "again", "MB"), ("os.null", None, "x"))},
        {"resource_id": "db-pg2", "Metrics": metrics(("DB.q", "other", "N"), ("net.x", "n", "x"))},
        {"resource_id": "db-my1", "Metrics": []},
        {"resource_id": "db-gone", "Metrics": metrics(("db.Q", "gone", "N"))},
    ]))
    rows = {(r.resource_id, r.metric): r for r in cat.build_catalogue(raw, fleet).collect()}
    assert set(rows) == {("db-pg1", "db.load"), ("db-pg1", "db.Q"), ("db-pg1", "os.m"), ("db-pg2", "db.load"), ("db-pg2", "DB.q")}
    assert rows["db-pg2", "DB.q"].description == "first"  # canonical per engine, whatever the spelling
    assert (rows["db-pg1", "os.m"].unit, rows["db-pg1", "os.m"].description) == ("MB", "M")  # last unit, first description
    assert rows["db-pg1", "db.load"].unit == "Average Active Sessions"
    assert [r.identifier for r in cat.empty_catalogues(raw, fleet).collect()] == ["my1"]


def test_a_listed_load_metric_overrides_the_unit_only(spark, tmp_path, fleet):
    raw = readers.read_catalogue(spark, dump(tmp_path / "c", [{"resource_id": "db-pg1", "Metrics": metrics(("db.load", "real", "AAS"))}]))
    row = cat.build_catalogue(raw, fleet).first()
    assert row.unit == "AAS" and row.description.startswith("Database load")


def test_excluded_rows_do_not_seed_descriptions(spark, tmp_path, fleet):
    raw = readers.read_catalogue(spark, dump(tmp_path / "c", [
        {"resource_id": "db-pg1", "Metrics": metrics(("os.idle", "first", "N"))}, {"resource_id": "db-pg2", "Metrics": metrics(("OS.IDLE", "second", "N"))}]))
    got = {r.metric: r.description for r in cat.build_catalogue(raw, fleet, exclude={"name": ["os.idle"]}).collect()}
    # the second stage searches the pattern, and upper case does not match it
    assert got["OS.IDLE"] == "second" and "os.idle" not in got


def series(resource, metric, points, dims=None, **more):
    key = None if metric is None else {"Metric": metric, "Dimensions": dims}
    return {"resource_id": resource, "Key": key, "DataPoints": [{"Timestamp": None if t is None else stamp(t), "Value": v} for t, v in points], **more}


def test_counters_end_to_end(spark, tmp_path, fleet):
    raw = readers.read_catalogue(spark, dump(tmp_path / "c", [
        {"resource_id": "db-pg1", "Metrics": metrics(("db.Q", "queries", "N"))}, {"resource_id": "db-my1", "Metrics": metrics(("os.m", "memory", "KB"))}]))
    catalogue = cat.build_catalogue(raw, fleet)
    points = readers.read_datapoints(spark, dump(tmp_path / "p", [
        series("db-pg1", "db.Q.avg", [(NOW - 5 * SECOND, 1.0), (NOW - 4 * SECOND, 2.0), (NOW - 3 * SECOND, None)]),
        series("db-pg1", "db.Q.max", [(NOW, 7.0)]),  # not requested
        series("db-pg1", "db.load.avg", [(NOW - 200 * SECOND, 9.0)]),  # too old
        series("db-my1", "os.m.avg", [(NOW - 180 * SECOND, 5.0), (NOW + 1, 6.0)]),
        series("db-my1", "os.other.avg", [(NOW, 1.0)]), series("db-my1", "os.m", [(NOW, 1.0)]), series("db-my1", None, [(NOW, 1.0)]),
        series("db-my1", "os.none.avg", [(NOW, None), (None, 1.0)]), series("db-my1", "os.empty.avg", []),
    ]))
    got = sorted((r.name, r.help, r.identifier, r.engine, r.unit, r.value, r.ts_us) for r in collection.collect_metrics(points, catalogue, fleet, NOW).collect())
    assert got == [
        ("dbi_os_m_avg", "memory", "my1", "mysql", "KB", 5.0, NOW - 180 * SECOND),
        ("dbi_pg_db_q_avg", "queries", "pg1", "postgres", "N", 2.0, NOW - 4 * SECOND)]
    only = collection.collect_metrics_for([" my1 ", "nobody"], points, catalogue, fleet, NOW).collect()
    assert [r.identifier for r in only] == ["my1"]
    assert collection.collect_metrics_for([], points, catalogue, fleet, NOW).count() == 0
    rejects = {(r.metric, r.reason) for r in quality.sample_rejects(points, catalogue).collect()}
    assert rejects == {
        (None, "missing_key"), ("os.m", "no_statistic"), ("os.other.avg", "not_in_catalogue"),
        ("os.none.avg", "no_valid_point"), ("os.empty.avg", "no_valid_point")}
    bare = catalogue.drop("identifier", "cluster_identifier", "engine")
    assert sorted(r.name for r in collection.collect_metrics(points, bare, fleet, NOW).collect()) == [g[0] for g in got]


def test_top_load(spark, tmp_path, fleet):
    def sql(ident, load, group="db.sql_tokenized", **more):
        dims = {"db.sql_tokenized.id": ident, "db.sql_tokenized.statement": "s" * 201, **more}
        return series("db-pg1", "db.load.avg", [(NOW - 61 * SECOND, load), (NOW, load)], dims, dim_group=group)

    points = readers.read_dim_datapoints(spark, dump(tmp_path / "d", [
        sql("a", 1.0), sql("b", 3.0), sql("c", 2.0), sql("d", 9.0, group="db.user"),
        series("db-pg1", "db.load.avg", [(NOW, 50.0)], None, dim_group="db.sql_tokenized"),
        series("db-pg1", "db.load.avg", [(NOW, 50.0)], {}, dim_group="db.wait_event"),
        series("db-pg1", "db.load.avg", [(NOW, 4.0)], {"db.wait_event.name": "IO"}, dim_group="db.wait_event"),
    ]))
    rows = top_load_by_dimension(points, fleet, NOW, 2).collect()
    assert sorted((r.name, r.digest or "", r.wait_event or "", r.wait_type or "", r.value) for r in rows) == [
        ("dbi_pg_top_sql_load_avg", "b", "", "", 3.0), ("dbi_pg_top_sql_load_avg", "c", "", "", 2.0),
        ("dbi_pg_wait_event_load_avg", "", "IO", "", 4.0)]
    assert {r.statement for r in rows if r.digest} == {"s" * 200 + "..."}
    assert [r.dim_group for r in quality.unsupported_groups(points).collect()] == ["db.user"]


def test_policy(spark):
    instances = spark.createDataFrame([("i1", "c1"), ("i2", "zz"), ("i3", "")], "resource_id string, cluster_identifier string")
    policy = spark.createDataFrame([(0, "c1", 3), (1, "c1", 4), (2, "", 5), (3, "", 7)], "ordinal int, cluster string, top_n int")
    got = {r.resource_id: r.top_n for r in lookups.policy_for_clusters(instances, policy, ["top_n"]).collect()}
    assert got == {"i1": 3, "i2": 7, "i3": 5}  # first specific; last default; own cluster "" takes the first default
    specific = policy.filter("cluster <> ''")
    assert [r.resource_id for r in lookups.with_policy_only(instances, specific).collect()] == ["i1"]
    assert lookups.with_policy_only(instances, policy).count() == 3
    top = spark.createDataFrame([(1,), (50,), (51,), (600,)], "n int")
    assert [r.n for r in top.select(checked_top_n(F.col("n")).alias("n")).collect()] == [1, 50, 51, 600]
    with pytest.raises(Exception, match="top_n must be at least 1"):
        spark.createDataFrame([(0,)], "n int").select(checked_top_n(F.col("n"))).collect()


def samples(spark, rows):
    full = [(name, "help", ident, "", "eu", "postgres", "u", value, ts) for name, ident, value, ts in rows]
    return spark.createDataFrame(full, "name string, help string, " + ", ".join(f"{n} string" for n in COUNTER_LABELS) + ", value double, ts_us bigint")


def test_panels(spark):
    commit, rollback = "dbi_apg_db_transactions_xact_commit_avg", "dbi_apg_db_transactions_xact_rollback_avg"
    rows = union_families(samples(spark, [
        (commit, "a", 600.0, NOW), (rollback, "a", 500.0, NOW - SECOND), (commit, "b", 9.0, NOW), (commit, "a", 1.0, NOW - 9 * SECOND),
        (rollback, "b", 1.0, NOW - 300 * SECOND),  # just outside the lookback
    ]))
    grid = Grid(NOW - 120 * SECOND, NOW, 60 * SECOND)
    panel = lambda name, instance=".*": dashboards.dashboard("postgres", name, rows, NOW, grid, instance).collect()
    assert [tuple(r) for r in panel("stat_tps")] == [(1100.0, "yellow")]
    assert panel("stat_tps", "b") == [] and panel("stat_blocked") == [] and panel("stat_instances") == []
    assert sorted((r.series, r.at_us, r.value) for r in panel("series_transactions", "a")) == [
        ("a commits", NOW, 600.0), ("a rollbacks", NOW, 500.0)]


def test_vectors(spark):
    one = spark.createDataFrame([("a", None, 1.0), ("b", "x", 2.0)], "k string, l string, value double")
    two = spark.createDataFrame([("a", None, 3.0), ("b", "y", 4.0)], "k string, l string, value double")
    assert [tuple(r) for r in vector.match_one_to_one(one, two, ["k", "l"]).collect()] == [("a", None, 1.0, 3.0)]
    wide = vector.outer_by_key({"x": one, "y": two.withColumn("k", F.concat("k", F.lit("b")))}, "k")
    assert {r.k: (r.x, r.y) for r in wide.collect()} == {"a": (1.0, None), "b": (2.0, None), "ab": (None, 3.0), "bb": (None, 4.0)}
    assert vector.total(one.filter("false"), "sum").count() == 0


def test_exposition_text(spark, tmp_path):
    rows = samples(spark, [("n", 'q"\\\n', 1.5e6, NOW + 999), ("n", "a", 1.0, None), ("m", "a", 0.25, NOW)])
    path = str(tmp_path / "text")
    writers.write_exposition_text(rows, path)
    lines = [r.value for r in spark.read.text(path).orderBy("value").collect()]
    rest = 'region="eu",unit="u"}'
    assert sorted(lines) == sorted([
        "# HELP m help", "# TYPE m gauge", "# HELP n help", "# TYPE n gauge",
        f'm{{cluster_identifier="",engine="postgres",identifier="a",{rest} 0.25 {NOW // 1000}',
        f'n{{cluster_identifier="",engine="postgres",identifier="a",{rest} 1',
        'n{cluster_identifier="",engine="postgres",identifier="q\\"\\\\\\n",' + f"{rest} 1.5e+06 {NOW // 1000}",
    ])
    # in the order of the files each name comes once: help, type, samples
    ordered = [r.value for r in writers.to_exposition_text(rows).collect()]
    assert [line.split()[1 if line.startswith("#") else 0].startswith("HELP") for line in ordered] == [True, False, False, True, False, False, False]


def test_samples_are_partitioned(spark, tmp_path):
    path = str(tmp_path / "samples")
    day = 86_400 * SECOND
    writers.write_samples(union_families(samples(spark, [("n", "a", 1.0, NOW), ("n", "b", 2.0, None), ("n", "c", 3.0, NOW - day)])), path)
    assert {p.name for p in (tmp_path / "samples" / "region=eu").iterdir() if p.is_dir()} == {"ds=2023-11-14", "ds=2023-11-13", "ds=undated"}
    assert readers.read_samples(spark, path).count() == 3
    recent = readers.read_samples(spark, path, NOW - SECOND, NOW)
    assert {r.identifier for r in recent.collect()} == {"a", "b"}
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "2023-11-14" in plan.split("PartitionFilters")[1].split("]")[0]


def test_quality_findings(spark):
    rows = samples(spark, [("n", "a", 1.0, 1), ("n", "a", 2.0, 1), ("n", "b", 1.0, 1)])
    assert [(r.identifier, r.copies) for r in quality.duplicate_series(rows, list(COUNTER_LABELS)).collect()] == [("a", 2)]
    other = rows.withColumn("help", F.lit("else"))
    assert [tuple(r) for r in quality.conflicting_help(rows.unionByName(other)).collect()] == [("n", 2)]
    quality.require_reject_share(1, 100, 0.05)
    with pytest.raises(ValueError):
        quality.require_reject_share(6, 100, 0.05)


def test_scratch_folder_follows_the_cluster(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_prefix_is_checked_before_publishing(spark):
    names = spark.createDataFrame([("dbi_pg",), ("1dbi",)], "n string").select(is_valid_prefix(F.col("n")).alias("v"))
    assert [r.v for r in names.collect()] == [True, False]


def test_close_loads_are_ranked_raw(spark):
    rows = [("a", 1e-7), ("b", 4e-7)]
    loads = spark.createDataFrame(
        [("i", "db.sql_tokenized", {"db.sql_tokenized.id": k}, v) for k, v in rows],
        "resource_id string, dim_group string, dims map<string,string>, load double")
    assert [r.dims["db.sql_tokenized.id"] for r in dimensions.top_load(loads, 1).collect()] == ["b"]


def test_small_panel_values_stay(spark):
    rows = union_families(samples(spark, [("dbi_ams_db_sql_queries_avg", "a", 4e-7, NOW)]))
    panels = {n: p for n, p in dashboards.BOARDS["mysql"].items() if isinstance(p, dashboards.Stat) and p.decimals is None and p.function != "count"}
    name, panel = next(iter(panels.items()))
    rows = union_families(samples(spark, [(n, "a", 4e-7, NOW) for n in panel.names]))
    value = dashboards.dashboard("mysql", name, rows, NOW, Grid(NOW, NOW, 1)).first().value
    assert 0 < value < 1e-6
    assert {r.panel: r.value for r in dashboards.stat_panels(rows, NOW).collect()}[name] == value


def test_tied_times_do_not_depend_on_the_order(spark):
    rows = samples(spark, [("n", "a", float(v), NOW) for v in (5, 7, 2, 0, 6, 1)])
    keys = ["name", *COUNTER_LABELS]
    for parts in (1, 6):
        assert instant(rows.repartition(parts), keys, NOW).first().value == 7.0
        grid = Grid(NOW, NOW + 60 * SECOND, 60 * SECOND)
        assert {r.value for r in over_grid(rows.repartition(parts).select(*keys, "value", "ts_us"), keys, grid).collect()} == {7.0}
    plan = instant(rows, keys, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_no_blank_exposition_lines(spark):
    rows = samples(spark, [("n", "a", None, NOW), ("n", "b", 1.0, NOW)]).withColumn("help", F.lit(None).cast("string"))
    lines = [r.value for r in writers.to_exposition_text(rows).collect()]
    assert len(lines) == 3 and None not in lines and lines[0] == "# HELP n "


def test_the_catalogue_is_scanned_once(spark, tmp_path):
    raw = spark.createDataFrame(
        [("eu", "i1", 0, "db.a", "d1", "u"), ("eu", "i2", 0, "DB.a", "d2", "u")],
        "region string, resource_id string, ordinal int, metric string, description string, unit string")
    path = str(tmp_path / "catalogue")
    raw.write.parquet(path)
    fleet_rows = spark.createDataFrame(
        [("eu", i, i, "", "postgres") for i in ("i1", "i2")],
        "region string, resource_id string, identifier string, cluster_identifier string, engine string")
    built = build_catalogue(spark.read.parquet(path), fleet_rows)
    assert {r.description for r in built.collect() if r.metric != "db.load"} == {"d1"}
    built.collect()
    final = built._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") - final.count("ReusedExchange") <= 1


def test_snapshot_at(spark):
    rows = spark.createDataFrame([("eu", "a", 1), ("eu", "b", 2), ("us", "c", 1), ("us", "d", None), (None, "e", 1), ("eu", "f", 9)],
                                 "region string, resource_id string, fetched_at_us bigint")
    got = snapshot_at(rows, ["region"], 5, 3).collect()
    assert {(r.resource_id, r.is_stale) for r in got} == {("b", False), ("c", True), ("e", True)}


def test_region_and_time_of_fetching_survive_the_readers(spark, tmp_path):
    def entry(region, fetched, description):
        return {"region": region, "fetched_at_us": fetched, "resource_id": "db-1", "Metrics": metrics(("db.Q", description, "N"))}

    raw = readers.read_catalogue(spark, dump(tmp_path / "c", [entry("eu", 20, "late"), entry("eu", 10, "early"), entry("us", 5, "other")]))
    assert {(r.region, r.seen_at_us, r.description) for r in raw.collect()} == {("eu", 20, "late"), ("eu", 10, "early"), ("us", 5, "other")}
    points = readers.read_datapoints(spark, dump(tmp_path / "p", [{"region": "eu", **series("db-1", "db.Q.avg", [(NOW, 1.0)])}]))
    assert [(r.region, r.resource_id, r.value) for r in points.collect()] == [("eu", "db-1", 1.0)]
    given = readers.read_datapoints(spark, dump(tmp_path / "q", [series("db-1", "db.Q.avg", [(NOW, 1.0)])]), region="us")
    assert given.first().region == "us" and "region" not in readers.read_datapoints(spark, str(tmp_path / "q")).columns
    folders = tmp_path / "r"
    folders.mkdir()
    for region in ("eu", "us"):
        dump(folders / f"region={region}", [instance(region + "1")])
    assert {(r.region, r.identifier) for r in readers.read_instances(spark, str(folders)).collect()} == {("eu", "eu1"), ("us", "us1")}


def test_records_may_lack_region_and_time_of_fetching(spark, tmp_path):
    def entry(name, **origin):
        return {**origin, "resource_id": name, "Metrics": metrics(("db.Q", "text", "N"))}

    raw = readers.read_catalogue(spark, dump(tmp_path / "c", [entry("db-1"), entry("db-2", region="eu"), entry("db-3", region="us", fetched_at_us=10)]))
    assert {(r.resource_id, r.region, r.seen_at_us) for r in raw.collect()} == {("db-1", None, None), ("db-2", "eu", None), ("db-3", "us", 10)}
    points = readers.read_datapoints(spark, dump(tmp_path / "p", [series("db-1", "db.Q.avg", [(NOW, 1.0)]), {"region": "eu", **series("db-1", "db.Q.avg", [(NOW, 2.0)])}]))
    assert {(r.region, r.value) for r in points.collect()} == {(None, 1.0), ("eu", 2.0)}
    flat = readers.read_instances(spark, dump(tmp_path / "i", [instance("a"), {"region": "eu", "fetched_at_us": 7, **instance("b")}]))
    assert {(r.identifier, r.region, r.fetched_at_us) for r in flat.collect()} == {("a", None, None), ("b", "eu", 7)}


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_files_may_lack_region_and_time_of_fetching(spark, tmp_path, fmt):
    path = [str(tmp_path / "a"), str(tmp_path / "b")]
    digests = spark.range(1).selectExpr("'db-1' AS resource_id", "'q' AS digest")
    digests.write.format(fmt).save(path[0])
    digests.selectExpr("*", "'eu' AS region", "7L AS fetched_at_us").write.format(fmt).save(path[1])
    got = readers.read_mysql_digests(spark, path, fmt)
    assert sorted((r.region or "", r.fetched_at_us or 0) for r in got.collect()) == [("", 0), ("eu", 7)]


def test_statement_snapshots_of_one_instance(spark, tmp_path):
    path = str(tmp_path / "view")
    spark.sql("SELECT 1L AS queryid, 'SELECT 1' AS query, 2L AS calls, 3.0D AS mean_exec_time, 0.0D AS blk_read_time, 0.0D AS blk_write_time, 4L AS rows").write.parquet(path)
    with pytest.raises(ValueError, match="resource_id"):
        readers._snapshot(
            spark, path, T.StructType([f for f in PG_STATEMENTS.fields if f.name != "resource_id"]), "parquet", "", "eu", None)
    got = readers.read_pg_statements(spark, path, region="eu", resource_id="db-9").first()
    assert (got.region, got.resource_id, got.calls) == ("eu", "db-9", 2)
    query = readers.view_query(PG_STATEMENTS, readers.PG_VIEW, ("queryid",), "query")
    assert query.startswith("SELECT queryid, LEFT(query, 200) AS query, calls") and query.endswith("FROM pg_stat_statements WHERE queryid IS NOT NULL")


def test_one_inventory_and_one_catalogue_in_a_scrape(spark):
    from fleetlens.queries import frames

    rows = frames.exposition(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan  # what the instances are derived from is not read again


def test_broken_records_and_files_are_rejects(spark, tmp_path):
    path = tmp_path / "d"
    path.mkdir()
    lines = ['{"resource_id":"db-1","Key":{"Metric":"m.avg"},"DataPoints":[]}', '{"resource_id":"db-2","Key"', "no json", '{"resource_id":"db-3"}']
    (path / "a.json").write_text("\n".join(lines) + "\n")
    (path / "b.json.gz").write_bytes(b"\x1f\x8b\x08\x00cut")
    (path / "c.json").write_text('{"resource_id":"db-4"}\n{"resource_id":"db-5","DataPoints":"x"}\n')
    (path / "d.json").write_text("")
    rejects = {(r.file.rsplit("/", 1)[1], r.reason, r.record) for r in readers.source_rejects(spark, str(path), schemas.RAW_DATAPOINTS).collect()}
    assert rejects == {
        ("a.json", "broken_record", lines[1]), ("a.json", "broken_record", lines[2]), ("b.json.gz", "no_readable_record", None),
        ("c.json", "broken_record", '{"resource_id":"db-5","DataPoints":"x"}')}
    good = readers.read_datapoints(spark, str(path), origin=[], tolerant=True)
    assert good.count() == good.select("resource_id").count() == 3 and {r.resource_id for r in good.collect()} == {"db-1", "db-3", "db-4"}
    with pytest.raises(Exception, match="gzip|FAILED_READ_FILE|EOF|header"):
        readers.read_datapoints(spark, str(path), origin=[]).collect()


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_a_truncated_file_is_a_reject(spark, tmp_path, fmt):
    path = tmp_path / "d"
    spark.createDataFrame([(f"db-{i}", "d", i) for i in range(40)], "resource_id string, digest string, count_star long").repartition(4).write.format(fmt).save(str(path))
    files = sorted(path.glob(f"part-*.{'*' if fmt == 'orc' else ''}{fmt}"))
    cut = files[1].read_bytes()
    files[1].write_bytes(cut[: len(cut) // 2])
    (path / f".{files[1].name}.crc").unlink()
    got = readers.source_rejects(spark, str(path), schemas.MYSQL_DIGESTS, fmt).collect()
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in got] == [(files[1].name, "no_readable_record")]
    rows = readers._dump(spark, str(path), schemas.MYSQL_DIGESTS, fmt, None, [], True)
    assert rows.count() == 30


def test_declared_origins_start_no_job(spark, tmp_path):
    (tmp_path / "region=eu").mkdir()
    (tmp_path / "region=eu" / "a.json").write_text('{"DbiResourceId":"db-1","fetched_at_us":5}\n')
    spark.sparkContext.setJobGroup("plan-only", "plan")
    flat = readers.read_instances(spark, str(tmp_path), origin=["region", "fetched_at_us"])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")) == []
    spark.sparkContext.setJobGroup("other", "run")
    assert [(r.region, r.resource_id, r.fetched_at_us) for r in flat.collect()] == [("eu", "db-1", 5)]
    with pytest.raises(ValueError, match="colour"):
        readers.read_instances(spark, str(tmp_path), origin=["colour"])


def test_run_metrics_come_with_the_write(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 5 = 0 AS bad").write.parquet(str(tmp_path / "in"))
    run = Observation("run")
    observed = quality.observe_rejects(spark.read.parquet(str(tmp_path / "in")), run, F.col("bad")).filter("NOT bad")
    assert observed._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    observed.write.parquet(str(tmp_path / "out"))
    assert run.get == {"total": 100, "rejects": 20} and spark.read.parquet(str(tmp_path / "out")).count() == 80
    quality.require_observed_share(run, 0.2)
    with pytest.raises(ValueError, match="20 of 100"):
        quality.require_observed_share(run, 0.19)


def test_snapshots_are_used_when_they_are_whole(spark, tmp_path):
    minute = 60_000_000
    (tmp_path / "drops").mkdir()
    taken = snapshots.Snapshots(
        snapshots.read_snapshots(spark, str(tmp_path / "drops"), schemas.RAW_INSTANCE, files_a_batch=1), readers.flatten_instances, ["region"], str(tmp_path / "t"), "1 minute")

    def drop(name, *records):

        (tmp_path / "drops" / name).write_text("".join(json.dumps(dict(zip(("region", "fetched_at_us", "DbiResourceId"), r))) + "\n" for r in records) + "broken {\n")
        taken.run()
        return sorted((r.region or "", r.fetched_at_us, r.resource_id) for r in taken.read().collect())

    first = [("eu", 10 * minute, "a"), ("eu", 10 * minute, "b"), (None, 10 * minute, "c")]
    assert drop("1.json", *first[:2]) == []
    assert drop("2.json", first[2]) == []  # the rest of the same snapshot
    second = [("eu", 20 * minute, "a"), ("us", 15 * minute, "d")]
    assert drop("3.json", *second) == [("", 10 * minute, "c"), ("eu", 10 * minute, "a"), ("eu", 10 * minute, "b"), ("us", 15 * minute, "d")]
    assert {r[2] for r in drop("4.json", ("eu", None, "x"))} == {"a", "b", "c", "d"}  # written now, long after: both are closed
    newest = snapshot_at(taken.read(), ["region"], 60 * minute)
    assert sorted((r.region or "", r.resource_id) for r in newest.collect() if r.region) == [("eu", "a"), ("us", "d")]
