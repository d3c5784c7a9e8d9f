"""Filters, joins, aggregations, ranking, sorting and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

from fleetlens.functions.engines import normalize_engine, statement_family
from fleetlens.operators import aggregates as agg, lookups, predicates as pred, vector
from fleetlens.operators.asof import Grid, instant, over_grid, snapshot_at, usable_snapshots
from fleetlens.operators.latest import latest_n, latest_valid, latest_with_interval, newest_in_responses
from fleetlens.operators.ranking import oldest_instances, top_n_per_group
from fleetlens.operators.rule_index import indexed_ttl
from fleetlens.operators.rules import pattern_filter, pattern_ttl, select_statistics
from fleetlens.plans import catalogue as cat, collection, dimensions, inventory, scrape, statements as st
from fleetlens.plans.dashboards import BOARDS, dashboard
from fleetlens.queries import check_sql as S, frames as X, inputs as I
from fleetlens.queries.registry import query
from fleetlens.session import materialize
from fleetlens.sources import readers
from fleetlens.schemas import COUNTER_LABELS, EXPOSITION, STATEMENT_LABELS

NOW = I.NOW_US
INV = "region, resource_id, identifier, cluster_identifier, endpoint, port, engine, creation_us, tag_environment AS environment, tag_team AS team"


def _inventory(df):
    tags = [F.try_element_at("tags", F.lit(key)).alias(key.lower()) for key in ("Environment", "Team")]
    return df.select("*", *tags).drop("tags")


# ---- filters -------------------------------------------------------------------------------------------

@query("flt_1", f"SELECT resource_id, {S.RULES} AS kept FROM flat", "flat")
def flt_1(spark, d):
    flat = I.flat_instances(spark, d)
    fields = {"identifier": F.col("identifier"), "engine": normalize_engine(F.col("engine_raw"))}
    return flat.select("resource_id", pattern_filter(fields, F.col("tags"), *I.INSTANCE_RULES).alias("kept"))


@query("flt_2", """SELECT resource_id, ordinal, metric, CASE WHEN regexp_matches(metric, '\\.idle$') THEN ''
  WHEN metric = 'db.SQL.queries' THEN 'avg,max' ELSE 'avg' END AS statistics FROM fx_catalogue""", "fx_catalogue")
def flt_2(spark, d):
    chosen = F.concat_ws(",", select_statistics(F.col("metric"), "avg", *I.METRIC_RULES))
    return I.fx_catalogue(spark, d).select("resource_id", "ordinal", "metric", chosen.alias("statistics"))


@query("flt_3", "SELECT region, resource_id, engine FROM eligible", "eligible")
def flt_3(spark, d):
    return X.eligible(spark, d).select("region", "resource_id", "engine")


@query("flt_4", "SELECT * FROM fx_catalogue WHERE metric IS NOT NULL AND description IS NOT NULL AND unit IS NOT NULL", "fx_catalogue")
def flt_4(spark, d):
    return I.fx_catalogue(spark, d).filter(pred.valid_catalogue_row())


@query("flt_5", "SELECT * FROM valid_points", "valid_points")
def flt_5(spark, d):
    return I.fx_datapoints(spark, d).filter(pred.valid_point())


KEYED = "CASE WHEN pos % 23 <> 0 THEN metric END"


@query("flt_6", f"SELECT pos, {KEYED} AS metric FROM fx_datapoints WHERE {KEYED} IS NOT NULL", "fx_datapoints")
def flt_6(spark, d):
    return I.fx_datapoints(spark, d).select("pos", F.expr(KEYED).alias("metric")).filter(pred.has_series_key())


@query("flt_7", "SELECT pos, dim_group FROM fx_dim_datapoints WHERE dim_id IS NOT NULL", "fx_dim_datapoints")
def flt_7(spark, d):
    return I.dim_points(spark, d).filter(pred.has_dimensions()).select("pos", "dim_group")


GROUPED = "CASE WHEN pos % 7 = 0 THEN 'db.user' ELSE dim_group END"


@query("flt_8", f"SELECT pos, {GROUPED} AS dim_group FROM fx_dim_datapoints WHERE {GROUPED} <> 'db.user'", "fx_dim_datapoints")
def flt_8(spark, d):
    rows = I.dim_points(spark, d).select("pos", F.expr(GROUPED).alias("dim_group"))
    return rows.filter(pred.supported_group(F.col("dim_group")))


WANTED = ("customer-000000002", " customer-000000003 ", "customer-000000008", "no such instance")


@query("flt_9", f"SELECT {INV} FROM fleet WHERE identifier IN ('customer-000000002', 'customer-000000003', 'customer-000000008')", "fleet")
def flt_9(spark, d):
    return _inventory(X.fleet(spark, d).filter(pred.identifier_in(WANTED)))


@query("flt_10", """SELECT resource_id, digest, count_star AS calls FROM fx_mysql_digests WHERE digest IS NOT NULL AND schema_name IS NOT NULL
UNION ALL SELECT resource_id, CAST(queryid AS VARCHAR), calls FROM fx_pg_statements WHERE queryid IS NOT NULL""", "fx_mysql_digests", "fx_pg_statements")
def flt_10(spark, d):
    mysql = I.fx_mysql_digests(spark, d).filter(pred.mysql_digest_usable()).select("resource_id", "digest", F.col("count_star").alias("calls"))
    pg = I.fx_pg_statements(spark, d).filter(pred.pg_statement_usable())
    return mysql.unionByName(pg.select("resource_id", F.col("queryid").cast("string").alias("digest"), "calls"))


@query("flt_11", "SELECT * FROM recent", "recent")
def flt_11(spark, d):
    return X.recent_points(spark, d)


PICK = "customer-00000000[1-4].*|customer-0000001.."


@query("flt_12", f"SELECT resource_id, identifier FROM flat WHERE regexp_full_match(identifier, '{PICK}')", "flat")
def flt_12(spark, d):
    return I.fx_instances(spark, d).filter(pred.label_matches(F.col("identifier"), PICK)).select("resource_id", "identifier")


MIXED = "CASE WHEN ordinal = 3 THEN concat('net.', metric) ELSE metric END"


@query("flt_14", f"SELECT resource_id, {MIXED} AS metric FROM fx_catalogue WHERE lower({MIXED}) LIKE 'os.%' OR lower({MIXED}) LIKE 'db.%'", "fx_catalogue")
def flt_14(spark, d):
    rows = I.fx_catalogue(spark, d).select("resource_id", F.expr(MIXED).alias("metric"))
    return rows.filter(pred.requested_type(F.col("metric")))


@query("flt_15", "SELECT resource_id, engine, family FROM sources", "sources")
def flt_15(spark, d):
    rows = X.fleet(spark, d).filter(pred.statement_source_usable())
    return rows.select("resource_id", "engine", statement_family(F.col("engine")).alias("family"))


# ---- joins ---------------------------------------------------------------------------------------------

@query("jn_1", f"""SELECT l.resource_id, l.metric, l.value, l.ts_us, c.metric AS base, c.description, c.unit
FROM latest l JOIN catalogue c ON l.resource_id = c.resource_id AND {S.base('l.metric')} = c.metric""", "latest", "catalogue")
def jn_1(spark, d):
    rows = lookups.join_catalogue(X.latest(spark, d), X.catalogue(spark, d))
    return rows.select("resource_id", "metric", "value", "ts_us", "base", "description", "unit")


@query("jn_2", "SELECT l.*, f.region, f.identifier, f.cluster_identifier, f.engine FROM latest l JOIN eligible f USING (resource_id)", "latest", "eligible")
def jn_2(spark, d):
    return lookups.join_instances(X.latest(spark, d), X.eligible(spark, d))


@query("jn_3", f"""SELECT resource_id, metric, {S.base('metric')} AS base FROM latest l WHERE NOT EXISTS
  (SELECT 1 FROM catalogue c WHERE c.resource_id = l.resource_id AND c.metric = {S.base('l.metric')})""", "latest", "catalogue")
def jn_3(spark, d):
    return lookups.not_in_catalogue(X.latest(spark, d), X.catalogue(spark, d)).select("resource_id", "metric", "base")


@query("jn_4", f"SELECT pos, metric, {S.ttl('metric')} AS ttl_us FROM fx_datapoints", "fx_datapoints")
def jn_4(spark, d):
    return I.fx_datapoints(spark, d).select("pos", "metric", pattern_ttl(F.col("metric"), I.TTL_RULES).alias("ttl_us"))


# Rules and names as data: a rule per part, a name per order.
RULE_TABLE = """SELECT p_partkey AS ordinal, CASE p_partkey % 5 WHEN 0 THEN concat('^db[.]c', p_partkey, '[.]') WHEN 1 THEN concat('[.]c', p_partkey, '[.](low|high)')
  WHEN 2 THEN concat('c', p_partkey, '.*[.]urgent[.]avg$') WHEN 3 THEN concat('^db[.]c[0-9]+', p_partkey % 100, '[.]med.*avg') ELSE concat('c', p_partkey % 50, '[0-9]?[.](medium|low)') END AS pattern,
  (p_partkey % 7) * 60000000 AS ttl_us FROM part"""
NAME_TABLE = "SELECT o_orderkey, concat('db.c', o_custkey, '.', lower(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g')), '.avg') AS metric FROM orders"


@query("jn_4_rules", f"""WITH r AS ({RULE_TABLE}), n AS ({NAME_TABLE}), d AS (SELECT DISTINCT metric FROM n),
  t AS (SELECT metric, arg_min(ttl_us, ordinal) AS ttl_us FROM d JOIN r ON regexp_matches(metric, pattern) GROUP BY metric)
SELECT o_orderkey, metric, CAST(coalesce(ttl_us, 0) AS BIGINT) AS pattern_ttl_us FROM n LEFT JOIN t USING (metric)""")
def jn_4_rules(spark, d):
    """As many rules as parts, as many names as orders have."""
    rules = spark.sql(RULE_TABLE.replace("FROM part", "FROM {part}"), part=I.table(spark, d, "part"))
    kind = F.lower(F.regexp_replace("o_orderpriority", "[^A-Z]", ""))
    names = I.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("db.c"), F.col("o_custkey").cast("string"), F.lit("."), kind, F.lit(".avg")).alias("metric"))
    return indexed_ttl(names, rules)


@query("jn_5", "SELECT resource_id, cluster_identifier, top_n FROM policied", "policied")
def jn_5(spark, d):
    return lookups.policy_for_clusters(X.fleet(spark, d), I.policy(spark), ["top_n"]).select("resource_id", "cluster_identifier", "top_n")


@query("jn_6", "SELECT resource_id, cluster_identifier FROM fleet WHERE cluster_identifier IN (SELECT cluster FROM policy WHERE cluster <> '')", "fleet", "policy")
def jn_6(spark, d):
    specific = I.policy(spark).filter("cluster <> ''")
    return lookups.with_policy_only(X.fleet(spark, d), specific).select("resource_id", "cluster_identifier")


COMMIT, ROLLBACK = "dbi_apg_db_transactions_xact_commit_avg", "dbi_apg_db_transactions_xact_rollback_avg"


def _board_now(spark, d):
    return instant(X.board(spark, d, NOW - 300_000_000, NOW), ["name", *COUNTER_LABELS], NOW)


@query("jn_7", f"""SELECT identifier, region, a.value + b.value AS total FROM (SELECT * FROM board_now WHERE name = '{COMMIT}') a
JOIN (SELECT * FROM board_now WHERE name = '{ROLLBACK}') b USING (identifier, cluster_identifier, region, engine, unit)""", "board_now")
def jn_7(spark, d):
    now = _board_now(spark, d)
    pairs = vector.match_one_to_one(now.filter(F.col("name") == COMMIT), now.filter(F.col("name") == ROLLBACK), COUNTER_LABELS)
    return pairs.select("identifier", "region", (F.col("left_value") + F.col("right_value")).alias("total"))


FIVE = {
    "calls": ("query_calls_total", "sum"), "duration": ("query_avg_duration_ms", "avg"), "errors": ("query_errors_total", "sum"),
    "examined": ("query_rows_examined_total", "sum"), "sent": ("query_rows_sent_total", "sum"),
}


@query("jn_8", "SELECT digest, " + ", ".join(f"round({f}(value) FILTER (name = 'dbi_ams_{n}'), 6) AS {k}" for k, (n, f) in FIVE.items())
       + " FROM statement_samples WHERE starts_with(name, 'dbi_ams_') GROUP BY digest", "statement_samples")
def jn_8(spark, d):
    samples = X.statement_samples(spark, d)
    vectors = {k: vector.by_labels(samples.filter(F.col("name") == f"dbi_ams_{n}"), ["digest"], f) for k, (n, f) in FIVE.items()}
    return X.rounded(vector.outer_by_key(vectors, "digest"), *FIVE)


def _requested(spark, d):
    series = cat.requested_series(X.catalogue(spark, d))
    return series.select("resource_id", F.col("series").alias("metric"))


def _fresh(spark, d):
    return collection.freshness(X.recent_points(spark, d), I.TTL_RULES, NOW)


REQUESTED = "(SELECT resource_id, concat(metric, '.', s) AS metric FROM catalogue, unnest(statistics) AS u(s))"


@query("jn_9", f"""SELECT q.resource_id, q.metric, f.value, f.ts_us, f.resource_id IS NOT NULL AS is_hit FROM {REQUESTED} q
LEFT JOIN (SELECT * FROM fresh WHERE NOT expired) f USING (resource_id, metric)""", "catalogue", "fresh")
def jn_9(spark, d):
    return lookups.split_fresh(_requested(spark, d), _fresh(spark, d), ["resource_id", "metric"], NOW)


@query("jn_10", "SELECT name, identifier, region, value, ts_us FROM board_now", "board_now")
def jn_10(spark, d):
    return _board_now(spark, d).select("name", "identifier", "region", "value", "ts_us")


@query("jn_11", "SELECT name, identifier, region, at_us, value, ts_us FROM board_grid", "board_grid")
def jn_11(spark, d):
    rows = over_grid(X.board(spark, d, X.HOUR_GRID.start_us - 300_000_000, NOW), ["name", *COUNTER_LABELS], X.HOUR_GRID)
    return rows.select("name", "identifier", "region", "at_us", "value", "ts_us")


DAY = 86_400_000_000
SNAPSHOT_GRID = Grid(I.START_US - 1000 * DAY, I.START_US, 7 * DAY)


@query("jn_12", f"""SELECT region, at_us, max(creation_us) AS fetched_at_us, at_us > max(creation_us) + {2 * DAY} AS is_stale
FROM flat JOIN (SELECT {SNAPSHOT_GRID.start_us} + i * {7 * DAY} AS at_us FROM range({SNAPSHOT_GRID.last_slot + 1}) AS r(i)) ON creation_us <= at_us
GROUP BY region, at_us""", "flat")
def jn_12(spark, d):
    snapshots = I.fx_instances(spark, d).select("region", F.col("creation_us").alias("fetched_at_us"))
    return usable_snapshots(snapshots, ["region"], SNAPSHOT_GRID, 2 * DAY)


FETCHES = (NOW - 7_200_000_000, NOW - 3_600_000_000, NOW + 3_600_000_000)  # the last one is still to come


@query("jn_12_rows", f"""SELECT region, resource_id, fetched_at_us, {NOW} > fetched_at_us + 1800000000 AS is_stale FROM (
  SELECT region, resource_id, unnest([{", ".join(map(str, FETCHES))}]) AS fetched_at_us FROM flat) s
WHERE fetched_at_us = CASE WHEN region = 'ASIA' THEN {FETCHES[0]} ELSE {FETCHES[1]} END""", "flat")
def jn_12_rows(spark, d):
    """Three snapshots an hour apart; those of one region lack the second one."""
    times = F.explode(F.array(*[F.lit(t) for t in FETCHES]))
    rows = I.fx_instances(spark, d).select("region", "resource_id", times.alias("fetched_at_us"))
    rows = rows.filter((F.col("region") != "ASIA") | (F.col("fetched_at_us") != FETCHES[1]))
    return snapshot_at(rows, ["region"], NOW, 1_800_000_000)


# ---- aggregations --------------------------------------------------------------------------------------

CPU = "dbi_os_cpuutilization_total_avg"


@query("ag_1", f"SELECT round(sum(value), 6) AS value FROM board_now WHERE name = '{CPU}' HAVING count(*) > 0", "board_now")
def ag_1(spark, d):
    return X.rounded(vector.total(_board_now(spark, d).filter(F.col("name") == CPU), "sum"), "value")


@query("ag_2", f"SELECT round(avg(value), 6) AS value FROM board_now WHERE name = '{CPU}' HAVING count(*) > 0", "board_now")
def ag_2(spark, d):
    return X.rounded(vector.total(_board_now(spark, d).filter(F.col("name") == CPU), "avg"), "value")


@query("ag_3", f"SELECT count(DISTINCT identifier) AS value FROM fx_board WHERE name = '{CPU}'", "fx_board")
def ag_3(spark, d):
    return vector.count_distinct_label(X.board(spark, d).filter(F.col("name") == CPU), "identifier")


RANGES = tuple((I.START_US + i * 600_000_000, I.START_US + (i + 1) * 600_000_000 + i * 120_000_000) for i in range(3))


@query("ag_3_sketch", f"""SELECT name, since_us, count(DISTINCT identifier) AS value FROM fx_board
JOIN (VALUES {", ".join(f"(CAST({a} AS BIGINT), {b})" for a, b in RANGES)}) AS r(since_us, until_us) ON ts_us >= since_us AND ts_us < until_us GROUP BY name, since_us""", "fx_board")
def ag_3_sketch(spark, d):
    """Instances behind each name in three ranges that overlap, from one stored table of a sketch a minute."""
    sketches = materialize(vector.distinct_sketches(X.board(spark, d), "identifier", 60_000_000), "sketches")
    found = [vector.distinct_from_sketches(sketches, a, b).withColumn("since_us", F.lit(a)) for a, b in RANGES]
    return reduce(DataFrame.unionByName, found)


LEVELS = {"region": "region", "cluster_identifier": "cluster", "identifier": "instance"}


@query("ag_1_rollup", f"""SELECT CASE GROUPING(region, cluster_identifier, identifier) WHEN 7 THEN 'total' WHEN 3 THEN 'region' WHEN 1 THEN 'cluster' ELSE 'instance' END AS level,
  region, cluster_identifier, identifier, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, count(value) AS n
FROM board_now WHERE name = '{CPU}' GROUP BY ROLLUP (region, cluster_identifier, identifier) HAVING count(value) > 0""", "board_now")
def ag_1_rollup(spark, d):
    """One report of the fleet with its subtotals."""
    return X.rounded(vector.subtotals(_board_now(spark, d).filter(F.col("name") == CPU), LEVELS), "sum", "avg")


def _statement(suffix):
    return f"ends_with(name, '{suffix}')"


@query("ag_4", f"SELECT statement, digest, round(sum(value), 6) AS value FROM statement_samples WHERE {_statement('_query_calls_total')} GROUP BY ALL", "statement_samples")
def ag_4(spark, d):
    rows = X.statement_samples(spark, d).filter(F.col("name").endswith("_query_calls_total"))
    return X.rounded(vector.by_labels(rows, ["statement", "digest"], "sum"), "value")


@query("ag_5", f"SELECT statement, digest, round(avg(value), 6) AS value FROM statement_samples WHERE {_statement('_query_avg_duration_ms')} GROUP BY ALL", "statement_samples")
def ag_5(spark, d):
    rows = X.statement_samples(spark, d).filter(F.col("name").endswith("_query_avg_duration_ms"))
    return X.rounded(vector.by_labels(rows, ["statement", "digest"], "avg"), "value")


@query("ag_6", f"""SELECT resource_id, metric, period_us, {S.stat('metric')} AS statistic, n,
  round(CASE {S.stat('metric')} WHEN 'avg' THEN a WHEN 'min' THEN lo WHEN 'max' THEN hi ELSE s END, 6) AS value FROM (
  SELECT resource_id, metric, ts_us // 60000000 * 60000000 AS period_us, avg(value) AS a, min(value) AS lo, max(value) AS hi, sum(value) AS s,
    count(value) AS n FROM valid_points GROUP BY ALL)""", "valid_points")
def ag_6(spark, d):
    return X.rounded(agg.resample_by_statistic(I.fx_datapoints(spark, d), agg.DIMENSION_PERIOD_US), "value")


@query("ag_7", f"SELECT DISTINCT identifier FROM fx_board WHERE name = '{CPU}'", "fx_board")
def ag_7(spark, d):
    return vector.label_values(X.board(spark, d).filter(F.col("name") == CPU), "identifier")


SEEN = "CASE WHEN resource_id LIKE '%5' THEN 1 ELSE 2 END"


@query("ag_8", f"""SELECT region, engine, lower(metric) AS metric_lower, first(description ORDER BY seen, ordinal, resource_id) AS canonical_description FROM (
  SELECT region, engine, resource_id, ordinal, metric, description, {SEEN} AS seen FROM cat_chosen
  UNION ALL SELECT 'TWIN', engine, resource_id, ordinal, metric, concat(description, CASE WHEN ordinal >= 0 THEN ' (twin)' ELSE '' END), 3 - {SEEN} FROM cat_chosen)
GROUP BY ALL""", "cat_chosen")
def ag_8(spark, d):
    """Two regions that share all resource ids, and two times of fetching in each."""
    fleet = X.fleet(spark, d)
    raw = I.fx_catalogue(spark, d).join(fleet.select("resource_id", "region"), "resource_id").withColumn("seen_at_us", F.expr(f"CAST({SEEN} AS BIGINT)"))
    twin = raw.withColumns({"region": F.lit("TWIN"), "description": F.concat("description", F.lit(" (twin)")), "seen_at_us": 3 - F.col("seen_at_us")})
    both = fleet.unionByName(fleet.withColumn("region", F.lit("TWIN")))
    rows = cat.with_load_metric(cat.of_instances(raw.unionByName(twin), both))
    return agg.canonical_descriptions(cat.chosen_entries(rows, "avg", *I.METRIC_RULES))


@query("ag_9", f"""SELECT resource_id, count(*) AS requested, count(*) FILTER (f.resource_id IS NOT NULL) AS hits,
  count(*) FILTER (f.resource_id IS NULL) AS misses FROM {REQUESTED} q
LEFT JOIN (SELECT * FROM fresh WHERE NOT expired) f USING (resource_id, metric) GROUP BY resource_id""", "catalogue", "fresh")
def ag_9(spark, d):
    return agg.collection_statistics(lookups.split_fresh(_requested(spark, d), _fresh(spark, d), ["resource_id", "metric"], NOW))


@query("ag_9_run", f"""SELECT count(*) AS requested, count(*) FILTER (f.resource_id IS NOT NULL) AS hits, count(*) FILTER (f.resource_id IS NULL) AS misses,
  count(*) FILTER (f.resource_id IS NULL) AS fetched FROM {REQUESTED} q LEFT JOIN (SELECT * FROM fresh WHERE NOT expired) f USING (resource_id, metric)""", "catalogue", "fresh")
def ag_9_run(spark, d):
    """The misses are stored, to be fetched; the run's numbers come with that write."""
    run = Observation("collection")
    split = lookups.split_fresh(_requested(spark, d), _fresh(spark, d), ["resource_id", "metric"], NOW)
    stored = materialize(agg.observe_collection(split, run).filter(~F.col("is_hit")).select("resource_id", "metric"), "to-fetch")
    seen = [F.lit(run.get[name]).cast("long").alias(name) for name in ("requested", "hits", "misses")]
    return stored.agg(F.count(F.lit(1)).alias("fetched")).select(*seen, "fetched")


@query("ag_9_points", """SELECT resource_id, count(DISTINCT metric) AS series, count(*) AS points, count(value) AS valid_points
FROM fx_datapoints GROUP BY resource_id""", "fx_datapoints")
def ag_9_points(spark, d):
    return agg.point_statistics(I.fx_datapoints(spark, d))


TWICE = """SELECT resource_id, metric, ordinal, unit, description FROM fx_catalogue UNION ALL
SELECT resource_id, metric, ordinal + 10, concat(unit, '/s'), description FROM fx_catalogue WHERE ordinal <= 2"""


@query("ag_10", f"SELECT * FROM ({TWICE}) QUALIFY row_number() OVER (PARTITION BY resource_id, metric ORDER BY ordinal DESC) = 1", "fx_catalogue")
def ag_10(spark, d):
    rows = I.fx_catalogue(spark, d).select("resource_id", "metric", "ordinal", "unit", "description")
    again = rows.filter("ordinal <= 2").withColumn("ordinal", F.col("ordinal") + 10).withColumn("unit", F.concat("unit", F.lit("/s")))
    both = rows.unionByName(again).withColumn("seen_at_us", F.lit(0).cast("bigint"))
    return agg.unique_definitions(both).select("resource_id", "metric", "ordinal", "unit", "description")


@query("ag_11", f"SELECT region, count(*) AS discovered, least(count(*), {S.KEPT}) AS kept FROM eligible WHERE {S.RULES} GROUP BY region", "eligible")
def ag_11(spark, d):
    return inventory.statistics_of_discovery(I.flat_instances(spark, d), *I.INSTANCE_RULES, S.KEPT)


@query("ag_12", "SELECT statement, digest, " + ", ".join(f"round({f}(value) FILTER (name = 'dbi_ams_{n}'), 6) AS {k}" for k, (n, f) in FIVE.items())
       + " FROM statement_samples WHERE starts_with(name, 'dbi_ams_') GROUP BY statement, digest", "statement_samples")
def ag_12(spark, d):
    names = {k: (f"dbi_ams_{n}", f) for k, (n, f) in FIVE.items()}
    return X.rounded(vector.sample_table(X.statement_samples(spark, d), names), *FIVE)


@query("ag_13", "SELECT resource_id, dim_group, dim_id, round(load, 6) AS load, rn FROM dim_ranked WHERE rn <= 3", "dim_ranked")
def ag_13(spark, d):
    ranked = dimensions.top_load(dimensions.load_by_dimension(X.recent_dims(spark, d), NOW), 3)
    ident = F.coalesce(F.try_element_at("dims", F.lit("db.sql_tokenized.id")), F.try_element_at("dims", F.lit("db.wait_event.name")))
    return X.rounded(X.big(ranked, "rn"), "load").select("resource_id", "dim_group", ident.alias("dim_id"), "load", "rn")


# ---- windows -------------------------------------------------------------------------------------------

@query("wn_1", """SELECT resource_id, metric, value, ts_us, pos, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id, metric ORDER BY ts_us DESC, pos DESC) AS rn FROM valid_points) WHERE rn <= 3""", "valid_points")
def wn_1(spark, d):
    return X.big(latest_n(I.fx_datapoints(spark, d), 3), "rn")


@query("wn_1_nested", """SELECT resource_id, metric, slot, value, ts_us, rn FROM (
  SELECT *, ts_us // 180000000 AS slot, row_number() OVER (PARTITION BY resource_id, metric, ts_us // 180000000 ORDER BY ts_us DESC, pos DESC) AS rn FROM valid_points) WHERE rn <= 3""", "valid_points")
def wn_1_nested(spark, d):
    """Responses of three minutes each, cut to their newest three points as they lie; exploded only to be compared."""
    points = I.fx_datapoints(spark, d).filter("ts_us IS NOT NULL").withColumn("slot", F.floor(F.col("ts_us") / 180_000_000))
    inside = F.transform(F.sort_array(F.collect_list(F.struct("pos", "ts_us", "value"))),
                         lambda p: F.struct(F.timestamp_micros(p["ts_us"]).alias("Timestamp"), p["value"].alias("Value")))
    responses = points.groupBy("resource_id", "metric", "slot").agg(inside.alias("DataPoints"))
    rows = newest_in_responses(responses, 3).select("resource_id", "metric", "slot", F.posexplode("DataPoints").alias("at", "p"))
    return rows.select("resource_id", "metric", "slot", F.col("p.Value").alias("value"), F.unix_micros("p.Timestamp").alias("ts_us"), (F.col("at") + 1).cast("bigint").alias("rn"))


@query("wn_2", """SELECT resource_id, metric, value, ts_us FROM valid_points
QUALIFY row_number() OVER (PARTITION BY resource_id, metric ORDER BY ts_us DESC, pos DESC) = 1""", "valid_points")
def wn_2(spark, d):
    return latest_valid(I.fx_datapoints(spark, d))


@query("wn_3", """SELECT resource_id, metric, max(value) FILTER (rn = 1) AS value, max(ts_us) AS ts_us,
  CASE WHEN count(*) = 2 THEN max(ts_us) - min(ts_us) ELSE 0 END AS dynamic_ttl_us FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id, metric ORDER BY ts_us DESC, pos DESC) AS rn FROM valid_points) WHERE rn <= 2
GROUP BY resource_id, metric""", "valid_points")
def wn_3(spark, d):
    return latest_with_interval(I.fx_datapoints(spark, d))


@query("wn_4", f"""SELECT region, resource_id, creation_us, age_rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY creation_us, identifier)
  AS age_rank FROM eligible) WHERE age_rank <= {S.KEPT}""", "eligible")
def wn_4(spark, d):
    rows = oldest_instances(X.eligible(spark, d), S.KEPT)
    return X.big(rows, "age_rank").select("region", "resource_id", "creation_us", "age_rank")


RANKS = """SELECT *, row_number() OVER (PARTITION BY resource_id, family ORDER BY avg_duration_ms DESC, digest, digest_text) AS rn_duration,
  row_number() OVER (PARTITION BY resource_id, family ORDER BY calls DESC, digest, digest_text) AS rn_calls FROM stats"""


def _stats(spark, d):
    return st.statement_stats(I.fx_mysql_digests(spark, d), I.fx_pg_statements(spark, d))


@query("wn_5", f"""WITH r AS ({RANKS}) SELECT resource_id, family, digest, 'duration' AS ranking, rn_duration AS rank FROM r WHERE rn_duration <= 5
UNION ALL SELECT resource_id, family, digest, 'calls', rn_calls FROM r WHERE rn_calls <= 5""".replace("WITH r AS", "SELECT * FROM (WITH r AS") + ")", "stats")
def wn_5(spark, d):
    ranking = F.when(F.col("source") == 0, "duration").otherwise("calls")
    return X.big(st.ranked_lists(_stats(spark, d), 5), "rank").select("resource_id", "family", "digest", ranking.alias("ranking"), "rank")


@query("wn_6", f"""SELECT resource_id, family, digest, calls, CASE WHEN rn_duration <= 5 THEN 'duration' ELSE 'calls' END AS rank_source,
  CASE WHEN rn_duration <= 5 THEN rn_duration ELSE rn_calls END AS rank FROM ({RANKS}) WHERE rn_duration <= 5 OR rn_calls <= 5
QUALIFY row_number() OVER (PARTITION BY resource_id, family, digest ORDER BY CASE WHEN rn_duration <= 5 THEN 0 ELSE 1 END,
  CASE WHEN rn_duration <= 5 THEN rn_duration ELSE rn_calls END) = 1""", "stats")
def wn_6(spark, d):
    rows = st.top_per_instance(_stats(spark, d), 5)
    return X.big(rows, "rank").select("resource_id", "family", "digest", "calls", "rank_source", "rank")


# ---- sorts ---------------------------------------------------------------------------------------------

@query("so_1", "SELECT resource_id, family, digest, calls FROM stats ORDER BY calls DESC, resource_id, family, digest, digest_text LIMIT 20", "stats")
def so_1(spark, d):
    order = [F.desc("calls"), "resource_id", "family", "digest", "digest_text"]
    return _stats(spark, d).orderBy(*order).limit(20).select("resource_id", "family", "digest", "calls")


@query("so_2", "SELECT region, resource_id, identifier, creation_us FROM eligible ORDER BY creation_us, identifier, resource_id LIMIT 25", "eligible")
def so_2(spark, d):
    rows = X.eligible(spark, d).orderBy("creation_us", "identifier", "resource_id").limit(25)
    return rows.select("region", "resource_id", "identifier", "creation_us")


@query("so_3", f"""SELECT statement, digest, round(sum(value), 6) AS calls FROM statement_samples WHERE {_statement('_query_calls_total')}
GROUP BY statement, digest ORDER BY calls DESC, digest""", "statement_samples")
def so_3(spark, d):
    rows = X.statement_samples(spark, d).filter(F.col("name").endswith("_query_calls_total"))
    table = X.rounded(vector.by_labels(rows, ["statement", "digest"], "sum"), "value").withColumnRenamed("value", "calls")
    return table.orderBy(F.desc("calls"), "digest")


@query("so_4", "SELECT name, count(*) AS samples FROM exposition GROUP BY name ORDER BY name", "exposition")
def so_4(spark, d):
    return X.exposition(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("samples")).orderBy("name")


# ---- set operations ------------------------------------------------------------------------------------

@query("set_1", "SELECT region, resource_id, identifier, 'folders' AS origin FROM eligible UNION ALL SELECT region, resource_id, identifier, 'union' FROM eligible", "eligible")
def set_1(spark, d):
    """All regions: their folders in one scan, and dumps of single regions united."""
    path = I.dumped(I.raw_instances(spark, d), "set-1", "json", "region")
    whole = readers.read_instances(spark, path)
    regions = [r.region for r in I.table(spark, d, "region").select(F.col("r_name").alias("region")).collect()]
    single = [readers.read_instances(spark, f"{path}/region={region}", region=region) for region in regions]
    united = reduce(lambda a, b: a.unionByName(b), single)
    rows = [inventory.discovered_instances(f).withColumn("origin", F.lit(o)) for f, o in ((whole, "folders"), (united, "union"))]
    return rows[0].unionByName(rows[1]).select("region", "resource_id", "identifier", "origin")


@query("set_2", "SELECT * FROM exposition", "exposition")
def set_2(spark, d):
    return X.rounded(X.exposition(spark, d), "value").select(*EXPOSITION)


@query("set_3", f"""SELECT q.resource_id, q.metric, f.value, f.ts_us, 'store' AS origin FROM {REQUESTED} q JOIN (SELECT * FROM fresh WHERE NOT expired) f USING (resource_id, metric)
UNION ALL SELECT q.resource_id, q.metric, l.value, l.ts_us, 'fetched' FROM {REQUESTED} q JOIN latest l USING (resource_id, metric)
WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE NOT expired AND f.resource_id = q.resource_id AND f.metric = q.metric)""", "catalogue", "fresh", "latest")
def set_3(spark, d):
    keys = ["resource_id", "metric"]
    requested, fresh = _requested(spark, d), _fresh(spark, d)
    columns = [*keys, "value", "ts_us"]
    served = lookups.hits(requested, fresh, keys, NOW).select(*columns, F.lit("store").alias("origin"))
    fetched = lookups.misses(requested, fresh, keys, NOW).join(X.latest(spark, d), keys)
    return served.unionByName(fetched.select(*columns, F.lit("fetched").alias("origin")))


@query("set_4", "SELECT region, resource_id, ordinal, metric, description, unit FROM cat_all", "cat_all")
def set_4(spark, d):
    rows = cat.with_load_metric(cat.of_instances(I.fx_catalogue(spark, d), X.fleet(spark, d)))
    return rows.select("region", "resource_id", "ordinal", "metric", "description", "unit").distinct()


@query("set_5", "SELECT * FROM stats", "stats")
def set_5(spark, d):
    return _stats(spark, d)
