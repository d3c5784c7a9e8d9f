"""Sources, sinks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import functions as fn
from fleetlens.operators import vector
from fleetlens.operators.asof import instant
from fleetlens.operators.lookups import with_base
from fleetlens.operators.predicates import mysql_digest_usable, pg_statement_usable
from fleetlens.plans.catalogue import requested_series
from fleetlens.plans.statements import mysql_statement_stats, pg_statement_stats
from fleetlens.queries import check_sql as S, frames as X, inputs as I
from fleetlens.queries.registry import query
from fleetlens.schemas import COUNTER_LABELS, EXPOSITION
from fleetlens.session import scratch_dir
from fleetlens.sources import readers, writers



def _tags():
    return [F.try_element_at("tags", F.lit(key)).alias(key.lower()) for key in ("Environment", "Team")]


# ---- sources -------------------------------------------------------------------------------------------

@query("src_1", """
SELECT region, resource_id, identifier, cluster_identifier, endpoint, port, engine_raw, status, insights_enabled, creation_us,
  CASE WHEN resource_id LIKE '%0' THEN 'renamed' ELSE tag_environment END AS environment, tag_team AS team FROM flat""", "flat")
def src_1(spark, d):
    """A folder of JSON dumps per region, read in one scan."""
    path = I.dumped(I.raw_instances(spark, d), "src-1", "json", "region")
    return readers.read_instances(spark, path, origin=["region"]).select("*", *_tags()).drop("tags")


# Regions and times of fetching for fixtures that have none: resource ids repeat in both regions.
REGIONS = ("east", "west")


def _twice(df, fetched=False):
    """Each record once per region, fetched an hour later in the second one."""
    rows = df.withColumn("region", F.explode(F.array(*[F.lit(r) for r in REGIONS])))
    later = F.when(F.col("region") == REGIONS[1], F.lit(I.START_US + 3_600_000_000)).otherwise(F.lit(I.START_US))
    return rows.withColumn("fetched_at_us", later.cast("bigint")) if fetched else rows


TWICE = "(VALUES ('east', CAST({0} AS BIGINT)), ('west', CAST({0} + 3600000000 AS BIGINT))) AS o(region, seen_at_us)".format(I.START_US)


@query("src_2", f"SELECT region, seen_at_us, resource_id, ordinal, metric, description, unit FROM fx_catalogue CROSS JOIN {TWICE}", "fx_catalogue")
def src_2(spark, d):
    """JSON records that name their region and time of fetching."""
    path = I.dumped(_twice(I.raw_catalogue(spark, d), fetched=True), "src-2", "json")
    return readers.read_catalogue(spark, path, origin=["region", "fetched_at_us"]).withColumn("ordinal", F.col("ordinal") + 1)


def _responses(df, *keep):
    """Each datapoint as a response of its own, followed by one without a value; some series have no key."""
    point = lambda ts, v: F.struct(F.timestamp_micros(ts).alias("Timestamp"), v.alias("Value"))
    empty = point(F.col("ts_us") + 1_000_000, F.lit(None).cast("double"))
    points = F.when(F.col("pos") % 19 == 0, F.array().cast("array<struct<Timestamp:timestamp,Value:double>>"))
    dims = F.col("dims") if "dims" in df.columns else F.lit(None).cast("map<string,string>")
    key = F.when(F.col("pos") % 23 != 0, F.struct(F.col("metric").alias("Metric"), dims.alias("Dimensions")))
    return df.select(*keep, key.alias("Key"), points.otherwise(F.array(point(F.col("ts_us"), F.col("value")), empty)).alias("DataPoints"))


RESPONSES = """
FROM (SELECT *, CASE WHEN pos % 19 = 0 THEN [NULL] ELSE [0, 1] END AS entries FROM {fx}), unnest(entries) AS u(i)"""
POINT = """CASE WHEN pos % 23 <> 0 THEN metric END AS metric, CAST(i AS BIGINT) AS pos,
  CASE i WHEN 0 THEN ts_us WHEN 1 THEN ts_us + 1000000 END AS ts_us, CASE i WHEN 0 THEN value END AS value"""


@query("src_3", f"SELECT region, resource_id, {POINT}" + RESPONSES.format(fx="fx_datapoints") + f" CROSS JOIN {TWICE}", "fx_datapoints")
def src_3(spark, d):
    """JSON in region folders, both read in one scan."""
    path = I.dumped(_twice(_responses(I.fx_datapoints(spark, d), "resource_id")), "src-3", "json", "region")
    return readers.read_datapoints(spark, path, origin=["region"])


@query("src_4", f"""SELECT 'north' AS region, resource_id, dim_group, {POINT}, CASE WHEN pos % 23 <> 0 THEN dim_id END AS dim_id,
  CASE WHEN pos % 23 <> 0 THEN dim_text END AS dim_text""" + RESPONSES.format(fx="fx_dim_datapoints"), "fx_dim_datapoints")
def src_4(spark, d):
    path = I.dumped(_responses(I.dim_points(spark, d), "resource_id", "dim_group"), "src-4", "parquet")
    flat = readers.read_dim_datapoints(spark, path, "parquet", region="north", origin=[])

    def either(a, b):
        return F.coalesce(F.try_element_at("dims", F.lit(a)), F.try_element_at("dims", F.lit(b)))

    return flat.withColumn("dim_id", either("db.sql_tokenized.id", "db.wait_event.name")).withColumn(
        "dim_text", either("db.sql_tokenized.statement", "db.wait_event.type")).drop("dims")


@query("src_5", "SELECT region, f.* FROM fx_mysql_digests f CROSS JOIN " + TWICE, "fx_mysql_digests")
def src_5(spark, d):
    return readers.read_mysql_digests(spark, I.dumped(_twice(I.fx_mysql_digests(spark, d)), "src-5", "parquet", "region"), origin=["region"])


@query("src_6", "SELECT region, f.* FROM fx_pg_statements f CROSS JOIN " + TWICE, "fx_pg_statements")
def src_6(spark, d):
    """Statements of all instances, named by a column (a single system view's instance is named by the caller)."""
    return readers.read_pg_statements(spark, I.dumped(_twice(I.fx_pg_statements(spark, d)), "src-6", "parquet", "region"), origin=["region"])


@query("snk_1", "SELECT *, CASE WHEN ts_us IS NULL THEN 'undated' ELSE strftime(make_timestamp(ts_us), '%Y-%m-%d') END AS ds FROM exposition", "exposition")
def snk_1(spark, d):
    path = scratch_dir(spark, "snk-1")
    writers.write_samples(X.rounded(X.exposition(spark, d), "value"), path)
    return readers.read_samples(spark, path).select(*EXPOSITION, "ds")


S.PARTS["bare"] = (("exposition",), """
SELECT * REPLACE (CASE WHEN ends_with(name, '_query_errors_total') THEN NULL ELSE help END AS help) FROM exposition
WHERE digest IS NULL OR digest NOT LIKE '%7'""")


@query("snk_2", f"""
SELECT concat('# HELP ', name, ' ', coalesce(replace(min(help), chr(92), chr(92) || chr(92)), '')) AS value FROM bare GROUP BY name
UNION ALL SELECT DISTINCT concat('# TYPE ', name, ' gauge') FROM bare
UNION ALL SELECT concat(name, {S.label_text(S.LABELS)}, ' ', {S.number('value')},
  CASE WHEN ts_us IS NOT NULL THEN concat(' ', ts_us // 1000) ELSE '' END) FROM bare""", "bare")
def snk_2(spark, d):
    """One name without help, and samples without a value."""
    samples = X.rounded(X.exposition(spark, d), "value")
    no_value, no_help = F.coalesce(F.col("digest").endswith("7"), F.lit(False)), F.col("name").endswith("_query_errors_total")
    return writers.to_exposition_text(
        samples.withColumn("help", F.when(~no_help, F.col("help"))).withColumn("value", F.when(~no_value, F.col("value"))))


# ---- scalar functions ----------------------------------------------------------------------------------

@query("fn_1", "SELECT resource_id, engine_raw, engine FROM flat", "flat")
def fn_1(spark, d):
    return I.fx_instances(spark, d).select("resource_id", "engine_raw", fn.normalize_engine(F.col("engine_raw")).alias("engine"))


@query("fn_2", """SELECT resource_id, engine <> '' AS normalized_valid,
  engine_raw IN ('aurora-postgresql', 'aurora-mysql', 'postgres', 'mysql', 'mariadb', 'oracle', 'sqlserver') AS raw_valid FROM flat""", "flat")
def fn_2(spark, d):
    raw = F.col("engine_raw")
    return I.fx_instances(spark, d).select(
        "resource_id", fn.is_valid_engine(fn.normalize_engine(raw)).alias("normalized_valid"), fn.is_valid_engine(raw).alias("raw_valid"))


@query("fn_3", f"SELECT resource_id, engine, {S.short('engine')} AS short_name FROM flat", "flat")
def fn_3(spark, d):
    engine = fn.normalize_engine(F.col("engine_raw"))
    return I.fx_instances(spark, d).select("resource_id", engine.alias("engine"), fn.engine_short_name(engine).alias("short_name"))


SUFFIX = "CASE WHEN pos % 3 = 0 THEN upper(regexp_extract(metric, '[a-z]+$', 0)) ELSE regexp_extract(metric, '[a-z]+$', 0) END"


@query("fn_4", f"SELECT pos, text, CASE WHEN text IN ('avg', 'min', 'max', 'sum') THEN text ELSE '' END AS statistic FROM (SELECT pos, {SUFFIX} AS text FROM fx_datapoints)", "fx_datapoints")
def fn_4(spark, d):
    text = F.regexp_extract("metric", "[a-z]+$", 0)
    rows = I.fx_datapoints(spark, d).select("pos", F.when(F.col("pos") % 3 == 0, F.upper(text)).otherwise(text).alias("text"))
    return rows.withColumn("statistic", fn.parse_statistic(F.col("text")))


VARIANT = "CASE pos % 5 WHEN 0 THEN '.avg' WHEN 1 THEN concat(metric, '.min') WHEN 2 THEN concat(metric, 'x') WHEN 3 THEN 'sum' ELSE metric END"


@query("fn_5", f"SELECT pos, text, {S.base('text')} AS base, {S.stat('text')} AS statistic FROM (SELECT pos, {VARIANT} AS text FROM fx_datapoints)", "fx_datapoints")
def fn_5(spark, d):
    rows = I.fx_datapoints(spark, d).select("pos", F.expr(VARIANT).alias("text"))
    parts = fn.split_metric(F.col("text"))
    return rows.select("pos", "text", parts.base.alias("base"), parts.statistic.alias("statistic"))


@query("fn_6", "SELECT region, resource_id, metric, s AS statistic, concat(metric, '.', s) AS series FROM catalogue, unnest(statistics) AS u(s)", "catalogue")
def fn_6(spark, d):
    return requested_series(X.catalogue(spark, d)).select("region", "resource_id", "metric", "statistic", "series")


@query("fn_7", f"SELECT resource_id, ordinal, metric, {S.category('metric')} AS category FROM fx_catalogue", "fx_catalogue")
def fn_7(spark, d):
    return I.fx_catalogue(spark, d).select("resource_id", "ordinal", "metric", fn.metric_category(F.col("metric")).alias("category"))


@query("fn_8", f"SELECT doc_id, {S.sanitized('text')} AS sanitized FROM documents")
def fn_8(spark, d):
    return I.table(spark, d, "documents").select("doc_id", fn.sanitize(F.col("text")).alias("sanitized"))


@query("fn_9", f"SELECT pos, {S.emitted('engine', 'metric')} AS name FROM fx_datapoints JOIN flat USING (resource_id)", "fx_datapoints", "flat")
def fn_9(spark, d):
    engines = I.fx_instances(spark, d).select("resource_id", fn.normalize_engine(F.col("engine_raw")).alias("engine"))
    rows = I.fx_datapoints(spark, d).join(engines, "resource_id")
    return rows.select("pos", fn.emitted_name("dbi", F.col("engine"), F.col("metric")).alias("name"))


@query("fn_10", f"""
SELECT pos, concat('dbi_', {S.short('engine')}, CASE dim_group WHEN 'db.wait_event' THEN '_wait_event_load_avg' ELSE '_top_sql_load_avg' END) AS name,
  CASE WHEN dim_group = 'db.sql_tokenized' THEN coalesce(dim_id, '') END AS digest,
  CASE WHEN dim_group = 'db.wait_event' THEN coalesce(dim_id, '') END AS wait_event
FROM fx_dim_datapoints JOIN flat USING (resource_id)""", "fx_dim_datapoints", "flat")
def fn_10(spark, d):
    engines = I.fx_instances(spark, d).select("resource_id", fn.normalize_engine(F.col("engine_raw")).alias("engine"))
    rows = I.dim_points(spark, d).join(engines, "resource_id")
    group = F.col("dim_group")
    return rows.select(
        "pos", fn.dimension_sample_name("dbi", F.col("engine"), group).alias("name"),
        F.when(group == "db.sql_tokenized", fn.dimension_value(F.col("dims"), "db.sql_tokenized.id")).alias("digest"),
        F.when(group == "db.wait_event", fn.dimension_value(F.col("dims"), "db.wait_event.name")).alias("wait_event"))


@query("fn_11", f"""
SELECT doc_id, {S.truncated('text')} AS by_characters, CASE WHEN strlen(text) > 200 THEN
  concat(left(text, list_max(list_filter(range(201), lambda m: strlen(left(text, m)) <= 200))), '...') ELSE text END AS by_bytes FROM documents""")
def fn_11(spark, d):
    text = F.col("text")
    return I.table(spark, d, "documents").select(
        "doc_id", fn.truncate_label(text).alias("by_characters"), fn.truncate_label(text, by_bytes=True).alias("by_bytes"))


@query("fn_12", "SELECT resource_id, count_star, coalesce(digest, '') AS digest, coalesce(left(digest_text, 200), '') AS digest_text FROM fx_mysql_digests", "fx_mysql_digests")
def fn_12(spark, d):
    return I.fx_mysql_digests(spark, d).select(
        "resource_id", "count_star", fn.query_digest(F.col("digest")).alias("digest"), fn.statement_text(F.col("digest_text")).alias("digest_text"))


@query("fn_13", """SELECT resource_id, digest, CAST(avg_timer_wait AS DOUBLE) / 1e9 AS avg_duration_ms, CAST(sum_lock_time AS DOUBLE) / 1e12 AS sum_lock_time_ms,
  CAST(sum_lock_time AS DOUBLE) / 1e12 AS lock_time_s, CAST(sum_lock_time AS DOUBLE) / 1e9 AS lock_time_ms_true FROM fx_mysql_digests""", "fx_mysql_digests")
def fn_13(spark, d):
    lock = F.col("sum_lock_time")
    return I.fx_mysql_digests(spark, d).select(
        "resource_id", "digest", fn.wait_ms(F.col("avg_timer_wait")).alias("avg_duration_ms"), fn.lock_time_ms(lock).alias("sum_lock_time_ms"),
        fn.lock_time_ms(lock).alias("lock_time_s"), fn.lock_time_ms_true(lock).alias("lock_time_ms_true"))


@query("fn_14", """SELECT resource_id, digest, sum_lock_time_ms, rows_examined, rows_sent, errors FROM stats WHERE family = 'postgres'""", "stats")
def fn_14(spark, d):
    return pg_statement_stats(I.fx_pg_statements(spark, d)).select("resource_id", "digest", "sum_lock_time_ms", "rows_examined", "rows_sent", "errors")


@query("fn_15", "SELECT resource_id, queryid, coalesce(CAST(queryid AS VARCHAR), '') AS digest FROM fx_pg_statements", "fx_pg_statements")
def fn_15(spark, d):
    return I.fx_pg_statements(spark, d).select("resource_id", "queryid", fn.query_digest(F.col("queryid")).alias("digest"))


@query("fn_16", """SELECT resource_id, CASE WHEN resource_id LIKE '%0' THEN 'renamed' ELSE tag_environment END AS environment, tag_team AS team,
  CAST(CASE WHEN tag_team IS NULL THEN 1 ELSE 2 END AS INTEGER) AS tags FROM flat""", "flat")
def fn_16(spark, d):
    rows = I.raw_instances(spark, d).select(F.col("DbiResourceId").alias("resource_id"), fn.tag_map(F.col("TagList")).alias("tags"))
    return rows.select("resource_id", *_tags(), F.size("tags").alias("tags"))


@query("fn_17", "SELECT resource_id, endpoint, port, cluster_identifier, insights_enabled FROM flat", "flat")
def fn_17(spark, d):
    return readers.flatten_instances(I.raw_instances(spark, d)).select("resource_id", "endpoint", "port", "cluster_identifier", "insights_enabled")


@query("fn_18", f"SELECT name, {S.label_text(COUNTER_LABELS)} AS labels, CAST(5 AS INTEGER) AS label_count FROM counters", "counters")
def fn_18(spark, d):
    return X.counters(spark, d).select(
        "name", writers.label_text(COUNTER_LABELS).alias("labels"), F.size(fn.label_map(COUNTER_LABELS)).alias("label_count"))


@query("fn_21", """
SELECT identifier, region, round((1 - a.value / nullif(b.value, 0)) * 100, 6) AS used FROM
  (SELECT * FROM board_now WHERE name = 'dbi_os_memory_free_avg') a JOIN
  (SELECT * FROM board_now WHERE name = 'dbi_os_memory_total_avg') b USING (identifier, cluster_identifier, region, engine, unit)""", "board_now")
def fn_21(spark, d):
    rows = instant(X.board(spark, d, X.NOW - 300_000_000, X.NOW), ["name", *COUNTER_LABELS], X.NOW)
    pairs = vector.pair_by_name(rows, COUNTER_LABELS, "dbi_os_memory_free_avg", "dbi_os_memory_total_avg")
    return pairs.select("identifier", "region", F.round(fn.percent_used(F.col("left_value"), F.col("right_value")), 6).alias("used"))


@query("fn_22", f"SELECT pos, value, {S.colour('value', I.GREEN_TO_RED)} AS colour, {S.colour('value', I.RED_TO_GREEN)} AS rising, {S.colour('value', I.GREEN_TO_RED)} AS from_steps FROM fx_datapoints", "fx_datapoints")
def fn_22(spark, d):
    value = F.col("value")
    steps = F.array(*[F.struct(F.lit(b).cast("double").alias("bound"), F.lit(c).alias("colour")) for b, c in I.GREEN_TO_RED])
    return I.fx_datapoints(spark, d).select(
        "pos", "value", fn.threshold_colour(value, I.GREEN_TO_RED).alias("colour"), fn.threshold_colour(value, I.RED_TO_GREEN).alias("rising"),
        fn.threshold_colour_from(value, steps).alias("from_steps"))


@query("fn_23", "SELECT resource_id, concat(identifier, ' read') AS read, identifier AS plain FROM flat", "flat")
def fn_23(spark, d):
    identifier = F.col("identifier")
    return I.fx_instances(spark, d).select("resource_id", fn.display_name(identifier, "read").alias("read"), fn.display_name(identifier).alias("plain"))


NAMES = "CASE pos % 5 WHEN 0 THEN concat('_', metric) WHEN 1 THEN replace(metric, '.', '_') WHEN 2 THEN '' WHEN 3 THEN concat('9', replace(metric, '.', ':')) ELSE replace(metric, '.', ':') END"


@query("fn_24", f"SELECT pos, text, regexp_matches(text, '^[a-zA-Z_:][a-zA-Z0-9_:]*$') AND NOT starts_with(text, '_') AS valid FROM (SELECT pos, {NAMES} AS text FROM fx_datapoints)", "fx_datapoints")
def fn_24(spark, d):
    return I.fx_datapoints(spark, d).select("pos", F.expr(NAMES).alias("text")).withColumn("valid", fn.is_valid_prefix(F.col("text")))


@query("fn_25", """SELECT pos, CASE WHEN dim_group = 'db.sql_tokenized' THEN coalesce(dim_id, '') ELSE '' END AS digest,
  CASE WHEN dim_group = 'db.wait_event' THEN coalesce(dim_id, '') ELSE '' END AS wait_event FROM fx_dim_datapoints""", "fx_dim_datapoints")
def fn_25(spark, d):
    dims = F.col("dims")
    return I.dim_points(spark, d).select(
        "pos", fn.dimension_value(dims, "db.sql_tokenized.id").alias("digest"), fn.dimension_value(dims, "db.wait_event.name").alias("wait_event"))


@query("fn_26", """SELECT pos, CAST(round(CAST(value AS DECIMAL(18, 6)), 0) AS DOUBLE) AS none, CAST(round(CAST(value AS DECIMAL(18, 6)), 1) AS DOUBLE) AS one,
  CAST(round(CAST(value AS DECIMAL(18, 6)), 2) AS DOUBLE) AS two FROM fx_datapoints""", "fx_datapoints")
def fn_26(spark, d):
    value = F.col("value")
    return I.fx_datapoints(spark, d).select(
        "pos", fn.panel_round(value, 0).alias("none"), fn.panel_round(value, 1).alias("one"), fn.panel_round(value, 2).alias("two"))
