"""SQL that must give the same rows as the Spark plans: shared pieces as common table expressions."""

from __future__ import annotations

from fleetlens.queries import inputs as I

NOW, START = I.NOW_US, I.START_US
LOOKBACK = 180_000_000
SEP = "chr(1)"


def engine(c: str) -> str:
    return (
        f"CASE WHEN {c} IN ('aurora-postgresql', 'aurora-mysql', 'postgres', 'mysql', 'mariadb') THEN {c} "
        f"WHEN contains(lower({c}), 'oracle') THEN 'oracle' WHEN contains(lower({c}), 'sqlserver') THEN 'sqlserver' ELSE '' END"
    )


def short(c: str) -> str:
    return (
        f"CASE {c} WHEN 'aurora-postgresql' THEN 'apg' WHEN 'aurora-mysql' THEN 'ams' WHEN 'postgres' THEN 'pg' "
        f"WHEN 'mysql' THEN 'mysql' WHEN 'mariadb' THEN 'mariadb' WHEN 'oracle' THEN 'oracle' "
        f"WHEN 'sqlserver' THEN 'sqlserver' ELSE '' END"
    )


def base(c: str) -> str:
    return f"regexp_extract({c}, '^(.+)\\.(avg|min|max|sum)$', 1)"


def stat(c: str) -> str:
    return f"regexp_extract({c}, '^(.+)\\.(avg|min|max|sum)$', 2)"


def category(c: str) -> str:
    return f"CASE WHEN starts_with({c}, 'os.') THEN 'os' WHEN starts_with({c}, 'db.') THEN 'db' ELSE 'other' END"


def sanitized(c: str) -> str:
    return f"lower(regexp_replace(replace({c}, '.', '_'), '[^a-zA-Z0-9_:]', '', 'g'))"


def emitted(eng: str, metric: str) -> str:
    return (
        f"concat('dbi', CASE WHEN starts_with({metric}, 'db.') THEN concat('_', {short(eng)}) ELSE '' END, '_', "
        f"{sanitized(metric)})"
    )


def truncated(c: str, n: int = 200) -> str:
    return f"CASE WHEN length({c}) > {n} THEN concat(left({c}, {n}), '...') ELSE {c} END"


def colour(v: str, steps) -> str:
    parts = " ".join(
        f"WHEN {v} IS NOT NULL THEN '{c}'" if bound is None else f"WHEN {v} >= {bound} THEN '{c}'"
        for bound, c in reversed(steps)
    )
    return f"CASE {parts} END"


def ttl(metric: str) -> str:
    parts = " ".join(f"WHEN regexp_matches({metric}, '{p}') THEN {t}" for _, p, t in I.TTL_RULES)
    return f"CAST(CASE {parts} ELSE 0 END AS BIGINT)"


def number(c: str) -> str:
    """Shortest decimal form with an exponent from 1e6 on and below 1e-4."""
    digits = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(CAST(abs({c}) AS VARCHAR), 'e.*', ''), '\\.0$', ''), '\\.', ''), '^0+', '')"
    mantissa = f"regexp_replace({digits}, '0+$', '')"
    exponent = f"CAST(floor(log10(abs({c}))) AS INTEGER)"
    fraction = f"CASE WHEN length({mantissa}) > 1 THEN concat('.', substr({mantissa}, 2)) ELSE '' END"
    sign = f"CASE WHEN {c} < 0 THEN '-' ELSE '' END"
    power = f"concat(CASE WHEN {exponent} < 0 THEN '-' ELSE '+' END, lpad(CAST(abs({exponent}) AS VARCHAR), 2, '0'))"
    return (
        f"CASE WHEN {c} = 0 THEN '0' WHEN abs({c}) >= 1e6 OR abs({c}) < 1e-4 "
        f"THEN concat({sign}, left({mantissa}, 1), {fraction}, 'e', {power}) "
        f"ELSE regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '') END"
    )


LABELS = ("cluster_identifier", "digest", "engine", "identifier", "region", "statement", "unit", "wait_event", "wait_type")


def label_text(names) -> str:
    def escaped(n: str) -> str:
        return f"replace(replace(replace({n}, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(34), chr(92) || chr(34))"

    pairs = [f"CASE WHEN {n} IS NOT NULL THEN concat('{n}=\"', {escaped(n)}, '\"') END" for n in sorted(names)]
    return f"concat('{{', concat_ws(',', {', '.join(pairs)}), '}}')"


def _fixture(text: str) -> str:
    text = text.replace("$US_TS", "epoch_us(ts)").replace("$ROWS", '"rows"').replace("$EACH_METRIC", I.EACH_METRIC["check"])
    names = {n: n for n in (*I.TABLES, "fx_instances")}
    return text.format(**names)


DEFECT = f"""CASE WHEN engine_raw IS NULL THEN 'missing_engine' WHEN status IS NULL THEN 'missing_status'
  WHEN resource_id IS NULL THEN 'missing_resource_id' WHEN identifier IS NULL THEN 'missing_identifier'
  WHEN creation_us IS NULL THEN 'missing_creation_time' WHEN NOT insights_enabled THEN 'insights_disabled'
  WHEN engine = '' THEN 'unknown_engine' WHEN resource_id = '' OR identifier = '' THEN 'empty_identity' END"""
# the instance rules of the fixtures, spelled out
RULES = """regexp_matches(identifier, '^customer-') AND (regexp_matches(engine, 'postgres') OR regexp_matches(engine, 'mysql'))
  AND coalesce(regexp_matches(tag_team, 'team[0-3]'), false) AND NOT regexp_matches(identifier, '7$')
  AND NOT coalesce(regexp_matches(tag_environment, '^MACHINERY$'), false)"""
KEPT = 25

# name -> (names it reads, text)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_instances": ((), _fixture(I.FX_INSTANCES)),
    "fx_datapoints": ((), _fixture(I.FX_DATAPOINTS)),
    "fx_dim_datapoints": ((), _fixture(I.FX_DIM_DATAPOINTS)),
    "fx_catalogue": (("fx_instances",), _fixture(I.FX_CATALOGUE)),
    "fx_mysql_digests": ((), _fixture(I.FX_MYSQL_DIGESTS)),
    "fx_pg_statements": ((), _fixture(I.FX_PG_STATEMENTS)),
    "fx_board": (("fx_instances",), _fixture(I.FX_BOARD)),
    "flat": (("fx_instances",), f"""
SELECT region, resource_id, identifier, cluster_identifier, coalesce(endpoint_address, '') AS endpoint,
  CAST(coalesce(endpoint_port, 0) AS INTEGER) AS port, engine_raw, {engine('engine_raw')} AS engine, status,
  coalesce(insights_enabled, false) AS insights_enabled, CAST(creation_us AS BIGINT) AS creation_us, tag_environment, tag_team
FROM fx_instances"""),
    "eligible": (("flat",), f"SELECT * FROM flat WHERE ({DEFECT}) IS NULL"),
    # every usable instance, without rules and without a cap
    "fleet": (("eligible",), "SELECT * FROM eligible"),
    "kept": (("eligible",), f"""
SELECT * FROM eligible WHERE {RULES}
QUALIFY row_number() OVER (PARTITION BY region ORDER BY creation_us, identifier) <= {KEPT}"""),
    "valid_points": (("fx_datapoints",), "SELECT * FROM fx_datapoints WHERE value IS NOT NULL AND ts_us IS NOT NULL"),
    "recent": (("fx_datapoints",), f"SELECT * FROM fx_datapoints WHERE ts_us BETWEEN {NOW - LOOKBACK} AND {NOW}"),
    "latest": (("recent",), """
SELECT resource_id, metric, value, ts_us FROM recent WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY resource_id, metric ORDER BY ts_us DESC, pos DESC) = 1"""),
    "newest_two": (("recent",), """
SELECT resource_id, metric, value, ts_us, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY resource_id, metric ORDER BY ts_us DESC, pos DESC) AS rn
  FROM recent WHERE value IS NOT NULL) WHERE rn <= 2"""),
    "fresh": (("newest_two",), f"""
SELECT *, ts_us + ttl_us AS expires_at_us, {NOW} > ts_us + ttl_us AS expired FROM (
  SELECT *, greatest({ttl('metric')}, dynamic_ttl_us) AS ttl_us FROM (
    SELECT resource_id, metric, max(value) FILTER (rn = 1) AS value, max(ts_us) FILTER (rn = 1) AS ts_us,
      coalesce(greatest(max(ts_us) FILTER (rn = 1) - max(ts_us) FILTER (rn = 2), 0), 0) AS dynamic_ttl_us
    FROM newest_two GROUP BY resource_id, metric)) WHERE ttl_us > 0"""),
    "cat_rows": (("fx_catalogue", "fleet"), f"""
SELECT region, resource_id, engine, ordinal, metric, description, unit
FROM fx_catalogue JOIN fleet USING (resource_id) WHERE lower(metric) LIKE 'os.%' OR lower(metric) LIKE 'db.%'"""),
    "cat_all": (("cat_rows",), """
SELECT * FROM cat_rows UNION ALL
SELECT DISTINCT region, resource_id, engine, -1, 'db.load',
  'Database load (DB load) measures the level of session activity in your database', 'Average Active Sessions' FROM cat_rows"""),
    "cat_chosen": (("cat_all",), """
SELECT *, CASE WHEN metric = 'db.SQL.queries' THEN ['avg', 'max'] ELSE ['avg'] END AS statistics FROM cat_all
WHERE metric IS NOT NULL AND description IS NOT NULL AND unit IS NOT NULL AND NOT regexp_matches(metric, '\\.idle$')"""),
    "canonical": (("cat_chosen",), """
SELECT region, engine, lower(metric) AS metric_lower, first(description ORDER BY ordinal, resource_id) AS canonical_description
FROM cat_chosen GROUP BY ALL"""),
    "catalogue": (("cat_chosen", "canonical"), f"""
SELECT c.region, c.resource_id, c.engine, c.metric, k.canonical_description AS description, c.unit, c.statistics
FROM (SELECT * FROM cat_chosen QUALIFY row_number() OVER (PARTITION BY region, resource_id, metric ORDER BY ordinal DESC) = 1) c
JOIN canonical k ON c.region = k.region AND c.engine = k.engine AND lower(c.metric) = k.metric_lower
WHERE (regexp_matches(c.metric, '^db\\.') OR regexp_matches(c.metric, '^os\\.') OR regexp_matches(c.metric, 'db.SQL.queries.max'))
  AND (regexp_matches({category('c.metric')}, 'os') OR regexp_matches({category('c.metric')}, 'db'))
  AND NOT regexp_matches(c.metric, '\\.idle$')"""),
    "counters": (("latest", "catalogue", "fleet"), f"""
SELECT {emitted('f.engine', 'l.metric')} AS name, c.description AS help, f.identifier, f.cluster_identifier, f.region, f.engine,
  c.unit, l.value, l.ts_us
FROM latest l JOIN catalogue c ON l.resource_id = c.resource_id AND {base('l.metric')} = c.metric
JOIN fleet f ON l.resource_id = f.resource_id WHERE list_contains(c.statistics, {stat('l.metric')})"""),
    "dim_minutes": (("fx_dim_datapoints",), f"""
SELECT resource_id, dim_group, dim_id, dim_text, ts_us // 60000000 * 60000000 AS period_us, sum(value) AS total, count(value) AS n
FROM fx_dim_datapoints WHERE ts_us BETWEEN {NOW - LOOKBACK} AND {NOW} AND dim_id IS NOT NULL AND value IS NOT NULL
  AND dim_group IN ('db.sql_tokenized', 'db.wait_event') GROUP BY ALL"""),
    "dim_loads": (("dim_minutes",), """
SELECT resource_id, dim_group, dim_id, dim_text, sum(total) / sum(n) AS load, arg_max(total / n, period_us) AS value,
  max(period_us) AS ts_us FROM dim_minutes GROUP BY ALL"""),
    "dim_ranked": (("dim_loads",), f"""
SELECT *, row_number() OVER (PARTITION BY resource_id, dim_group ORDER BY load DESC, concat_ws({SEP}, dim_id, dim_text)) AS rn
FROM dim_loads"""),
    "dim_samples": (("dim_ranked", "fleet"), f"""
SELECT concat('dbi_', {short('engine')}, CASE dim_group WHEN 'db.wait_event' THEN '_wait_event_load_avg' ELSE '_top_sql_load_avg' END) AS name,
  concat('Top database load by ', dim_group) AS help, identifier, cluster_identifier, region, engine,
  CASE WHEN dim_group = 'db.sql_tokenized' THEN dim_id END AS digest,
  CASE WHEN dim_group = 'db.sql_tokenized' THEN {truncated('dim_text')} END AS statement,
  CASE WHEN dim_group = 'db.wait_event' THEN dim_id END AS wait_event,
  CASE WHEN dim_group = 'db.wait_event' THEN dim_text END AS wait_type, round(value, 6) AS value, ts_us
FROM dim_ranked JOIN fleet USING (resource_id) WHERE rn <= 10"""),
    "stats": (("fx_mysql_digests", "fx_pg_statements"), """
SELECT resource_id, 'mysql' AS family, digest, coalesce(left(digest_text, 200), '') AS digest_text, count_star AS calls,
  CAST(avg_timer_wait AS DOUBLE) / 1e9 AS avg_duration_ms, CAST(sum_lock_time AS DOUBLE) / 1e12 AS sum_lock_time_ms,
  sum_rows_examined AS rows_examined, sum_rows_sent AS rows_sent, sum_errors AS errors
FROM fx_mysql_digests WHERE digest IS NOT NULL AND schema_name IS NOT NULL
UNION ALL
SELECT resource_id, 'postgres', CAST(queryid AS VARCHAR), coalesce(left(query, 200), ''), calls, mean_exec_time,
  coalesce(blk_read_time, 0) + coalesce(blk_write_time, 0), "rows", "rows", CAST(0 AS BIGINT)
FROM fx_pg_statements WHERE queryid IS NOT NULL"""),
    "policy": ((), "SELECT * FROM (VALUES (0, 'nation_1', 3), (1, 'nation_2', 10), (2, 'nation_3', 60), (3, '', 5), (4, '', 7)) AS p(ordinal, cluster, top_n)"),
    "policied": (("fleet", "policy"), """
SELECT f.*, coalesce((SELECT arg_min(top_n, ordinal) FROM policy WHERE cluster = f.cluster_identifier),
  (SELECT arg_max(top_n, ordinal) FROM policy WHERE cluster = '')) AS top_n FROM fleet f"""),
    "sources": (("policied",), """
SELECT *, CASE WHEN engine IN ('mysql', 'aurora-mysql', 'mariadb') THEN 'mysql' WHEN engine IN ('postgres', 'aurora-postgresql') THEN 'postgres' END AS family
FROM policied WHERE endpoint <> '' AND port <> 0 AND engine IN ('mysql', 'aurora-mysql', 'mariadb', 'postgres', 'aurora-postgresql')"""),
    "stat_ranks": (("stats", "sources"), """
SELECT s.*, o.identifier, o.cluster_identifier, o.region, o.engine, o.top_n,
  row_number() OVER (PARTITION BY s.resource_id, s.family ORDER BY avg_duration_ms DESC, digest, digest_text) AS rn_duration,
  row_number() OVER (PARTITION BY s.resource_id, s.family ORDER BY calls DESC, digest, digest_text) AS rn_calls
FROM stats s JOIN sources o ON s.resource_id = o.resource_id AND s.family = o.family"""),
    "top_stats": (("stat_ranks",), """
SELECT * FROM stat_ranks WHERE rn_duration <= top_n OR rn_calls <= top_n
QUALIFY row_number() OVER (PARTITION BY resource_id, family, digest ORDER BY CASE WHEN rn_duration <= top_n THEN 0 ELSE 1 END,
  CASE WHEN rn_duration <= top_n THEN rn_duration ELSE rn_calls END) = 1"""),
    "statement_samples": (("top_stats",), f"""
SELECT concat('dbi_', {short('t.engine')}, '_', m.suffix) AS name, m.help AS help, identifier, cluster_identifier, region, engine, digest,
  {truncated('digest_text')} AS statement, CAST(NULL AS BIGINT) AS ts_us,
  CAST(CASE m.i WHEN 0 THEN calls WHEN 1 THEN avg_duration_ms WHEN 2 THEN sum_lock_time_ms WHEN 3 THEN rows_examined
    WHEN 4 THEN rows_sent ELSE errors END AS DOUBLE) AS value
FROM top_stats t CROSS JOIN (VALUES (0, 'query_calls_total', 'Total number of times this query has been executed'),
  (1, 'query_avg_duration_ms', 'Average execution duration in milliseconds'), (2, 'query_lock_time_ms', 'Total lock time in milliseconds'),
  (3, 'query_rows_examined_total', 'Total rows examined'), (4, 'query_rows_sent_total', 'Total rows sent to client'),
  (5, 'query_errors_total', 'Total errors')) AS m(i, suffix, help)"""),
    "exposition": (("counters", "dim_samples", "statement_samples"), """
SELECT * REPLACE (round(value, 6) AS value) FROM (
SELECT name, help, identifier, cluster_identifier, region, engine, unit, NULL AS digest, NULL AS statement, NULL AS wait_event,
  NULL AS wait_type, value, ts_us FROM counters
UNION ALL SELECT name, help, identifier, cluster_identifier, region, engine, NULL, digest, statement, wait_event, wait_type, value, ts_us FROM dim_samples
UNION ALL SELECT name, help, identifier, cluster_identifier, region, engine, NULL, digest, statement, NULL, NULL, value, ts_us FROM statement_samples)"""),
    "published": (("fx_board", "statement_samples"), """
SELECT name, identifier, cluster_identifier, region, engine, unit, NULL AS digest, NULL AS statement, value, ts_us FROM fx_board
UNION ALL SELECT name, identifier, cluster_identifier, region, engine, NULL, digest, statement, value, NULL FROM statement_samples"""),
    "board_now": (("fx_board",), f"""
SELECT name, identifier, cluster_identifier, region, engine, unit, value, ts_us FROM fx_board WHERE ts_us <= {NOW} AND ts_us > {NOW - 300_000_000}
QUALIFY row_number() OVER (PARTITION BY name, identifier, cluster_identifier, region, engine, unit ORDER BY ts_us DESC, value DESC) = 1"""),
    "grid": ((), f"SELECT {NOW - 3_600_000_000} + i * 60000000 AS at_us FROM range(61) AS r(i)"),
    "board_grid": (("fx_board", "grid"), """
SELECT name, identifier, cluster_identifier, region, engine, unit, at_us, arg_max(value, (ts_us, value)) AS value, max(ts_us) AS ts_us
FROM fx_board JOIN grid ON ts_us <= at_us AND ts_us > at_us - 300000000
GROUP BY name, identifier, cluster_identifier, region, engine, unit, at_us"""),
}


def with_parts(select: str, *names: str) -> str:
    """``select`` behind the parts it reads, each once, in an order in which none is used before it is defined."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in PARTS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in ordered)
    return f"WITH {'RECURSIVE ' if 'walk' in ordered else ''}{parts}\n{select}" if ordered else select
