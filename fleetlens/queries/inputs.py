"""Input tables derived from the star-schema files, as one SQL text for Spark and for the check.

Only three tokens differ: ``$US_TS`` (microseconds of ``ts``), ``$ROWS`` (a quoted column name) and
``$EACH_METRIC`` (each row once per catalogue entry, which Spark generates without a join).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.session import scratch_dir
from fleetlens.plans.dashboards import BOARDS, Series, Stat, Used

START_US = 1_704_067_200_000_000
NOW_US = 1_704_069_000_000_000
SQUEEZE = 1440
# Declared, so that reading a table starts no job that looks at file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
TABLES = tuple(SCHEMAS)

FX_INSTANCES = """
SELECT r_name AS region, concat('db-', c_custkey) AS resource_id,
  lower(replace(c_name, '#', '-')) AS identifier,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(n_name) END AS cluster_identifier,
  CASE c_custkey % 8 WHEN 0 THEN 'aurora-postgresql' WHEN 1 THEN 'aurora-mysql' WHEN 2 THEN 'postgres' WHEN 3 THEN 'mysql'
    WHEN 4 THEN 'mariadb' WHEN 5 THEN 'oracle-ee' WHEN 6 THEN 'SQLServer-se' ELSE 'docdb' END AS engine_raw,
  CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE 'available' END AS status,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 11 <> 0 END AS insights_enabled,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('h', c_custkey, '.example') END AS endpoint_address,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 3306 END AS endpoint_port,
  1577836800000000 + ((c_custkey * 37) % 997) * 86400000000 AS creation_us,
  c_mktsegment AS tag_environment,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('team', c_custkey % 6) END AS tag_team
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

FX_DATAPOINTS = """
SELECT concat('db-', user_id) AS resource_id,
  CASE event_type WHEN 'view' THEN 'os.cpuUtilization.total.avg' WHEN 'click' THEN 'db.SQL.queries.avg'
    WHEN 'purchase' THEN 'db.load.avg' WHEN 'signup' THEN 'os.memory.free.avg'
    ELSE 'db.Transactions.active_transactions.max' END AS metric,
  1704067200000000 + CAST(floor(($US_TS - 1704067200000000) / 1440) AS BIGINT) AS ts_us,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, event_id AS pos
FROM {events}"""

FX_DIM_DATAPOINTS = """
SELECT concat('db-', user_id) AS resource_id, 'db.load.avg' AS metric,
  CASE WHEN event_id % 3 = 0 THEN 'db.wait_event' ELSE 'db.sql_tokenized' END AS dim_group,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('D', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20) END AS dim_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('SELECT ', repeat(concat('col_', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20, ', '),
    5 * (1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20))) END AS dim_text,
  1704067200000000 + CAST(floor(($US_TS - 1704067200000000) / 1440) AS BIGINT) AS ts_us, value, event_id AS pos
FROM {events}"""

# The metrics each catalogue lists.
CATALOGUE = (
    (1, "os.cpuUtilization.total", "CPU in use", "Percent"),
    (2, "db.SQL.queries", "Queries", "Count"),
    (3, "os.memory.free", "Free memory", "KB"),
    (4, "db.Transactions.active_transactions", "Active transactions", "Transactions"),
    (5, "os.cpuUtilization.idle", "Idle CPU", "Percent"),
)
FX_CATALOGUE = """
SELECT resource_id, m.ordinal AS ordinal,
  CASE WHEN length(resource_id) % 2 = 0 AND m.ordinal = 2 THEN upper(m.metric) ELSE m.metric END AS metric,
  CASE WHEN resource_id LIKE '%3' THEN concat(m.description, ' (alt)') ELSE m.description END AS description,
  CASE WHEN resource_id LIKE '%9' AND m.ordinal = 4 THEN NULL ELSE m.unit END AS unit
FROM {fx_instances} $EACH_METRIC"""
_ENTRIES = ", ".join(f"({o}, '{m}', '{t}', '{u}')" for o, m, t, u in CATALOGUE)
EACH_METRIC = {
    "spark": f"LATERAL VIEW inline(array({_ENTRIES.replace('(', 'struct(')})) m AS ordinal, metric, description, unit",
    "check": f"CROSS JOIN (VALUES {_ENTRIES}) AS m(ordinal, metric, description, unit)",
}

FX_MYSQL_DIGESTS = """
SELECT concat('db-', l_suppkey % 100) AS resource_id,
  CASE WHEN p_partkey % 40 = 39 THEN NULL ELSE concat('q', p_partkey % 40) END AS digest,
  CASE WHEN p_partkey % 40 = 7 THEN NULL ELSE concat('SELECT * FROM t', p_partkey % 40) END AS digest_text,
  CASE WHEN p_partkey % 40 = 5 THEN NULL ELSE 'app' END AS schema_name,
  count(*) AS count_star, CAST(sum(l_quantity) AS BIGINT) * 1000000000 AS avg_timer_wait,
  CAST(sum(l_linenumber) AS BIGINT) * 1000000000000 AS sum_lock_time, CAST(sum(l_linenumber) AS BIGINT) AS sum_rows_examined,
  count(*) AS sum_rows_sent, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS sum_errors
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4"""

FX_PG_STATEMENTS = """
SELECT concat('db-', l_suppkey % 100) AS resource_id,
  CASE WHEN l_partkey % 40 = 39 THEN NULL ELSE CAST(l_partkey % 40 AS BIGINT) END AS queryid, concat('SELECT $1 FROM u', l_partkey % 40) AS query,
  count(*) AS calls, CAST(sum(l_quantity) AS DOUBLE) / count(*) AS mean_exec_time,
  CASE WHEN l_partkey % 40 = 3 THEN NULL ELSE CAST(sum(l_linenumber) AS DOUBLE) END AS blk_read_time,
  CAST(0 AS DOUBLE) AS blk_write_time, CAST(sum(l_linenumber) AS BIGINT) AS $ROWS
FROM {lineitem} GROUP BY 1, 2, 3, l_partkey % 40"""


def board_metrics() -> list[tuple[int, str]]:
    """(board number, sample name) of every counter the panels show, MySQL first."""
    found = []
    for number, panels in enumerate(BOARDS.values()):
        names: dict[str, None] = {}
        for panel in panels.values():
            if isinstance(panel, Stat):
                names |= dict.fromkeys(panel.names)
            elif isinstance(panel, Series):
                names |= dict.fromkeys(name for name, _ in panel.targets)
            elif isinstance(panel, Used):
                names |= dict.fromkeys((panel.free, panel.total))
        found += [(number, name) for name in names]
    return found


def _fx_board() -> str:
    """Published samples of the dashboards' counters: each event reports three neighbouring metrics."""
    metrics = board_metrics()
    sizes = [sum(1 for n, _ in metrics if n == number) for number in range(len(BOARDS))]
    rows, seen = [], [0] * len(BOARDS)
    for number, name in metrics:
        for offset in range(3):
            rows.append(f"({number}, {(seen[number] + offset) % sizes[number]}, '{name}', {3 - offset})")
        seen[number] += 1
    return f"""
SELECT m.name AS name, i.identifier AS identifier, i.cluster_identifier AS cluster_identifier, i.region AS region,
  CASE WHEN m.board = 0 THEN 'aurora-mysql' ELSE 'aurora-postgresql' END AS engine, 'Count' AS unit,
  1704067200000000 + CAST(floor(($US_TS - 1704067200000000) / 1440) AS BIGINT) AS ts_us, value * m.factor AS value
FROM {{events}} JOIN {{fx_instances}} AS i ON concat('db-', user_id) = i.resource_id
JOIN (VALUES {", ".join(rows)}) AS m(board, idx, name, factor)
  ON m.board = user_id % 2 AND m.idx = event_id % (CASE WHEN user_id % 2 = 0 THEN {sizes[0]} ELSE {sizes[1]} END)"""


FX_BOARD = _fx_board()

# Fixed rule tables of the fixtures.
INSTANCE_RULES = (
    {"identifier": ["^customer-"], "engine": ["postgres", "mysql"], "tag.Team": ["team[0-3]"]},
    {"identifier": ["7$"], "tag.Environment": ["^MACHINERY$"]},
)
METRIC_RULES = (
    {"name": [r"^db\.", r"^os\.", "db.SQL.queries.max"], "category": ["os", "db"]},
    {"name": [r"\.idle$"]},
)
TTL_RULES = ((1, r"^db\.load\..*", 30_000_000), (2, r"^os\.memory\..*", 300_000_000), (3, r".*\.max$", 120_000_000), (4, r"^os\.", 0))
CLUSTER_POLICY = (("nation_1", 3), ("nation_2", 10), ("nation_3", 60), ("", 5), ("", 7))
GREEN_TO_RED = ((None, "green"), (60, "yellow"), (85, "red"))
RED_TO_GREEN = ((None, "red"), (95, "yellow"), (99, "green"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    text = text.replace("$US_TS", "unix_micros(CAST(ts AS TIMESTAMP))").replace("$ROWS", "`rows`")
    text = text.replace("$EACH_METRIC", EACH_METRIC["spark"])
    for name in TABLES:
        if f"{{{name}}}" in text and name not in frames:
            frames[name] = table(spark, sf_dir, name)
    return spark.sql(text, **frames)


def _events(spark: SparkSession, sf_dir: str, since_us: int | None, until_us: int | None) -> DataFrame:
    """Events whose squeezed time may lie in the range: a range of the stored ``ts``, which the scan prunes by."""
    rows = table(spark, sf_dir, "events")

    def stored(us: int) -> str:
        moment = datetime(1970, 1, 1) + timedelta(microseconds=START_US + (us - START_US) * SQUEEZE)
        return f"TIMESTAMP_NTZ'{moment.isoformat(sep=' ', timespec='microseconds')}'"

    if since_us is not None:
        rows = rows.filter(f"ts >= {stored(since_us)}")
    if until_us is not None:
        rows = rows.filter(f"ts < {stored(until_us + 1)}")
    return rows


def fx_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, FX_INSTANCES)


def fx_datapoints(spark: SparkSession, sf_dir: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    return _derive(spark, sf_dir, FX_DATAPOINTS, events=_events(spark, sf_dir, since_us, until_us))


def datapoints_of(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The same for given events, which may be a stream."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - START_US
    names = {
        "view": "os.cpuUtilization.total.avg", "click": "db.SQL.queries.avg", "purchase": "db.load.avg", "signup": "os.memory.free.avg",
    }
    metric = F.lit("db.Transactions.active_transactions.max")
    for event, name in names.items():
        metric = F.when(F.col("event_type") == event, F.lit(name)).otherwise(metric)
    return events.select(
        F.concat(F.lit("db-"), "user_id").alias("resource_id"), metric.alias("metric"),
        (F.lit(START_US) + F.floor(us / SQUEEZE)).cast("bigint").alias("ts_us"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"), F.col("event_id").alias("pos"),
    )


def fx_dim_datapoints(spark: SparkSession, sf_dir: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    return _derive(spark, sf_dir, FX_DIM_DATAPOINTS, events=_events(spark, sf_dir, since_us, until_us))


def fx_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances are dealt over all shuffle partitions before each becomes its entries: a file of them is one task however many there are."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = fx_instances(spark, sf_dir).select("resource_id").repartition(parts, "resource_id")
    return _derive(spark, sf_dir, FX_CATALOGUE, fx_instances=dealt)


def fx_mysql_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, FX_MYSQL_DIGESTS)


def fx_pg_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, FX_PG_STATEMENTS)


def fx_board(spark: SparkSession, sf_dir: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    events = _events(spark, sf_dir, since_us, until_us)
    return _derive(spark, sf_dir, FX_BOARD, events=events, fx_instances=fx_instances(spark, sf_dir))


def dumped(df: DataFrame, purpose: str, fmt: str, *folders: str) -> str:
    """Write raw records as a dump, with folders by the columns named; the path."""
    return written(df, scratch_dir(df.sparkSession, purpose), fmt, *folders)


def written(df: DataFrame, path: str, fmt: str, *folders: str) -> str:
    writer = df.write.format(fmt).partitionBy(*folders) if folders else df.write.format(fmt)
    writer.options(**({"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"} if fmt == "json" else {})).save(path)
    return path


def raw_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory as the service dumps it. Some tag lists repeat a key or hold an incomplete tag."""
    fx = fx_instances(spark, sf_dir)
    tag = lambda k, v: F.struct(k.alias("Key"), v.alias("Value"))
    tags = F.array(tag(F.lit("Environment"), F.col("tag_environment")), tag(F.lit("Team"), F.col("tag_team")))
    again = F.array(tag(F.lit("Environment"), F.lit("renamed")), tag(F.lit(None).cast("string"), F.lit("x")))
    return fx.select(
        "region",
        F.col("identifier").alias("DBInstanceIdentifier"),
        F.timestamp_micros("creation_us").alias("InstanceCreateTime"),
        F.col("resource_id").alias("DbiResourceId"),
        F.col("engine_raw").alias("Engine"),
        F.col("status").alias("DBInstanceStatus"),
        F.col("insights_enabled").alias("PerformanceInsightsEnabled"),
        F.when(F.col("cluster_identifier") != "", F.col("cluster_identifier")).alias("DBClusterIdentifier"),
        F.when(
            F.col("endpoint_address").isNotNull(),
            F.struct(F.col("endpoint_address").alias("Address"), F.col("endpoint_port").alias("Port")),
        ).alias("Endpoint"),
        F.when(F.col("resource_id").endswith("0"), F.concat(tags, again)).otherwise(tags).alias("TagList"),
    )


def raw_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue responses as the service dumps them: one row per instance with the list of its metrics."""
    resource = F.col("resource_id")

    def entry(ordinal: int, metric: str, description: str, unit: str):
        name, text, measure = F.lit(metric), F.lit(description), F.lit(unit)
        if ordinal == 2:
            name = F.when(F.length(resource) % 2 == 0, F.upper(name)).otherwise(name)
        if ordinal == 4:
            measure = F.when(~resource.endswith("9"), measure)
        text = F.when(resource.endswith("3"), F.concat(text, F.lit(" (alt)"))).otherwise(text)
        return F.struct(name.alias("Metric"), text.alias("Description"), measure.alias("Unit"))

    return fx_instances(spark, sf_dir).select("resource_id", F.array(*[entry(*row) for row in CATALOGUE]).alias("Metrics"))


def flat_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened inventory, straight from the fixture columns."""
    tags = F.map_from_arrays(F.array(F.lit("Environment"), F.lit("Team")), F.array("tag_environment", "tag_team"))
    return fx_instances(spark, sf_dir).select(
        "region", "resource_id", "identifier", "cluster_identifier",
        F.coalesce("endpoint_address", F.lit("")).alias("endpoint"), F.coalesce("endpoint_port", F.lit(0)).alias("port"),
        "engine_raw", "status", F.coalesce("insights_enabled", F.lit(False)).alias("insights_enabled"), "creation_us",
        F.map_filter(tags, lambda _, v: v.isNotNull()).alias("tags"),
    )


def dim_points(spark: SparkSession, sf_dir: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """Dimensional datapoints with the dimensions as a map; null for the aggregate row."""
    rows = fx_dim_datapoints(spark, sf_dir, since_us, until_us)
    wait = F.col("dim_group") == "db.wait_event"
    keys = F.when(wait, F.array(F.lit("db.wait_event.name"), F.lit("db.wait_event.type"))).otherwise(
        F.array(F.lit("db.sql_tokenized.id"), F.lit("db.sql_tokenized.statement"))
    )
    dims = F.when(F.col("dim_id").isNotNull(), F.map_from_arrays(keys, F.array("dim_id", "dim_text")))
    return rows.select("resource_id", "metric", "dim_group", dims.alias("dims"), "ts_us", "value", "pos")


def policy(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({number}, '{cluster}', {top_n})" for number, (cluster, top_n) in enumerate(CLUSTER_POLICY))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS p(ordinal, cluster, top_n)")
