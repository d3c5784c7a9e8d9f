"""The two dashboards: every panel is a named question to the table of published samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fleetlens.functions.display import display_name, panel_round, percent_used, threshold_colour
from fleetlens.operators import vector
from fleetlens.operators.asof import Grid, instant, over_grid
from fleetlens.operators.keys import label_columns
from fleetlens.operators.predicates import label_matches

ALL = ".*"


@dataclass(frozen=True)
class Stat:
    """One number: an aggregate of the newest samples, or of the per-series sum of two of them."""

    function: str
    names: tuple[str, ...]
    steps: tuple[tuple[float | None, str], ...]
    decimals: int | None = None


@dataclass(frozen=True)
class Series:
    """Curves: (sample name, suffix of the display name)."""

    targets: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Used:
    """Curve of ``(1 - free / total) * 100``."""

    free: str
    total: str


@dataclass(frozen=True)
class Table:
    """Statements: (column, sample name, function, decimals) in display order; sorted by ``order``."""

    columns: tuple[tuple[str, str, str, int], ...]
    order: str


@dataclass(frozen=True)
class Picker:
    name: str
    label: str = "identifier"


def _statement_table(prefix: str, order: str, third: str) -> Table:
    calls = ("calls", f"{prefix}_query_calls_total", "sum", 0)
    duration = ("avg_duration", f"{prefix}_query_avg_duration_ms", "avg", 2)
    extra = {
        "errors": ("errors", f"{prefix}_query_errors_total", "sum", 0),
        "lock_time": ("lock_time", f"{prefix}_query_lock_time_ms", "sum", 2),
    }[third]
    rest = (
        ("rows_examined", f"{prefix}_query_rows_examined_total", "sum", 0),
        ("rows_sent", f"{prefix}_query_rows_sent_total", "sum", 0),
    )
    first = (calls, duration) if order == "calls" else (duration, calls)
    return Table((*first, extra, *rest), order)


# Panels, the samples they show, thresholds, decimals and display suffixes.
MYSQL = {
    "stat_instances": Stat("count", ("dbi_ams_db_users_threads_running_avg",), ((None, "blue"),)),
    "stat_qps": Stat("sum", ("dbi_ams_db_sql_questions_avg",), ((None, "green"), (5000, "yellow"), (10000, "red"))),
    "stat_connections": Stat("sum", ("dbi_ams_db_users_threads_connected_avg",), ((None, "green"), (500, "yellow"), (1000, "red"))),
    "stat_slow_queries": Stat("sum", ("dbi_ams_db_sql_slow_queries_avg",), ((None, "green"), (1, "yellow"), (10, "red")), 2),
    "stat_buffer_hit_rate": Stat("avg", ("dbi_ams_db_cache_innodb_buffer_pool_hit_rate_avg",), ((None, "red"), (95, "yellow"), (99, "green")), 2),
    "stat_cpu": Stat("avg", ("dbi_os_cpuutilization_total_avg",), ((None, "green"), (60, "yellow"), (85, "red")), 1),
    "series_qps": Series((("dbi_ams_db_sql_questions_avg", ""),)),
    "series_connections": Series((("dbi_ams_db_users_threads_connected_avg", "connected"), ("dbi_ams_db_users_threads_running_avg", "running"))),
    "series_cpu": Series((("dbi_os_cpuutilization_total_avg", ""),)),
    "series_memory": Used("dbi_os_memory_free_avg", "dbi_os_memory_total_avg"),
    "series_storage_latency": Series((("dbi_os_diskio_aurorastorage_readlatency_avg", "read"), ("dbi_os_diskio_aurorastorage_writelatency_avg", "write"))),
    "series_storage_iops": Series((("dbi_os_diskio_aurorastorage_readiosps_avg", "read IOPS"), ("dbi_os_diskio_aurorastorage_writeiosps_avg", "write IOPS"))),
    "series_row_lock_waits": Series((("dbi_ams_db_locks_innodb_row_lock_waits_avg", ""),)),
    "series_deadlocks": Series((("dbi_ams_db_locks_innodb_deadlocks_avg", ""),)),
    "series_lock_timeouts": Series((("dbi_ams_db_locks_innodb_lock_timeouts_avg", ""),)),
    "series_buffer_hit_rate": Series((("dbi_ams_db_cache_innodb_buffer_pool_hit_rate_avg", ""),)),
    "series_buffer_reads": Series((("dbi_ams_db_cache_innodb_buffer_pool_read_requests_avg", "requests"), ("dbi_ams_db_cache_innodb_buffer_pool_reads_avg", "disk reads"))),
    "series_slow_queries": Series((("dbi_ams_db_sql_slow_queries_avg", ""),)),
    "series_network": Series((("dbi_os_network_rx_avg", "RX"), ("dbi_os_network_tx_avg", "TX"))),
    "series_load_average": Series((("dbi_os_loadaverageminute_one_avg", "1m"), ("dbi_os_loadaverageminute_five_avg", "5m"), ("dbi_os_loadaverageminute_fifteen_avg", "15m"))),
    "table_by_calls": _statement_table("dbi_ams", "calls", "errors"),
    "table_by_duration": _statement_table("dbi_ams", "avg_duration", "lock_time"),
    "instance_picker": Picker("dbi_ams_db_users_threads_running_avg"),
}
POSTGRES = {
    "stat_instances": Stat("count", ("dbi_apg_db_user_numbackends_avg",), ((None, "blue"),)),
    "stat_tps": Stat("sum", ("dbi_apg_db_transactions_xact_commit_avg", "dbi_apg_db_transactions_xact_rollback_avg"), ((None, "green"), (1000, "yellow"), (5000, "red"))),
    "stat_connections": Stat("sum", ("dbi_apg_db_user_numbackends_avg",), ((None, "green"), (500, "yellow"), (1000, "red"))),
    "stat_blocked": Stat("sum", ("dbi_apg_db_transactions_blocked_transactions_avg",), ((None, "green"), (1, "yellow"), (10, "red")), 2),
    "stat_deadlocks": Stat("sum", ("dbi_apg_db_concurrency_deadlocks_avg",), ((None, "green"), (1, "yellow"), (5, "red")), 2),
    "stat_db_load": Stat("avg", ("dbi_apg_db_load_avg",), ((None, "green"), (5, "yellow"), (20, "red")), 2),
    "series_transactions": Series((("dbi_apg_db_transactions_xact_commit_avg", "commits"), ("dbi_apg_db_transactions_xact_rollback_avg", "rollbacks"))),
    "series_connection_states": Series((("dbi_apg_db_state_active_count_avg", "active"), ("dbi_apg_db_state_idle_count_avg", "idle"), ("dbi_apg_db_state_idle_in_transaction_count_avg", "idle in txn"))),
    "series_db_load": Series((("dbi_apg_db_load_avg", ""),)),
    "series_queries": Series((("dbi_apg_db_sql_queries_started_avg", "started"), ("dbi_apg_db_sql_queries_finished_avg", "finished"))),
    "series_read_latency": Series((("dbi_apg_db_io_read_latency_avg", ""),)),
    "series_blocks_read": Series((("dbi_apg_db_io_storage_blks_read_avg", "storage reads"), ("dbi_apg_db_io_blks_read_avg", "blk reads"))),
    "series_blocked": Series((("dbi_apg_db_transactions_blocked_transactions_avg", ""),)),
    "series_deadlocks": Series((("dbi_apg_db_concurrency_deadlocks_avg", ""),)),
    "series_idle_in_transaction": Series((("dbi_apg_db_state_idle_in_transaction_count_avg", ""),)),
    "series_cache_hits": Series((("dbi_apg_db_cache_blks_hit_avg", "cache hits"),)),
    "series_buffers_allocated": Series((("dbi_apg_db_cache_buffers_alloc_avg", "buffers allocated"),)),
    "series_checkpoints": Series((("dbi_apg_db_checkpoint_checkpoints_req_avg", "requested"), ("dbi_apg_db_checkpoint_checkpoints_timed_avg", "timed"))),
    "series_tuples": Series((
        ("dbi_apg_db_sql_tup_returned_avg", "returned"), ("dbi_apg_db_sql_tup_fetched_avg", "fetched"),
        ("dbi_apg_db_sql_tup_inserted_avg", "inserted"), ("dbi_apg_db_sql_tup_updated_avg", "updated"),
        ("dbi_apg_db_sql_tup_deleted_avg", "deleted"),
    )),
    "series_temp": Series((("dbi_apg_db_temp_temp_files_avg", "temp files"), ("dbi_apg_db_temp_temp_bytes_avg", "temp bytes"))),
    "table_by_calls": _statement_table("dbi_apg", "calls", "errors"),
    "table_by_duration": _statement_table("dbi_apg", "avg_duration", "lock_time"),
    "instance_picker": Picker("dbi_apg_db_user_numbackends_avg"),
}
BOARDS = {"mysql": MYSQL, "postgres": POSTGRES}


def _select(samples: DataFrame, names: list[str], instance: str | None) -> DataFrame:
    rows = samples.filter(F.col("name").isin(*names))
    if instance is None or instance == ALL:
        return rows
    return rows.filter(label_matches(F.col("identifier"), instance))


def _stat(panel: Stat, samples: DataFrame, at_us: int, instance: str) -> DataFrame:
    labels = label_columns(samples)
    counts = panel.function == "count"
    rows = instant(_select(samples, list(panel.names), None if counts else instance), ["name", *labels], at_us)
    if len(panel.names) == 2:
        pairs = vector.pair_by_name(rows, labels, *panel.names)
        rows = pairs.withColumn("value", F.col("left_value") + F.col("right_value"))
    if counts:
        result = vector.count_distinct_label(rows, "identifier").withColumn("value", F.col("value").cast("double"))
    else:
        result = vector.total(rows, panel.function)
    coloured = result.withColumn("colour", threshold_colour(F.col("value"), panel.steps))
    return coloured.withColumn("value", panel_round(F.col("value"), panel.decimals))


def stat_panels(samples: DataFrame, at_us: int, instance: str = ALL) -> DataFrame:
    """All single numbers of both boards in one scan: what a refresh asks for.

    The newest sample per series is pivoted to one row per label set (``unit`` included) with a column per
    sample name; each panel is then an aggregate of its columns. A panel without samples has no row.
    """
    panels = [(b, n, p) for b, group in BOARDS.items() for n, p in group.items() if isinstance(p, Stat)]
    names = list(dict.fromkeys(name for _, _, p in panels for name in p.names))
    labels = label_columns(samples)
    newest = instant(_select(samples, names, None), ["name", *labels], at_us)
    column = {name: f"v{i}" for i, name in enumerate(names)}
    wide = newest.groupBy(*labels).agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(c) for name, c in column.items()]
    )
    shown = F.lit(True) if instance == ALL else label_matches(F.col("identifier"), instance)
    # Sums and counts per identifier first: a distinct count is then a count of rows, and no row is repeated for it.
    partial, results = [], []
    for i, (_, _, p) in enumerate(panels):
        value = F.col(column[p.names[0]])
        for other in p.names[1:]:
            value = value + F.col(column[other])
        if p.function == "count":
            partial.append(F.max(value.isNotNull() & F.col("identifier").isNotNull()).alias(f"n{i}"))
            found = F.nullif(F.count_if(f"n{i}"), F.lit(0)).cast("double")
        else:
            partial += [F.sum(F.when(shown, value)).alias(f"s{i}"), F.count(F.when(shown, value)).alias(f"n{i}")]
            found = F.sum(f"s{i}") if p.function == "sum" else F.try_divide(F.sum(f"s{i}"), F.sum(f"n{i}"))
        results.append(found.alias(f"p{i}"))
    rows = []
    for i, (b, n, p) in enumerate(panels):
        value = F.col(f"p{i}")
        rounded = panel_round(value, p.decimals)
        rows.append(F.struct(F.lit(b).alias("board"), F.lit(n).alias("panel"), rounded.alias("value"), threshold_colour(value, p.steps).alias("colour")))
    return wide.groupBy("identifier").agg(*partial).agg(*results).select(F.inline(F.array(*rows))).filter(F.col("value").isNotNull())


def _series(panel: Series, samples: DataFrame, grid: Grid, instance: str) -> DataFrame:
    labels = label_columns(samples)
    rows = over_grid(_select(samples, [n for n, _ in panel.targets], instance), ["name", *labels], grid)
    shown = F.lit(None).cast("string")
    for name, suffix in panel.targets:
        shown = F.when(F.col("name") == name, display_name(F.col("identifier"), suffix)).otherwise(shown)
    return rows.select(shown.alias("series"), "region", "at_us", "value")


def _used(panel: Used, samples: DataFrame, grid: Grid, instance: str) -> DataFrame:
    labels = label_columns(samples)
    rows = over_grid(_select(samples, [panel.free, panel.total], instance), ["name", *labels], grid)
    pairs = vector.pair_by_name(rows, ["at_us", *labels], panel.free, panel.total)
    value = percent_used(F.col("left_value"), F.col("right_value"))
    return pairs.select(F.col("identifier").alias("series"), "region", "at_us", value.alias("value"))


def _table(panel: Table, samples: DataFrame, at_us: int, instance: str) -> DataFrame:
    labels = label_columns(samples)
    names = [name for _, name, _, _ in panel.columns]
    # statement samples carry no time: they hold at the time of the evaluation that published them
    timed = _select(samples, names, instance).withColumn("ts_us", F.coalesce("ts_us", F.lit(at_us)))
    rows = instant(timed, ["name", *labels], at_us)
    wide = vector.sample_table(rows, {column: (name, f) for column, name, f, _ in panel.columns})
    shown = [panel_round(F.col(column), decimals).alias(column) for column, _, _, decimals in panel.columns]
    order = [F.desc(panel.order), F.asc("digest"), F.asc("statement")]
    return wide.orderBy(*order).select(F.col("statement").alias("query"), *shown)


def dashboard(board: str, panel: str, samples: DataFrame, at_us: int, grid: Grid, instance: str = ALL) -> DataFrame:
    """The rows behind one panel: newest samples at ``at_us``, or curves over ``grid``."""
    spec = BOARDS[board][panel]
    if isinstance(spec, Stat):
        return _stat(spec, samples, at_us, instance)
    if isinstance(spec, Series):
        return _series(spec, samples, grid, instance)
    if isinstance(spec, Used):
        return _used(spec, samples, grid, instance)
    if isinstance(spec, Table):
        return _table(spec, samples, at_us, instance)
    return vector.label_values(samples.filter(F.col("name") == spec.name), spec.label)
