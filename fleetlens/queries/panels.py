"""The composed plans and every dashboard panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators.asof import INSTANT_LOOKBACK_US
from fleetlens.plans import catalogue as cat, collection, dimensions, inventory
from fleetlens.plans.dashboards import ALL, BOARDS, Picker, Series, Stat, Table, Used, dashboard, stat_panels
from fleetlens.queries import check_sql as S, frames as X, inputs as I
from fleetlens.queries.registry import query
from fleetlens.queries.relational import INV, WANTED

NOW = I.NOW_US


# ---- composed plans ------------------------------------------------------------------------------------

@query("pl_1", f"SELECT {INV} FROM kept", "kept")
def pl_1(spark, d):
    rows = inventory.discover_instances(I.flat_instances(spark, d), *I.INSTANCE_RULES, S.KEPT)
    tags = [F.try_element_at("tags", F.lit(key)).alias(key.lower()) for key in ("Environment", "Team")]
    return rows.select("*", *tags).drop("tags")


@query("pl_2", "SELECT region, resource_id, engine, metric, description, unit, array_to_string(statistics, ',') AS statistics FROM catalogue", "catalogue")
def pl_2(spark, d):
    rows = X.catalogue(spark, d).drop("identifier", "cluster_identifier")
    return rows.withColumn("statistics", F.concat_ws(",", "statistics"))


@query("pl_3", "SELECT * FROM counters", "counters")
def pl_3(spark, d):
    return X.counters(spark, d)


@query("pl_4", "SELECT * FROM counters WHERE identifier IN ('customer-000000002', 'customer-000000003', 'customer-000000008')", "counters")
def pl_4(spark, d):
    return collection.collect_metrics_for(WANTED, X.recent_points(spark, d), X.catalogue(spark, d), X.fleet(spark, d), NOW)


@query("pl_5", "SELECT * FROM dim_samples", "dim_samples")
def pl_5(spark, d):
    rows = dimensions.top_load_by_dimension(X.recent_dims(spark, d), X.fleet(spark, d), NOW, 10)
    return X.rounded(rows, "value")


@query("pl_6", "SELECT * FROM statement_samples", "statement_samples")
def pl_6(spark, d):
    return X.statement_samples(spark, d)


@query("pl_7", "SELECT * FROM fresh", "fresh")
def pl_7(spark, d):
    return collection.freshness(I.fx_datapoints(spark, d, NOW - S.LOOKBACK, NOW), I.TTL_RULES, NOW)


@query("pl_8", f"SELECT name, help, {S.label_text(S.LABELS)} AS labels, value, ts_us FROM exposition", "exposition")
def pl_8(spark, d):
    from fleetlens.sources.writers import label_text

    return X.rounded(X.exposition(spark, d), "value").select("name", "help", label_text(S.LABELS).alias("labels"), "value", "ts_us")


# ---- panels --------------------------------------------------------------------------------------------

def _picked(instance: str) -> str:
    return "" if instance == ALL else f" AND regexp_full_match(identifier, '{instance}')"


def _decimal_round(expression: str, decimals: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(30, 9)), {decimals}) AS DOUBLE)"


def _stat_sql(panel: Stat, instance: str) -> tuple[str, ...]:
    first = panel.names[0]
    if panel.function == "count":
        rows = f"SELECT CAST(count(DISTINCT identifier) AS DOUBLE) AS v FROM board_now WHERE name = '{first}' HAVING count(*) > 0"
    elif len(panel.names) == 2:
        rows = f"""SELECT {panel.function}(a.value + b.value) AS v FROM (SELECT * FROM board_now WHERE name = '{first}'{_picked(instance)}) a
JOIN (SELECT * FROM board_now WHERE name = '{panel.names[1]}'{_picked(instance)}) b USING (identifier, cluster_identifier, region, engine, unit) HAVING count(*) > 0"""
    else:
        rows = f"SELECT {panel.function}(value) AS v FROM board_now WHERE name = '{first}'{_picked(instance)} HAVING count(*) > 0"
    decimals = 6 if panel.decimals is None else panel.decimals
    return f"SELECT {_decimal_round('v', decimals)} AS value, {S.colour('v', panel.steps)} AS colour FROM ({rows})", "board_now"


def _series_sql(panel: Series, instance: str) -> tuple[str, ...]:
    shown = " ".join(
        f"WHEN '{name}' THEN concat(identifier, '{' ' + suffix if suffix else ''}')" for name, suffix in panel.targets
    )
    names = ", ".join(f"'{name}'" for name, _ in panel.targets)
    return f"SELECT CASE name {shown} END AS series, region, at_us, value FROM board_grid WHERE name IN ({names}){_picked(instance)}", "board_grid"


def _used_sql(panel: Used, instance: str) -> tuple[str, ...]:
    return f"""SELECT identifier AS series, region, at_us, round((1 - a.value / nullif(b.value, 0)) * 100, 6) AS value FROM
(SELECT * FROM board_grid WHERE name = '{panel.free}'{_picked(instance)}) a JOIN (SELECT * FROM board_grid WHERE name = '{panel.total}'{_picked(instance)}) b
USING (identifier, cluster_identifier, region, engine, unit, at_us)""", "board_grid"


def _table_sql(panel: Table, instance: str) -> tuple[str, ...]:
    columns = ", ".join(
        f"{_decimal_round(f'''{f}(value) FILTER (name = '{name}')''', decimals)} AS {column}" for column, name, f, decimals in panel.columns
    )
    names = ", ".join(f"'{name}'" for _, name, _, _ in panel.columns)
    return f"SELECT * EXCLUDE (digest) FROM (SELECT statement AS query, digest, {columns} FROM statement_samples WHERE name IN ({names}){_picked(instance)} GROUP BY statement, digest)", "statement_samples"


def _panel_sql(panel, instance: str) -> tuple[str, ...]:
    if isinstance(panel, Stat):
        return _stat_sql(panel, instance)
    if isinstance(panel, Series):
        return _series_sql(panel, instance)
    if isinstance(panel, Used):
        return _used_sql(panel, instance)
    if isinstance(panel, Table):
        return _table_sql(panel, instance)
    return f"SELECT DISTINCT identifier FROM fx_board WHERE name = '{panel.name}'", "fx_board"


def _samples(spark, d, panel):
    """Statement tables read statement samples, instant panels the last minutes, curves the last hour."""
    if isinstance(panel, Table):
        return X.statement_samples(spark, d).withColumn("unit", F.lit(None).cast("string"))
    if isinstance(panel, Stat):
        return X.board(spark, d, NOW - INSTANT_LOOKBACK_US, NOW)
    if isinstance(panel, Picker):
        return X.board(spark, d)
    return X.board(spark, d, X.HOUR_GRID.start_us - INSTANT_LOOKBACK_US, NOW)


def _register(board: str, name: str, instance: str = ALL, suffix: str = "") -> None:
    panel = BOARDS[board][name]

    @query(f"dash_{board}_{name}{suffix}", *_panel_sql(panel, instance))
    def run(spark, d):
        rows = dashboard(board, name, _samples(spark, d, panel), NOW, X.HOUR_GRID, instance)
        # sums in another order differ in the last digits
        return X.rounded(rows, "value") if isinstance(panel, (Stat, Used)) else rows


for _board, _panels in BOARDS.items():
    for _name in _panels:
        _register(_board, _name)

PICK = "customer-0000000[0-4].*|customer-0000001.."
for _name in ("stat_cpu", "series_network", "series_memory", "table_by_calls"):
    _register("mysql", _name, PICK, "_picked")


STATS = [(b, n, p) for b, panels in BOARDS.items() for n, p in panels.items() if isinstance(p, Stat)]


@query("pl_10", "\nUNION ALL ".join(f"SELECT '{b}' AS board, '{n}' AS panel, * FROM ({_stat_sql(p, ALL)[0]})" for b, n, p in STATS), "board_now")
def pl_10(spark, d):
    """All single-number panels of both boards."""
    return X.rounded(stat_panels(X.board(spark, d, NOW - INSTANT_LOOKBACK_US, NOW), NOW), "value")
