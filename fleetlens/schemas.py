"""Declared schemas of the input tables and of the emitted samples."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


STRING, LONG, INT, DOUBLE, BOOL, TIME = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)

# Raw dumps, field names as the services spell them.
RAW_INSTANCE = _fields(
    ("DBInstanceIdentifier", STRING),
    ("DBInstanceArn", STRING),
    ("InstanceCreateTime", TIME),
    ("DbiResourceId", STRING),
    ("Engine", STRING),
    ("DBInstanceStatus", STRING),
    ("DBInstanceClass", STRING),
    ("AllocatedStorage", INT),
    ("PerformanceInsightsEnabled", BOOL),
    ("DBClusterIdentifier", STRING),
    ("Endpoint", _fields(("Address", STRING), ("Port", INT))),
    ("TagList", T.ArrayType(_fields(("Key", STRING), ("Value", STRING)))),
)
RAW_METRIC = _fields(("Metric", STRING), ("Description", STRING), ("Unit", STRING))
RAW_CATALOGUE = _fields(("resource_id", STRING), ("Metrics", T.ArrayType(RAW_METRIC)))
RAW_SERIES = _fields(
    ("Key", _fields(("Metric", STRING), ("Dimensions", T.MapType(STRING, STRING)))),
    ("DataPoints", T.ArrayType(_fields(("Timestamp", TIME), ("Value", DOUBLE)))),
)
RAW_DATAPOINTS = T.StructType([T.StructField("resource_id", STRING), *RAW_SERIES.fields])
RAW_DIM_DATAPOINTS = T.StructType(
    [T.StructField("resource_id", STRING), T.StructField("dim_group", STRING), *RAW_SERIES.fields]
)
MYSQL_DIGESTS = _fields(
    ("resource_id", STRING), ("digest", STRING), ("digest_text", STRING), ("schema_name", STRING),
    ("count_star", LONG), ("avg_timer_wait", LONG), ("sum_lock_time", LONG),
    ("sum_rows_examined", LONG), ("sum_rows_sent", LONG), ("sum_errors", LONG),
)
PG_STATEMENTS = _fields(
    ("resource_id", STRING), ("queryid", LONG), ("query", STRING), ("calls", LONG),
    ("mean_exec_time", DOUBLE), ("blk_read_time", DOUBLE), ("blk_write_time", DOUBLE), ("rows", LONG),
)

# Label columns of an emitted sample. A label a family does not carry is null.
LABELS = (
    "identifier", "cluster_identifier", "region", "engine", "unit",
    "digest", "statement", "wait_event", "wait_type",
)
COUNTER_LABELS = LABELS[:5]
STATEMENT_LABELS = (*LABELS[:4], "digest", "statement")
WAIT_LABELS = (*LABELS[:4], "wait_event", "wait_type")
EXPOSITION = ("name", "help", *LABELS, "value", "ts_us")
UNDATED = "undated"  # day of samples that carry no time
STORED_SAMPLES = _fields(
    *[(name, STRING) for name in ("name", "help", *LABELS)], ("value", DOUBLE), ("ts_us", LONG), ("ds", STRING),
)
