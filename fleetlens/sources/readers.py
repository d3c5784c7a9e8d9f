"""Raw dumps to flat tables. Schemas are declared, nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens import schemas
from fleetlens.functions.labels import tag_map
from fleetlens.operators.predicates import requested_type


# What a dump's records may carry besides the service's own fields: where and when they were fetched.
ORIGIN = T.StructType([T.StructField("region", T.StringType()), T.StructField("fetched_at_us", T.LongType())])
# Where statements are read from in a database, and their longest text.
MYSQL_VIEW, PG_VIEW, STATEMENT_LENGTH = "performance_schema.events_statements_summary_by_digest", "pg_stat_statements", 200

CORRUPT, REJECT_LENGTH = "_corrupt_record", 200

Paths = str | list[str]


def _scan(spark: SparkSession, path: Paths, schema: T.StructType, fmt: str, tolerant: bool) -> DataFrame:
    """Records as they are; JSON with ``CORRUPT``, the text of a record that does not parse."""
    if fmt not in ("parquet", "json", "orc"):
        raise ValueError(f"unsupported format: {fmt}")
    declared = T.StructType([*schema.fields, *([T.StructField(CORRUPT, T.StringType())] if fmt == "json" else [])])
    options = {"ignoreCorruptFiles": str(tolerant).lower(), **({"columnNameOfCorruptRecord": CORRUPT} if fmt == "json" else {})}
    return spark.read.schema(declared).options(**options).format(fmt).load(path)


def _parsed(schema: T.StructType, parsed: bool = True) -> Column:
    """Whether a record parsed, all of it: every column is looked at, so that the answer is the same whatever a query selects."""
    state = F.col(CORRUPT).isNull() if parsed else F.col(CORRUPT).isNotNull()
    return state & (F.size(F.array(*[F.col(n).isNull() for n in schema.names])) > 0)


def _read(spark: SparkSession, path: Paths, schema: T.StructType, fmt: str, tolerant: bool = False) -> DataFrame:
    """Records that parse. Those that do not are rows of ``source_rejects``, not records without values."""
    rows = _scan(spark, path, schema, fmt, tolerant)
    return rows.where(_parsed(schema)).drop(CORRUPT) if fmt == "json" else rows


def stream_of(spark: SparkSession, path: Paths, schema: T.StructType, fmt: str, options: Mapping[str, str]) -> DataFrame:
    """The records of new files, with region and time of fetching (null where a record lacks them), as a stream."""
    if fmt not in ("parquet", "json", "orc"):
        raise ValueError(f"unsupported format: {fmt}")
    whole = T.StructType([*ORIGIN.fields, *schema.fields])
    corrupt = [T.StructField(CORRUPT, T.StringType())] if fmt == "json" else []
    rows = spark.readStream.schema(T.StructType([*whole.fields, *corrupt])).options(**options).format(fmt)
    if fmt != "json":
        return rows.load(path)
    return rows.option("columnNameOfCorruptRecord", CORRUPT).load(path).where(_parsed(whole)).drop(CORRUPT)


def source_rejects(spark: SparkSession, path: Paths, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """(file, reason, record): what a dump holds that its reader leaves out, while the other records go on.

    ``broken_record``: a JSON record that does not parse under the schema, with the beginning of its text.
    ``no_readable_record``: a file with content that gives no record at all, as it is cut off, is of another format or, among
    Parquet and ORC files, has no rows. Read such dumps with ``tolerant``, which skips unreadable files.
    """
    name = F.col("_metadata.file_path").alias("file")
    rows = _scan(spark, path, T.StructType([*ORIGIN.fields, *schema.fields]), fmt, True).select("*", name)
    nothing = F.lit(None).cast("string")
    listed = spark.read.format("binaryFile").load(path).where("length > 0").select(name)  # names and sizes; no content is read
    silent = listed.join(rows.select("file").distinct(), "file", "left_anti")
    rejects = silent.select("file", F.lit("no_readable_record").alias("reason"), nothing.alias("record"))
    if fmt != "json":
        return rejects
    broken = rows.where(_parsed(T.StructType([*ORIGIN.fields, *schema.fields]), False))
    return rejects.unionByName(broken.select("file", F.lit("broken_record").alias("reason"), F.left(CORRUPT, F.lit(REJECT_LENGTH)).alias("record")))


def _carried(spark: SparkSession, path: Paths, fmt: str) -> set[str]:
    """Which fields of ORIGIN any record of a dump has; of Parquet and ORC, any file.

    JSON is read up to the first record with the field, as writers leave null fields out; without one it is read once more.
    """
    if fmt != "json":
        return set(spark.read.format(fmt).option("mergeSchema", True).load(path).columns)
    records = spark.read.text(path).select(F.json_object_keys("value").alias("keys"))
    return {name for name in ORIGIN.names if records.where(F.array_contains("keys", name)).limit(1).collect()}


def _dump(
    spark: SparkSession, path: Paths, schema: T.StructType, fmt: str, region: str | None, origin: Sequence[str] | None = None, tolerant: bool = False,
) -> DataFrame:
    """Records with their region and time of fetching, if the dump has them.

    The region is given, or a partition folder (one scan may then cover several regions), or a field of the records.
    ``origin`` names the fields of ORIGIN that folders or records carry: large dumps give it, as otherwise the dump is looked
    through for them when the plan is built. ``tolerant`` skips files that cannot be read; see ``source_rejects``.
    """
    carried = _carried(spark, path, fmt) if origin is None else set(origin)
    if carried - set(ORIGIN.names) and origin is not None:
        raise ValueError(f"not among {ORIGIN.names}: {sorted(carried - set(ORIGIN.names))}")
    fields = [f for f in ORIGIN.fields if f.name in carried]
    raw = _read(spark, path, T.StructType([*fields, *schema.fields]), fmt, tolerant)
    return raw if region is None else raw.withColumn("region", F.lit(region))


def flatten_instances(raw: DataFrame) -> DataFrame:
    """Nested inventory records to columns; absent endpoint and cluster become empty, never null."""
    c = F.col
    return raw.select(
        c("region"),
        c("DbiResourceId").alias("resource_id"),
        c("DBInstanceIdentifier").alias("identifier"),
        F.coalesce("DBClusterIdentifier", F.lit("")).alias("cluster_identifier"),
        F.coalesce(c("Endpoint.Address"), F.lit("")).alias("endpoint"),
        F.coalesce(c("Endpoint.Port"), F.lit(0)).alias("port"),
        c("Engine").alias("engine_raw"),
        c("DBInstanceStatus").alias("status"),
        F.coalesce("PerformanceInsightsEnabled", F.lit(False)).alias("insights_enabled"),
        F.unix_micros("InstanceCreateTime").alias("creation_us"),
        tag_map(c("TagList")).alias("tags"),
        *[c(n) for n in ("fetched_at_us",) if n in raw.columns],
    )


def read_instances(
    spark: SparkSession, path: Paths, region: str | None = None, fmt: str = "json", origin: Sequence[str] | None = None, tolerant: bool = False,
) -> DataFrame:
    """Inventory dumps, of one region or of several in one scan; for the other arguments see ``_dump``."""
    raw = _dump(spark, path, schemas.RAW_INSTANCE, fmt, region, origin, tolerant)
    return flatten_instances(raw if "region" in raw.columns else raw.withColumn("region", F.lit(None).cast("string")))


def flatten_catalogue(raw: DataFrame) -> DataFrame:
    """Catalogue responses to one row per instance and metric, numbered in the order received."""
    rows = raw.select(
        *[n for n in ("region", "resource_id") if n in raw.columns],
        *([F.col("fetched_at_us").alias("seen_at_us")] if "fetched_at_us" in raw.columns else []),
        F.posexplode("Metrics").alias("ordinal", "m"),
    )
    flat = rows.select(
        *[n for n in rows.columns if n != "m"],
        F.col("m.Metric").alias("metric"), F.col("m.Description").alias("description"), F.col("m.Unit").alias("unit"),
    )
    return flat.filter(F.col("metric").isNull() | requested_type(F.col("metric")))


def read_catalogue(
    spark: SparkSession, path: Paths, fmt: str = "json", region: str | None = None, origin: Sequence[str] | None = None, tolerant: bool = False,
) -> DataFrame:
    return flatten_catalogue(_dump(spark, path, schemas.RAW_CATALOGUE, fmt, region, origin, tolerant))


def flatten_datapoints(raw: DataFrame) -> DataFrame:
    """Series responses to one row per datapoint; ``pos`` keeps the order inside a response."""
    keep = [n for n in ("region", "resource_id", "dim_group") if n in raw.columns]
    points = raw.select(*keep, "Key", F.posexplode_outer("DataPoints").alias("pos", "p"))
    dims = [F.col("Key.Dimensions").alias("dims")] if "dim_group" in keep else []
    return points.select(
        *keep, F.col("Key.Metric").alias("metric"), *dims,
        F.unix_micros("p.Timestamp").alias("ts_us"), F.col("p.Value").alias("value"), F.col("pos").cast("bigint"),
    )


def read_datapoints(
    spark: SparkSession, path: Paths, fmt: str = "json", region: str | None = None, origin: Sequence[str] | None = None, tolerant: bool = False,
) -> DataFrame:
    return flatten_datapoints(_dump(spark, path, schemas.RAW_DATAPOINTS, fmt, region, origin, tolerant))


def read_dim_datapoints(
    spark: SparkSession, path: Paths, fmt: str = "json", region: str | None = None, origin: Sequence[str] | None = None, tolerant: bool = False,
) -> DataFrame:
    return flatten_datapoints(_dump(spark, path, schemas.RAW_DIM_DATAPOINTS, fmt, region, origin, tolerant))


def view_query(schema: T.StructType, view: str, needed: Sequence[str], text: str) -> str:
    """What to ask a database for: the schema's columns, the text cut, rows without a needed column left out."""
    columns = [
        f"LEFT({n}, {STATEMENT_LENGTH}) AS {n}" if n == text else n for n in schema.fieldNames() if n not in ("region", "resource_id")
    ]
    return f"SELECT {', '.join(columns)} FROM {view} WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in needed)


def _snapshot(
    spark: SparkSession, source: Paths | Mapping[str, str], schema: T.StructType, fmt: str, query: str, region: str | None, resource_id: str | None,
    origin: Sequence[str] | None = None,
) -> DataFrame:
    """A statement snapshot, with the instance it belongs to: a system view does not name it, so it is given."""
    if isinstance(source, Mapping):
        options = dict(source) if {"query", "dbtable"} & source.keys() else {**source, "query": query}
        rows = spark.read.format("jdbc").options(**options).load()
    else:
        own = T.StructType([f for f in schema.fields if f.name != "resource_id" or resource_id is None])
        rows = _dump(spark, source, own, fmt, region, origin)
    for name, value in (("region", region), ("resource_id", resource_id)):
        rows = rows if value is None else rows.withColumn(name, F.lit(value))
    if "resource_id" not in rows.columns:
        raise ValueError("the snapshot does not name its instance: pass resource_id")
    return rows


def read_mysql_digests(
    spark: SparkSession, source: Paths | Mapping[str, str], fmt: str = "parquet", region: str | None = None, resource_id: str | None = None,
    origin: Sequence[str] | None = None,
) -> DataFrame:
    """Statement digests from a dump, or from the system view by JDBC options; ``resource_id`` names the instance."""
    query = view_query(schemas.MYSQL_DIGESTS, MYSQL_VIEW, ("digest", "schema_name"), "digest_text")
    return _snapshot(spark, source, schemas.MYSQL_DIGESTS, fmt, query, region, resource_id, origin)


def read_pg_statements(
    spark: SparkSession, source: Paths | Mapping[str, str], fmt: str = "parquet", region: str | None = None, resource_id: str | None = None,
    origin: Sequence[str] | None = None,
) -> DataFrame:
    query = view_query(schemas.PG_STATEMENTS, PG_VIEW, ("queryid",), "query")
    return _snapshot(spark, source, schemas.PG_STATEMENTS, fmt, query, region, resource_id, origin)


def read_samples(spark: SparkSession, path: str, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """Samples stored by ``writers.write_samples``, with their day in ``ds``.

    A time range prunes the folders of other days before any file is opened. Samples without a time of
    their own hold at any time.
    """

    def day(us: int) -> str:
        return datetime.fromtimestamp(us // 1_000_000, timezone.utc).strftime("%Y-%m-%d")

    rows = spark.read.schema(schemas.STORED_SAMPLES).parquet(path)
    undated = F.col("ds") == schemas.UNDATED
    if since_us is not None:
        rows = rows.filter(undated | ((F.col("ds") >= day(since_us)) & (F.col("ts_us") >= since_us)))
    if until_us is not None:
        rows = rows.filter(undated | ((F.col("ds") <= day(until_us)) & (F.col("ts_us") <= until_us)))
    return rows
