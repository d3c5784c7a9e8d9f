"""Inventory and catalogue dumps that keep arriving: a stream of snapshots, each used only when it is whole.

A snapshot is what was fetched of a region at one time. Its records may come in several files and micro-batches; it is closed when
the watermark has passed its time, which takes a later snapshot (of any region) by more than ``delay``. Records and closings are
stored by two queries over the same files, and readers join them, so nobody sees half an inventory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetlens.sources import readers
from fleetlens.streaming import changes

FETCHED = "fetched_at_us"


def read_snapshots(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", region: str | None = None, files_a_batch: int | None = None,
) -> DataFrame:
    """New files as they come. A record without a time of fetching was fetched when its file was written."""
    options = {} if files_a_batch is None else {"maxFilesPerTrigger": str(files_a_batch)}
    raw = readers.stream_of(spark, path, schema, fmt, options)
    written = F.unix_micros("_metadata.file_modification_time")
    dated = raw.select("*", written.alias("_written_us")).withColumn(FETCHED, F.coalesce(FETCHED, "_written_us")).drop("_written_us")
    return dated if region is None else dated.withColumn("region", F.lit(region))


def closings(snapshots: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """(keys, fetched_at_us, records), in append mode: a row per snapshot once the watermark has passed it."""
    timed = snapshots.withColumn("event_time", F.timestamp_micros(FETCHED)).withWatermark("event_time", delay)
    counted = timed.groupBy(*keys, "event_time").agg(F.count(F.lit(1)).alias("records"))
    return counted.select(*keys, F.unix_micros("event_time").alias(FETCHED), "records")


class Snapshots:
    """Stored records and closings below ``path``; ``flatten`` turns records into rows that keep ``keys`` and the time."""

    def __init__(self, stream: DataFrame, flatten: Callable[[DataFrame], DataFrame], keys: Sequence[str], path: str, delay: str):
        self.spark, self.keys, self.path = stream.sparkSession, list(keys), path.rstrip("/")
        self.rows, self.closed = flatten(stream), closings(stream, keys, delay)

    def run(self) -> None:
        """Take in what has come since the last run. Records go first: a closing never lacks its records."""
        changes.run_to_end(self.rows, f"{self.path}/rows", "append")
        changes.run_to_end(self.closed, f"{self.path}/closed", "append")

    def read(self) -> DataFrame:
        """Rows of all closed snapshots."""
        rows = changes.read_changes(self.spark, f"{self.path}/rows", self.rows.schema).drop("batch_id").alias("r")
        closed = changes.read_changes(self.spark, f"{self.path}/closed", self.closed.schema).alias("c")
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*self.keys, FETCHED)]
        return rows.join(closed, same, "left_semi")
