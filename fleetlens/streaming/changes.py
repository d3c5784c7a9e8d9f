"""Result tables of streaming queries: a folder per micro-batch holding the rows that changed in it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def append_changes(path: str):
    """Sink for ``foreachBatch``. A batch that is run again after a failure replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_batches(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there, in as many micro-batches as the source is read in, and stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_to_end(stream: DataFrame, path: str, mode: str = "update") -> None:
    run_batches(stream, path, append_changes(f"{path}/changes"), mode)


def read_changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).parquet(f"{path}/changes")


def current(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the one of the latest batch."""
    rest = [c for c in changes.columns if c not in (*keys, "batch_id")]
    last = F.max(F.struct("batch_id", *rest)).alias("last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}") for c in rest])
