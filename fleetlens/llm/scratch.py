"""Intermediate tables in the shared folder, and small helpers for tasks that read Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetlens.session import discard, scratch_dir, ship_library

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_BATCH_ROWS = 1000
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files as soon as it has ended; else they lie on disk until the driver collects its garbage.

    Meant for actions inside the block. A frame that is made inside and run twice after it computes its shuffles twice.
    """
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


class Scratch:
    """Tables of one run below ``spark.checkpoint.dir``: they cut lineage, so a lost executor costs its tasks only.

    ``drop`` removes a table that nothing reads any more, ``drop_all_but`` every other one; what a returned frame still
    reads stays until its owner removes ``base``.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.base, self.names = spark, scratch_dir(spark, purpose), set()

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.options(compression="zstd", **options).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, f"{self.base}/{name}")
            self.names.discard(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*sorted(self.names - {*names}))


def arrow_map(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with the library shipped to the workers and batches that stay small however long the texts are."""
    ship_library(df.sparkSession)
    if int(df.sparkSession.conf.get(BATCH_ROWS)) > MOST_BATCH_ROWS:
        df.sparkSession.conf.set(BATCH_ROWS, str(MOST_BATCH_ROWS))
    return df.mapInArrow(function, schema)


def extended(fields: list[T.StructField], added: str) -> T.StructType:
    """Fields as they are, whatever their names, and new ones written as DDL."""
    return T.StructType([*fields, *T.StructType.fromDDL(added).fields])


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``max_bytes`` of text, one row at least: memory does not follow the batch's size."""
    begin, held = 0, 0
    for row, size in enumerate(value_lengths(batch, column)):
        if held and held + size > max_bytes:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def value_lengths(batch: pa.RecordBatch, column: str) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
