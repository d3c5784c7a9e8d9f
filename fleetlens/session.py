"""Session settings the plans rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that hold from one laptop to a thousand executors. The number of shuffle partitions is left
# to the cluster: adaptive execution coalesces small partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ui.retainedExecutions": "10",
    "spark.ui.enabled": "false",
}


def configure(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder


def _own_folder() -> str:
    """A folder of this process, for local mode alone; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="fleetlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only when the cluster names none (unit tests, local mode) is a folder of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _own_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: for results that are used several times.

    A lost executor then costs the tasks that read from it, not the whole lineage.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that was written for one run."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(location, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file with this text, wherever the path leads."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(location, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


@contextlib.contextmanager
def stored(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``materialize`` for the length of a block: the copy is removed at its end."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        discard(spark, path)


def ship_library(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a Spark context: functions that run there import it by name."""
    context = spark.sparkContext
    if getattr(context, "_fleetlens_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(_own_folder()) / "fleetlens.zip"  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._fleetlens_shipped = True
