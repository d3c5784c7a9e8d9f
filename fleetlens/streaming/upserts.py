"""A table of the latest row per key that micro-batches rewrite in place, bucket by bucket.

Rows lie in buckets by a hash of the key. A batch reads and writes the buckets that its keys fall into, and no others: their new files go
to a folder of the batch, then a manifest (a row per bucket: the batch that wrote it last) makes them valid. Readers take the
newest whole manifest, so they see a batch entirely or not at all. A batch that is run again, after its manifest was
written or before, leaves the same table. No streaming state is kept: the table is the state, however old a key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fleetlens.operators.freshness import latest_arrival, upsert
from fleetlens.session import discard

MANIFEST = "bucket int, batch long"
KEPT_MANIFESTS = 2  # the newest, and one that readers may still hold


class LatestTable:
    """One row per key, the latest arrival (``arrival_seq``) wins; ``schema`` is that of the rows, ``arrival_seq`` included.

    The number of buckets is part of the layout: size it so that a bucket is a few files, as a batch rewrites whole buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 1024):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets

    def _files(self):
        location = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return location, location.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        """Batches with a whole manifest, oldest first."""
        location, system = self._files()
        if not system.exists(location):
            return []
        found = [s.getPath() for s in system.listStatus(location)]
        whole = [p.getName() for p in found if system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(name.removeprefix("batch=")) for name in whole)

    def _manifest(self, batch: int) -> dict[int, int]:
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/batch={batch}").select("bucket", "batch")
        return {r.bucket: r.batch for r in rows.collect()}  # a row per bucket

    def manifest(self) -> dict[int, int]:
        """For each bucket the batch that wrote it last."""
        batches = self._batches()
        return self._manifest(batches[-1]) if batches else {}

    def _folder(self, bucket: int, batch: int) -> str:
        return f"{self.path}/data/batch={batch}/bucket={bucket}"

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read([self._folder(k, b) for k, b in sorted(self.manifest().items())])

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Fold a batch in; for ``foreachBatch``."""
        done = self._batches()
        if batch_id in done:
            return
        current = self._manifest(done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        changes = latest_arrival(rows.select(*self.schema.names), self.keys).withColumn("bucket", bucket).persist()
        try:
            touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # numbers below ``buckets``
            if touched:
                old = self._read([self._folder(k, current[k]) for k in sorted(touched) if k in current])
                whole = upsert(old, changes.select(*self.schema.names), self.keys).withColumn("bucket", bucket)
                whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch_id}")
        finally:
            changes.unpersist()
        valid = current | dict.fromkeys(touched, batch_id)
        listed = self.spark.createDataFrame(sorted(valid.items()), MANIFEST).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.path}/manifests/batch={batch_id}")
        self._clean()

    def _clean(self) -> None:
        """Drop manifests but the newest ones, and files that none of these names."""
        batches = self._batches()
        kept = [self._manifest(b) for b in batches[-KEPT_MANIFESTS:]]
        named = {(k, b) for manifest in kept for k, b in manifest.items()}
        for batch in batches[:-KEPT_MANIFESTS]:
            for bucket, writer in self._manifest(batch).items():
                if (bucket, writer) not in named:
                    discard(self.spark, self._folder(bucket, writer))
            discard(self.spark, f"{self.path}/manifests/batch={batch}")
