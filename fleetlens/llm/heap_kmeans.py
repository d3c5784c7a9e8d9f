"""Exact centroid clustering of integer vectors with heap-ordered bounds.

Each vector's two nearest centroids give a gap: distance to the second less distance to its own. When centroids move, the gap of a
vector in cluster a shrinks by at most a's movement and the largest movement of another centroid. The sum of these over the rounds is the
cluster's drift. A vector is entered under ``key = gap + drift of its cluster so far``; as long as the key exceeds the drift its
cluster is certain, so only entries that the drift has overtaken are popped, measured against all centroids and entered
again.

The heap as Spark sees it: a round's entries are one table, written once, sorted by (cluster, key) in each partition. What a
round pops from it is a range of keys per cluster, from the drift of the last round to that of this one, so every entry is popped once,
nothing is rewritten and the Parquet reader skips row groups and pages outside the range. What stays is never read until the end. Sums
of clusters change by the vectors that changed cluster only. The driver holds the centroids and one drift a cluster.

Exactness: components are ``floor(256 * x)``, squared distances, sums and means are integers; products are taken in double
precision where every sum stays below 2^53, else in 64-bit integers. Gaps and drifts are doubles with a margin above their
rounding, and an entry at the margin is measured again. Ties go to the smaller number.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out, and so are
those with a component of 2^19 or more, whose squared distance might not fit a long; repeated rows are vectors of their
own; among equal hashes the smaller vector starts the smaller centroid; a null id starts a centroid only where there
are too few others; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.scratch import Scratch, arrow_map

DIMENSIONS, SCALE, LARGEST = 64, 256, 1 << 19
EXACT = 1 << 22  # components below this multiply exactly in double precision
MARGIN = 1e-9
NO_SECOND = 1e300
ROW_GROUP = 8 << 20


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that can be clustered, as integers."""
    x = F.col("embedding")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return vectors.where((F.size(x) == DIMENSIONS) & good).select(
        "vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int")).alias("v")
    )


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose seeded ids have the smallest hashes."""
    ranked = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return np.array([row.v for row in ranked.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], np.int64).reshape(-1, DIMENSIONS)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All exact squared distances, as integers."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        products = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (x * x).sum(1)[:, None] - 2 * products + (centroids * centroids).sum(1)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def _entered(centroids: np.ndarray, drift: np.ndarray):
    """Function for tasks: rows with their nearest cluster and the key of their gap; the cluster before is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            squared = squared_distances(_matrix(batch), centroids)
            nearest, rows = squared.argmin(1), np.arange(batch.num_rows)
            own = np.sqrt(squared[rows, nearest].astype(np.float64))
            squared[rows, nearest] = np.iinfo(np.int64).max
            other = np.sqrt(squared.min(1).astype(np.float64)) if len(centroids) > 1 else np.full(batch.num_rows, NO_SECOND)
            key = other - own - MARGIN * (1 + other + own) + drift[nearest]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), batch.column("cluster"), pa.array(nearest, pa.int32()), pa.array(key)],
                ["vec_id", "v", "before", "cluster", "key"],
            )

    return run


def _sums(k: int):
    """Function for tasks: what vectors that changed cluster add to and take from the clusters, a row per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, DIMENSIONS + 1), np.int64)
        for batch in batches:
            before, now = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("before", "cluster"))
            changed = before != now
            rows = np.hstack([_matrix(batch), np.ones((batch.num_rows, 1), np.int64)])[changed]
            np.add.at(total, now[changed], rows)
            left = before[changed] >= 0
            np.subtract.at(total, before[changed][left], rows[left])
        touched = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array(list(total[touched]), pa.list_(pa.int64()))], ["cluster", "sums"])

    return run


class Heap:
    """Runs of entries, what has been popped from them, and the drift of every cluster."""

    def __init__(self, scratch: Scratch, vectors: DataFrame, centroids: np.ndarray):
        self.scratch, self.centroids = scratch, centroids
        self.drift = np.zeros(len(centroids))
        self.runs: list[tuple[DataFrame, np.ndarray]] = []  # entries, and the drift up to which they have been popped
        self.sums = np.zeros((len(centroids), DIMENSIONS + 1), object)
        self.enter(vectors.withColumn("cluster", F.lit(-1)))

    def enter(self, rows: DataFrame) -> None:
        kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<int>, before int, cluster int, key double"
        entries = arrow_map(rows.select("vec_id", "v", "cluster"), _entered(self.centroids, self.drift), kind)
        run = self.scratch.table(entries.sortWithinPartitions("cluster", "key"), f"run-{len(self.runs)}", **{"parquet.block.size": str(ROW_GROUP)})
        self.runs.append((run, np.full(len(self.drift), -np.inf)))
        partial = arrow_map(run.select("v", "before", "cluster"), _sums(len(self.drift)), "cluster int, sums array<long>")
        whole = partial.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("n"))
        for row in whole.collect():  # one number per cluster and component
            self.sums[row.cluster, row.pos] += row.n

    def move(self) -> None:
        """Non-empty centroids go to the floor of their vectors' mean; drifts grow by what that may have taken off a gap."""
        moved = self.centroids.copy()
        for c, sums in enumerate(self.sums.tolist()):
            if sums[-1]:
                moved[c] = [s // sums[-1] for s in sums[:-1]]
        step = np.sqrt(((moved - self.centroids).astype(np.float64) ** 2).sum(1))
        self.centroids = moved
        if len(step) > 1:
            order = np.argsort(step)
            other = np.where(np.arange(len(step)) == order[-1], step[order[-2]], step[order[-1]])
            self.drift = self.drift + (step + other) * (1 + MARGIN)

    def _between(self, low: np.ndarray, high: np.ndarray | None) -> Column:
        """Entries whose key the drift of their cluster has passed since ``low``; without ``high`` all above ``low``."""

        def of(c: int) -> str:
            above = f" AND key > {low[c]!r}D" if np.isfinite(low[c]) else ""
            return f"(cluster = {c}{above}" + (")" if high is None else f" AND key <= {high[c]!r}D)")

        low, high = low.tolist(), None if high is None else high.tolist()
        parts = [of(c) for c in range(len(low)) if high is None or low[c] < high[c]]
        return F.expr(" OR ".join(parts) or "false")

    def pop(self) -> None:
        """Expired entries of all runs are measured and entered again."""
        expired = [run.where(self._between(popped, self.drift)).select("vec_id", "v", "cluster") for run, popped in self.runs]
        self.runs = [(run, self.drift) for run, _ in self.runs]
        self.enter(functools.reduce(DataFrame.unionByName, expired))

    def live(self) -> DataFrame:
        """Every vector's valid entry."""
        return functools.reduce(DataFrame.unionByName, [run.where(self._between(popped, None)) for run, popped in self.runs])


def _measured(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = centroids[batch.column("cluster").to_numpy(zero_copy_only=False)]
            squared = ((_matrix(batch) - own) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(squared)], ["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """A row per vector of (vec_id, embedding): cluster, squared distance, sums of these, hash of the centroid."""
    spark = vectors.sparkSession
    whole = integer_vectors(vectors)
    kind = whole.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    scratch = Scratch(spark, "heap-clusters")
    heap = Heap(scratch, whole, centroids)
    for _ in range(rounds):
        heap.move()
        heap.pop()
    found = scratch.table(arrow_map(heap.live().select("vec_id", "v", "cluster"), _measured(heap.centroids), f"vec_id {kind}, cluster int, distance long"), "found")
    scratch.drop(*[f"run-{i}" for i in range(len(heap.runs))])
    inertia = {row.cluster: row.n for row in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in heap.centroids.tolist()]

    def by_cluster(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    return found.select(
        "vec_id", "cluster", "distance", by_cluster([inertia.get(c, 0) for c in range(len(digests))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), by_cluster(digests).alias("centroid_sha256"),
    )
