"""Clustering with heap-ordered bounds against plain integer Lloyd rounds."""

import hashlib
import random

import numpy as np
import pytest

from fleetlens.llm import heap_kmeans
from fleetlens.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, key string, v string, before int, distance int"


def plain(rows, k, rounds, seed):
    kept = []
    for vec_id, x in rows:
        if x is None or len(x) != 64 or any(c is None or not np.isfinite(c) for c in x):
            continue
        kept.append((vec_id, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        found = []
        for _, v in kept:
            away = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            found.append((away.index(min(away)), min(away)))
        return found

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (a, _) in zip(kept, found) if a == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    inertia = [sum(d for a, d in found if a == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(r[0], a, d, inertia[a], sum(inertia), digest[a]) for r, (a, d) in zip(kept, found)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def check(spark, rows, k, rounds=5, seed=2):
    frame = spark.createDataFrame([(i, x, 0, "c", "k", "v", 1, 2) for i, x in rows], SCHEMA).repartition(3)
    found = heap_kmeans.clustered(frame, k, rounds, seed)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert order(tuple(r) for r in found.collect()) == order(plain(rows, k, rounds, seed))


def cloud(rng, n, centers, spread):
    return [[float(c + rng.gauss(0, spread)) for c in centers[i % len(centers)]] for i in range(n)]


def test_equals_plain_rounds(spark):
    rng = random.Random(5)
    centers = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    rows = list(enumerate(cloud(rng, 260, centers, 0.2)))
    rows += [(300 + i, rows[0][1]) for i in range(30)] + [(7, rows[1][1])] * 3 + [(None, rows[2][1]), (None, centers[0])]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [None] + [0.5] * 63), (404, [float("nan")] * 64), (405, [float("inf")] * 64), (406, [0.0] * 64)]
    check(spark, rows, 12)


def test_ties_and_empty_centroids(spark):
    """Coarse grid points: many equal distances, copies among the first centroids."""
    rng = random.Random(9)
    points = [[float(rng.randrange(2)) if i < 4 else 0.0 for i in range(64)] for _ in range(80)]
    check(spark, list(enumerate(points)), 20)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    check(spark, [(i, [float(i)] * 64) for i in range(n)], 40)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    check(spark, [(i, [rng.uniform(-4e5, 4e5) for _ in range(64)]) for i in range(40)], 5)


def test_only_expired_entries_are_popped_once(spark):
    rng = random.Random(3)
    centers = [[rng.uniform(-3, 3) for _ in range(64)] for _ in range(5)]
    rows = [(i, x) for i, x in enumerate(cloud(rng, 400, centers, 0.05))]
    frame = spark.createDataFrame([(i, x, 0, "c", "k", "v", 1, 2) for i, x in rows], SCHEMA)
    whole = heap_kmeans.integer_vectors(frame)
    heap = heap_kmeans.Heap(Scratch(spark, "test-heap"), whole, heap_kmeans.first_centroids(whole, 5, 2))
    for _ in range(5):
        heap.move()
        heap.pop()
        assert sorted(r.vec_id for r in heap.live().collect()) == list(range(400))
    popped = [run.count() for run, _ in heap.runs]
    assert popped[0] == 400 and sum(popped[1:]) < 5 * 400 and popped[-1] < 400
    plan = heap.runs[0][0].where(heap._between(*[d for _, d in heap.runs[:1]], heap.drift + 1))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(key" in plan
