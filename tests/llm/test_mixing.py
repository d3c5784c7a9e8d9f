import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import mixing
from fleetlens.llm.scratch import Scratch


def water(sizes, weights, most=3):
    """Targets by resharing the excess again and again."""
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        weight = sum(weights[s] for s in free)
        share = {s: (total - sum(capped.values())) * weights[s] / weight for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(5))
def test_targets_equal_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {None if i == 0 else f"s{i:02d}é"[: rng.choice([3, 4])]: int(rng.paretovariate(0.6) * 100) % 100_000 for i in range(12)}
    ordered = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(ordered)}
    df = mixing.cyclic_weights(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    got = {r.source: (r.weight, r.target) for r in mixing.targets(df).collect()}
    want = water(sizes, weights)
    assert {s: w for s, (w, _) in got.items()} == weights
    assert all(got[s][1] == pytest.approx(want[s]) for s in sizes) and sum(t for _, t in got.values()) == pytest.approx(sum(sizes.values()))


def test_copies_equal_a_plain_ranking(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(0, 400)) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long").repartition(7)
    totals = Counter()
    for _, s, n in docs:
        totals[s] += n
    goal = {"a": 0.4, "b": 1.7, "c": 3.0, None: 2.0}
    sources = spark.createDataFrame([(s, n, n * goal[s]) for s, n in totals.items()], "source string, source_size long, target double")
    got = {r.doc_id: r.copies for r in mixing.copies(df, mixing.plan(df, sources, Scratch(spark, "t"), seed=5), seed=5).collect()}
    want = {}
    for s, n in totals.items():
        ratio = n * goal[s] / n
        certain, rest = int(ratio), ratio - int(ratio)

        def rank(i):
            u = (int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return u / (1 - u) / (rest / (1 - rest)) if rest else 0

        total = 0
        for i, size in sorted(((i, size) for i, t, size in docs if t == s), key=lambda d: rank(d[0])):
            want[i] = certain + (rest > 0 and 2 * total + size <= 2 * rest * n)
            total += size
    assert got == want
    taken = Counter()
    for i, s, n in docs:
        taken[s] += got[i] * n
    assert all(abs(taken[s] - totals[s] * goal[s]) <= 400 for s in totals)


def test_odds_favour_documents(spark):
    df = spark.createDataFrame([(i, "a", 10) for i in range(4000)], "doc_id long, source string, size long")
    sources = spark.createDataFrame([("a", 40_000, 12_000.0)], "source string, source_size long, target double")
    odds = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    planned = mixing.plan(df, sources, Scratch(spark, "t"), odds=odds)
    rows = mixing.copies(df, planned, odds=odds).where("copies = 1").select(F.col("doc_id") % 2).collect()
    even = sum(r[0] == 0 for r in rows)
    assert len(rows) == 1200 and even > 2 * (1200 - even)


def test_reruns_agree_and_the_mix_repeats(spark, nasty):
    plans = [mixing.plan_by_cycle(nasty.repartition(n), seed=2)[0] for n in (1, 5)]
    a, b = (sorted(map(str, mixing.copies(mixing.sized(nasty), p, seed=2).collect())) for p in plans)
    assert a == b
    rows = mixing.repeated(nasty, seed=2)
    assert rows.columns == nasty.columns and dict(rows.dtypes) == dict(nasty.dtypes)
    copies = Counter()
    for r in mixing.copies(mixing.sized(nasty), plans[0], seed=2).collect():
        copies[r.doc_id, r.text_md5] += r.copies
    assert Counter((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in rows.collect()) == Counter({k: n for k, n in copies.items() if n})
    assert max(copies.values()) <= 6  # three a row, and one row is there twice


def test_empty_tables(spark, nothing):
    planned, sizes = mixing.plan_by_cycle(nothing)
    assert planned.count() == sizes.count() == mixing.repeated(nothing).count() == 0


def test_sources_without_words(spark):
    docs = spark.createDataFrame([(1, "a", ""), (2, "a", None), (3, "b", "x y z")], "doc_id long, source string, text string")
    planned, sizes = mixing.plan_by_cycle(docs)
    got = {r.doc_id: (r.copies * r["size"], r.target) for r in mixing.copies(sizes, planned).collect()}
    assert got == {1: (0, 0.0), 2: (0, 0.0), 3: (3, 3.0)}


def test_documents_without_an_id_are_drawn_one_by_one(spark):
    rng = random.Random(8)
    rows = [(None, s, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 80)))) for s in ("a", "b") for _ in range(1000)]
    planned, sizes = mixing.plan_by_cycle(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    taken, goal = Counter(), {}
    for r in mixing.copies(sizes, planned).collect():
        taken[r.source] += r.copies * r["size"]
        goal[r.source] = r.target
    assert goal["a"] < goal["b"] and all(abs(taken[s] - goal[s]) <= 80 for s in goal)


def test_long_documents_are_likelier(spark):
    rows = [(i, "ab"[i >= 2000], " ".join([f"word{i}"] * (200 if i % 2 else 50))) for i in range(4000)]
    planned, sizes = mixing.plan_by_cycle(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    picked = Counter(r["size"] for r in mixing.copies(sizes, planned).where("source = 'a' and copies = 1").collect())
    assert picked[200] > 1.2 * picked[50] > 0
