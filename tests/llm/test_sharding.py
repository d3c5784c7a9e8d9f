import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import sharding


def table(spark, sizes, seed=0, texts=None):
    rng = random.Random(seed)
    rows = [(i, (texts or {}).get(i) or "".join(rng.choice("abcdefgh ") for _ in range(n))) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), dict(rows)


def check(rows, texts, shards):
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data)) and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(texts)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_bytes_are_near_equal_and_slots_without_gaps(spark, shards):
    rng = random.Random(1)
    df, texts = table(spark, [int(rng.paretovariate(1.2) * 40) % 4000 for _ in range(3000)])
    rows = sharding.shard_by_bytes(df, shards).collect()
    check(rows, texts, shards)
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    share = sum(sizes.values()) / shards
    assert len(sizes) == shards and max(abs(s - share) for s in sizes.values()) <= 0.02 * share + 4008


def test_a_group_of_copies_is_cut_only_if_it_must_be(spark):
    copies = {i: "copy " * 20 for i in range(0, 900)} | {i: f"pair {i // 2} " * 9 for i in range(900, 3000)}
    df, texts = table(spark, [10] * 3000, texts=copies)
    rows = sharding.shard_by_bytes(df, 6).collect()
    check(rows, texts, 6)
    sizes, groups = Counter(), defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        groups[texts[r.doc_id]].add(r.shard)
    share = sum(sizes.values()) / 6
    assert max(sizes.values()) < 1.05 * share and min(sizes.values()) > 0.95 * share
    assert [g for g, s in groups.items() if len(s) > 1] in ([], ["copy " * 20])


def test_splitters_count_exactly(spark):
    df, _ = table(spark, [50] * 500)
    rows = sharding.keyed(df).cache()
    marks = sharding.splitters(rows, 7, tolerance=0.0, split_tolerance=0.0)
    below = [rows.where((F.col("key_hash") < m.hash) | ((F.col("key_hash") == m.hash) & (F.col("key_id") < m.id))).agg(F.sum("size")).first()[0] for m in marks]
    total = 500 * 58
    assert all(abs(b - total * k / 7) <= 58 for k, b in enumerate(below, 1))


@pytest.mark.parametrize("a_run", [10, 1000])
def test_slots_follow_the_keys_however_runs_are_cut(spark, monkeypatch, a_run):
    monkeypatch.setattr(sharding, "ROWS_A_RUN", a_run)
    df, texts = table(spark, [20] * 400, texts={i: "hot" for i in range(300)})
    rows = sharding.shard_by_bytes(df, 4).collect()
    check(rows, texts, 4)
    keys = {r.doc_id: (r.key_hash, r.key_id) for r in sharding.keyed(df).collect()}
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(keys, key=keys.get)


def test_runs_are_cut_inside_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_A_RUN", 10)
    df = spark.createDataFrame([(7, "same")] * 200 + [(i, f"other {i}") for i in range(50)], "doc_id long, text string").repartition(3)
    rows = sharding.shard_by_bytes(df, 2).collect()
    assert len(rows) == 250 and sum(r.doc_id == 7 for r in rows) >= 200
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_nasty_rows(spark, nasty, nothing):
    rows = sharding.shard_by_bytes(nasty, 3).collect()
    assert len(rows) == nasty.count() and rows[0].asDict().keys() == {"doc_id", "size", "text_crc32", "shard", "slot"}
    assert sorted(r["size"] for r in rows if r.doc_id == 5) == [8] and sharding.shard_by_bytes(nothing, 3).count() == 0
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(nasty, 0)
