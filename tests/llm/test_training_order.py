import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import training_order as order
from fleetlens.llm.tokens import encode


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5000), st.integers(0, 2**40))
def test_the_permutation_is_a_bijection(size, key):
    permutation = order.Permutation(size, key)
    numbers = np.arange(size)
    slots = permutation.slots(numbers)
    assert sorted(slots.tolist()) == numbers.tolist() and permutation.numbers(slots).tolist() == numbers.tolist()


def test_keys_give_other_orders():
    a, b = (order.Permutation(10_000, key).slots(np.arange(10_000)) for key in (1, 2))
    assert (a == b).mean() < 0.01 and abs(np.corrcoef(a, np.arange(10_000))[0, 1]) < 0.05


def rows_of(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3, "doc_id")


def test_round_trip(spark, tmp_path):
    df, length, a_shard = rows_of(spark), 128, 40
    uri = str(tmp_path / "shards")
    got = sorted(order.materialise(df, uri, key=9, length=length, shard_bytes=a_shard * length * 2).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    assert all(r.shard == r.slot // a_shard and r.byte_offset == r.slot % a_shard * length * 2 for r in got)
    records = list(order.read_from(uri, 0, length, a_shard))
    assert [zlib.crc32(r.tobytes()) for r in records] == [r.ids_crc32 for r in got]
    # back in the order before the permutation, the sequences are the texts of each partition, one after another
    tokens = {r.doc_id: np.append(encode(r.text), order.END_ID) for r in df.collect()}
    assert sum(r.n_tokens for r in got) == sum(map(len, tokens.values()))
    back = order.Permutation(len(got), 9).numbers(np.arange(len(got)))
    stream = [None] * len(got)
    for slot, number in enumerate(back.tolist()):
        stream[number] = records[slot][: got[slot].n_tokens]
    seen = np.concatenate(stream).tolist()
    docs, begin = [], 0
    for k, token in enumerate(seen):
        if token == order.END_ID:
            docs.append(tuple(seen[begin : k + 1]))
            begin = k + 1
    assert sorted(docs) == sorted(tuple(t.tolist()) for t in tokens.values())
    assert [r.tolist() for r in order.read_from(uri, 77, length, a_shard)] == [r.tolist() for r in records[77:]]


def test_resume_writes_only_what_is_missing(spark, tmp_path):
    df, uri = rows_of(spark), str(tmp_path / "shards")
    options = dict(key=4, length=128, shard_bytes=40 * 256)
    first = sorted(order.materialise(df, uri, **options).collect())
    names = sorted(n for n in os.listdir(uri) if order.SHARD_NAME.fullmatch(n))
    before = {n: (tmp_path / "shards" / n).read_bytes() for n in names}
    os.remove(f"{uri}/{names[1]}")
    with open(f"{uri}/{names[2]}", "r+b") as file:
        file.truncate(100)
    kept = os.stat(f"{uri}/{names[0]}").st_ino
    again = sorted(order.materialise(df, uri, resume=True, **options).collect())
    assert again == first and {n: (tmp_path / "shards" / n).read_bytes() for n in names} == before
    assert os.stat(f"{uri}/{names[0]}").st_ino == kept


@pytest.mark.parametrize("change", ["key", "length", "corpus", "fewer"])
def test_resume_with_another_run_writes_everything_anew(spark, tmp_path, change):
    df, uri = rows_of(spark), str(tmp_path / "shards")
    options = dict(key=1, length=128, shard_bytes=40 * 256)
    order.materialise(df, uri, **options).count()
    if change == "corpus":
        df = df.withColumn("text", F.translate("text", "e", "a"))
    elif change == "fewer":
        df = df.where("doc_id < 40")
    else:
        options |= {"key": 2} if change == "key" else {"length": 64, "shard_bytes": 80 * 128}
    got = sorted(order.materialise(df, uri, resume=True, **options).collect(), key=lambda r: r.slot)
    a_shard = options["shard_bytes"] // (2 * options["length"])
    records = list(order.read_from(uri, 0, options["length"], a_shard))
    assert [r.slot for r in got] == list(range(len(got))) and [zlib.crc32(r.tobytes()) for r in records] == [r.ids_crc32 for r in got]


def test_the_registered_query(spark):
    from fleetlens.llm import queries

    got = queries.op7_training_order(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and sum(r.n_tokens for r in got) == sum(len(encode(r.text)) + 1 for r in docs)


def test_nasty_rows(spark, nasty, nothing, tmp_path):
    got = order.materialise(nasty, str(tmp_path / "a"), key=1, length=64, shard_bytes=64 * 2 * 50).collect()
    want = sum(len(encode(r.text)) + 1 for r in nasty.collect())
    assert sum(r.n_tokens for r in got) == want and sorted(r.slot for r in got) == list(range(len(got)))
    assert order.materialise(nothing, str(tmp_path / "b"), key=1).count() == 0


@pytest.mark.parametrize("total", [0, 1, 81])
def test_whole_shards_of_nothing(tmp_path, total):
    assert order.whole_shards(str(tmp_path / "none"), total, 40, 8) == set()
