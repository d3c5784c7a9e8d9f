import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import fingerprints as fp
from fleetlens.llm.queries import QUERIES
from fleetlens.llm.shingles import shingle_sets, words


def jaccard(a, b, size=5):
    def shingles(text):
        w = words(text)
        return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    one, two = shingles(a), shingles(b)
    return len(one & two) / len(one | two) if one | two else 1.0


def brute(rows):
    """Rows (doc_id, text) in descending order, null ids last; with the text edited by the next one."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((doc_id, text, text[: len(text) - half] + following[:half], following))
    return out


@pytest.mark.parametrize("part", [200, 20_000, 10**9])
def test_edited_texts_and_likeness(spark, part, monkeypatch):
    monkeypatch.setattr(fp, "PARTITION_BYTES", part * 10)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(7)
    want = {d: rest for d, *rest in brute([tuple(r) for r in df.collect()])}
    got = fp.with_next(df, slice_bytes=part).collect()
    assert len(got) == len(want) == 200
    for r in got:
        text, changed, following = want[r.doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text, changed)) < 0.15 and abs(r.near_next - jaccard(text, following)) < 0.15


def test_the_estimate_is_unbiased():
    rng = np.random.default_rng(5)
    for share in (0.1, 0.5, 0.9):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 2**64, 2000, dtype=np.uint64)
            both = int(1000 * 2 * share / (1 + share))
            a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:both], pool[1000 : 2000 - both]]))
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - truth)
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_empty_bins_are_filled_alike():
    few = shingle_sets(["a b c d e f g h"], 5)[0]
    assert len(few) == 4 and len(fp.fingerprint(few)) == fp.BINS and len(set(fp.fingerprint(few))) <= 4
    errors = []
    for seed in range(40):
        rng = random.Random(seed)
        w = [f"w{rng.randrange(10**6)}" for _ in range(34)]
        a, b = " ".join(w[:30]), " ".join(w[4:])
        one, two = (fp.fingerprint(t) for t in shingle_sets([a, b], 5))
        errors.append(fp.likeness(one, two) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.06


def test_texts_without_words():
    empty, word = fp.fingerprint(shingle_sets([" "], 5)[0]), fp.fingerprint(shingle_sets(["x"], 5)[0])
    assert empty == b"" and fp.likeness(empty, b"") == 1.0 and fp.likeness(empty, word) == 0.0 and fp.likeness(word, word) == 1.0


def test_nasty_rows(spark, nasty, nothing):
    got = fp.with_next(nasty, slice_bytes=500).collect()
    assert len(got) == nasty.count()
    prints = {}
    texts = {(r.doc_id, len(r.text or "")): r.text for r in nasty.select("doc_id", "text").collect()}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(texts[r.doc_id, r.n_chars], r.fingerprint) == r.fingerprint
    assert fp.with_next(nothing).count() == 0
    one = nasty.where("doc_id = 3")
    assert [(r.near_next, r.doc_id) for r in fp.with_next(one).collect()] == [(1.0, 3)]
    assert fp.fingerprints(nasty).where("length(fingerprint) IN (0, 512)").count() == nasty.count()


def test_registered_query(spark):
    got = QUERIES["op6_one_permutation"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and got.count() == 200


def test_ranges_are_partitions_and_cut_inside_an_id(spark, monkeypatch):
    monkeypatch.setattr(fp, "PARTITION_BYTES", 2000)
    monkeypatch.setattr(fp, "WEIGHT_BYTES", 50)
    rows = [(None, f"text number {i} without an id") for i in range(300)] + [(i, f"text {i}") for i in range(300)] + [(7, f"again {i}") for i in range(300)]
    rows += [(1000 + i, "long " * 300) for i in range(5)]
    routed = fp.in_order(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    parts = routed.groupBy(F.spark_partition_id().alias("part"), "range").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum((~F.col("tail")).cast("int")).alias("n")).collect()
    assert len({r.part for r in parts}) == len(parts) == len({r.range for r in parts}) and sum(r.n for r in parts) == len(rows)
    assert len(parts) > 10 and max(r.bytes for r in parts) < 2 * 2000
    got = fp.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 300
