import itertools
import zlib

import numpy as np
import pytest

from fleetlens.llm import line_crf
from fleetlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_marginals_equal_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 2, 6])
    emit, move = rng.normal(size=(counts.sum(), 2)), rng.normal(size=(2, 2))
    chance, pairs, total = line_crf.marginals(emit, counts, move)
    expected, begin = np.zeros((2, 2)), 0
    for text, n in enumerate(counts):
        weights, single = [], np.zeros((n, 2))
        for labels in itertools.product((0, 1), repeat=n):
            score = sum(emit[begin + t, y] for t, y in enumerate(labels)) + sum(move[a, b] for a, b in zip(labels, labels[1:]))
            weights.append(np.exp(score))
            for t, y in enumerate(labels):
                single[t, y] += np.exp(score)
            for a, b in zip(labels, labels[1:]):
                expected[a, b] += np.exp(score - total[text])
        assert np.isclose(np.log(sum(weights)), total[text])
        assert np.allclose(single / sum(weights), chance[begin : begin + n])
        begin += n
    assert np.allclose(expected, pairs)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op3_line_crf"](spark, FOLDER).collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 80 and np.mean([p == q for p, q in held]) >= 0.97
    assert len({(r.held_out, r.quality) for r in [(type("R", (), {"held_out": got[x.doc_id].held_out, "quality": x.quality})) for x in labels]}) == 4


def test_held_out_labels_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    spoiled = labels.withColumn("quality", F.when(line_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = line_crf.train(docs, labels), line_crf.train(docs, spoiled)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_nasty_rows(spark, nasty, nothing):
    labels = spark.createDataFrame([(1, 1), (3, 1), (13, 0), (14, 0), (None, 1), (8, None), (9, 0), (9, 1), (15, 1), (12, 0)], "doc_id long, quality int")
    model = line_crf.train(nasty, labels)
    rows = line_crf.scored(nasty, model)
    assert rows.columns == [*[c for c in nasty.columns if c not in ("score", "predicted")], "score", "predicted"]
    got = rows.collect()
    assert len(got) == nasty.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.text, r.score) == r.score
    assert line_crf.scored(nothing, model).count() == 0


def test_the_curve_is_that_of_whole_texts(spark):
    """Long texts of mixed lines: their windows have other raw scores."""
    prose, junk = "The river runs past old houses, and under bridges.\n", "BUY!!! $$$ 111 | x |\n"
    rows = [(i, (prose * 90 + junk * 30 if i % 2 else junk * 90 + prose * 30) + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = line_crf.train(docs, labels)
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    quality = np.array([i % 2 for i, _ in known])
    shares = ((quality == 0).sum(), (quality == 1).sum())
    want = line_crf.calibrated(model, model.raw(*line_crf.line_features([t for _, t in known])), quality, shares)
    assert np.allclose((model.slope, model.offset), (want.slope, want.offset))
    assert {r.doc_id % 2 == r.predicted for r in line_crf.scored(docs, model).collect()} == {True}


def test_without_both_classes_every_score_is_a_half(spark, nasty):
    for rows in ([], [(1, 1)]):
        model = line_crf.train(nasty, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert model is None and {r.score for r in line_crf.scored(nasty, model).select("score").collect()} == {0.5}


def test_a_long_text_is_scored_line_by_line():
    features, counts, chars = line_crf.line_features(["a b.\n" * 5000, None, ""])
    assert counts.tolist() == [5001, 1, 1] and features.shape == (5003, line_crf.WIDTH) and np.isfinite(features).all()


@pytest.mark.parametrize("texts", [[], [None], ["x"]])
def test_scores_of_few_texts(texts):
    model = line_crf.Model(np.zeros((line_crf.WIDTH, 2)), np.zeros((2, 2)), 1.0, 0.0)
    assert model.scores(texts).tolist() == [0.5] * len(texts)


def _labelled(spark):
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    return [(r.text or "", r.quality, zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in sorted(texts, key=lambda r: r.doc_id)]


def test_junk_lines_in_good_texts_are_found_line_by_line(spark):
    known = _labelled(spark)
    features, counts, chars = line_crf.line_features([t for t, _, held in known if not held])
    model = line_crf.fit(features, counts, chars, np.array([q for _, q, held in known if not held]))
    rng, junk = np.random.default_rng(8), "BUY!!! $$$ NOW ||| $$$ BUY!!! CLICK >>> 100% FREE ||| $$$ BUY!!!"
    mixed, wanted = [], []
    for text, quality, held in known:
        lines = text.split("\n")
        if held and quality == 1 and len(lines) >= 3:
            at = int(rng.integers(0, len(lines) + 1))
            mixed.append("\n".join([*lines[:at], junk, *lines[at:]]))
            wanted += [True] * at + [False] + [True] * (len(lines) - at)
    features, counts, chars = line_crf.line_features(mixed)
    good = line_crf.marginals(features @ model.weights, counts, model.move)[0][:, 1]
    wanted, good = np.array(wanted)[chars > 0], good[chars > 0]
    assert len(mixed) > 10 and (good[~wanted] < 0.5).mean() >= 0.95 and (good[wanted] >= 0.5).mean() >= 0.95


def test_held_out_ranking(spark):
    known = _labelled(spark)
    features, counts, chars = line_crf.line_features([t for t, _, held in known if not held])
    model = line_crf.fit(features, counts, chars, np.array([q for _, q, held in known if not held]))
    scores, quality = model.scores([t for t, _, held in known if held]), np.array([q for _, q, held in known if held])
    above = (scores[quality == 1][:, None] > scores[quality == 0][None]).mean()
    assert above >= 0.99


def test_whole_documents_are_learnt_from_as_far_as_they_fit(spark, monkeypatch):
    prose, junk = "The river runs past old houses, and under bridges.\n", "BUY!!! $$$ 111 | x |\n"
    docs = spark.createDataFrame([(i, (prose if i % 2 else junk) * (400 if i < 4 else 30)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    real = line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda *a: seen.append(a) or real(*a))
    assert line_crf.train(docs, labels) is not None and max(seen[-1][1]) == 401
    monkeypatch.setattr(line_crf, "SAMPLE_LINES", 100)
    assert line_crf.train(docs, labels) is not None
    counts, of = seen[-1][1], seen[-1][3]
    assert set(counts.tolist()) == {31} and [int(counts[of == k].sum()) for k in (0, 1)] == [93, 93]


def test_copies_of_an_id_count_towards_the_bound(spark, monkeypatch):
    monkeypatch.setattr(line_crf, "SAMPLE_LINES", 50)
    rows = [(0, "BUY!!! $$$")] * 60 + [(2, "BUY!!! $$$ |"), (3, "The old river runs by."), (5, "A house stands there.")]
    labels = spark.createDataFrame([(0, 0), (2, 0), (3, 1), (5, 1)], "doc_id long, quality int")
    seen = []
    real = line_crf.fit
    monkeypatch.setattr(line_crf, "fit", lambda *a: seen.append(a) or real(*a))
    line_crf.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert not seen or len(seen[0][1]) <= 3
