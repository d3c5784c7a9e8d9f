from collections import Counter, defaultdict

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from fleetlens.llm import cleaning, line_crf
from fleetlens.llm.scratch import Scratch
from fleetlens.llm.tokens import VOCABULARY, _exact, encode
from fleetlens.llm.shingles import words

FOLDER = "/root/testdata/sf0.01"


def smallest_of_components(rows, size, percent):
    """The smallest id that each id reaches over links, from an index of shingles."""
    sets = {}
    for doc_id, text in rows:
        w = words(text)
        sets[doc_id] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    index, root = defaultdict(list), {i: i for i in sets}
    for i, own in sets.items():
        for shingle in own:
            index[shingle].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in sets.items():
        for j, n in Counter(j for shingle in own for j in index[shingle] if j < i).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave."""
    scratch, docs, out = Scratch(spark, "stages"), spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = scratch.table(stage(spark, docs, FOLDER), str(k))
        out.append((name, docs, made))
        docs = made
    return out


def test_the_order_of_the_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "quality rules", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_all_but_the_last_keep_the_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_rejected_documents_go(spark, stages):
    _, docs, kept = stages[0]
    model = line_crf.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = {r.doc_id for r in docs.collect() if model.scores([r.text])[0] >= 0.5}
    assert {r.doc_id for r in kept.collect()} == good
    _, docs, kept = stages[1]
    judged = {r.doc_id: r for r in cleaning.with_counts(docs).collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (r.clean_text, len(r.clean_text)) for i, r in judged.items() if r.kept}


def test_clean_documents_stay(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    first = {r.doc_id for r in stages[0][2].collect()}
    assert sum(labels[i] == 1 and i not in first for i in labels) <= 0.02 * len(labels) and sum(labels[i] == 0 and i in first for i in labels) <= 2


def test_one_document_of_each_group_stays(stages):
    _, docs, kept = stages[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in kept.collect()} == set(smallest_of_components(rows, 5, 80).values())


def test_sources_come_near_their_targets(stages):
    _, docs, mixed = stages[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= set(texts) and all(r.text == texts[r.doc_id] for r in mixed.collect())
    words = sum(len(t.split()) for t in texts.values())
    assert abs(sum(n * len(texts[i].split()) for i, n in copies.items()) - words) < 0.05 * words


def test_every_token_is_packed_once(stages):
    _, docs, packed = stages[4]
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(encode(r.text)) + 1
    got, places = Counter(), defaultdict(list)
    for r in packed.collect():
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_equals_the_stages(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == Counter(map(tuple, stages[-1][2].collect()))


def test_nasty_rows_and_nothing(spark, nasty, nothing):
    scratch = Scratch(spark, "nasty")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for docs, name in ((nasty, "rows"), (nothing, "none")):
            made = scratch.table(stage(spark, docs, FOLDER), f"{name}-{k}")
            if k < 4:
                assert made.dtypes == docs.dtypes
            assert name == "rows" or made.count() == 0
    groups = corpus_pipeline.deduplicate(spark, nasty, FOLDER).collect()
    ids = [r.doc_id for r in groups if r.doc_id is not None]
    assert sorted(ids) == [1, 3, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 15] and sum(r.doc_id is None for r in groups) == 2


def test_rows_of_one_id_and_rows_without_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " x"), (None, a), (None, a), (None, "c " + b[:40]), (None, None), (None, None), (3, b)]
    kept = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), FOLDER).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, a), (1, b), (None, "c " + b[:40]), (None, None), (None, None)])


def test_a_million_blanks_are_packed(spark):
    rows = [(1, " " * 1_000_000 + "a"), (2, "a\t" + "\n" * 1_000_000), (3, "x" * 300_000), (4, "\t" * 1_000_000 + "b c")]
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == {i: len(_exact(VOCABULARY).encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_join_leaves_no_shuffle_files_when_texts_are_read(spark, shuffle_files):
    texts = [" ".join(f"w{family}-{k}" for k in range(40)) + tail for family in range(8) for tail in ("", " end", " other")]
    docs = spark.createDataFrame([(k, text, "en", "s", len(text)) for k, text in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()
    assert docs.count() == 24
    left, kept = shuffle_files(lambda: corpus_pipeline.deduplicate(spark, docs, ""))
    assert not left and sorted(r.doc_id for r in kept.collect()) == list(range(0, 24, 3))
