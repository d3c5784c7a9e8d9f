import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from fleetlens.llm import packing
from fleetlens.llm.queries import QUERIES
from fleetlens.llm.tokens import PLAIN, encode


def reference():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


REFERENCE = reference()
ALPHABET = st.characters(min_codepoint=1, max_codepoint=0x2FF) | st.sampled_from("  　漢字🙂é<|endoftext|>'s \n\t")


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=60))
def test_ids_are_those_of_the_tokenizers_library(text):
    assert encode(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(min_codepoint=0x20, max_codepoint=0x24F), max_size=80))
def test_the_fast_way_gives_the_same_ids(text):
    assert not PLAIN.match(text) or encode(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


def test_special_strings_are_ordinary_text():
    assert 50256 not in encode("a <|endoftext|> b").tolist() and encode(None).tolist() == encode("").tolist() == []


def best(counts, capacity):
    """The largest sum of a multiset with its longest length, by trying all sums."""
    first = max(counts)
    sums = {0}
    for length, n in counts.items():
        for _ in range(n - (length == first)):
            sums |= {s + length for s in sums if s + length <= capacity - first}
    return first + max(sums)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 7), min_size=1, max_size=9))
def test_a_window_is_filled_as_full_as_can_be(counts):
    chosen = packing.fullest(counts, 40)
    assert all(n <= counts[length] for length, n in chosen.items()) and chosen[max(counts)] >= 1
    assert sum(length * n for length, n in chosen.items()) == best(counts, 40)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_the_plan_uses_every_piece_once(counts):
    uses = packing.plan(counts, 64)
    used = Counter()
    for use in uses:
        assert sum(length * n for length, n in use.counts.items()) <= 64
        for length, n in use.counts.items():
            used[length] += n * use.times
    assert used == Counter(counts) and [u.window for u in uses] == [sum(v.times for v in uses[:k]) for k in range(len(uses))]
    assert len(uses) <= 2 * len(counts) + 1 or len(uses) <= sum(counts.values())


def check(rows, texts, window):
    ids = {k: np.append(encode(t), np.uint32(0)).astype("<u4") for k, t in texts.items()}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, own in ids.items():
        at = 0
        for start, length in sorted(covered[doc_id]):
            assert start == at
            at += length
        assert at == len(own)
    fills = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) <= window and sorted(sequences) == list(range(len(sequences)))
    return fills


def test_round_trip_and_little_padding(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    fills = check(QUERIES["op9_minimum_slack"](spark, folder).collect(), texts, 1024)
    assert sum(1024 - f for f in fills) < 0.01 * sum(fills)


def test_hot_lengths_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_RUN", 3)
    texts = {i: "same text" for i in range(200)} | {i: "x " * (i % 37) for i in range(200, 300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    check(packing.pack(df, window=16).collect(), texts, 16)


def test_nasty_rows(spark, nasty, nothing):
    rows = packing.pack(nasty, window=64, with_ids=True).collect()
    want = Counter()
    for r in nasty.collect():
        ids = np.append(encode(r.text), np.uint32(0))
        for start in range(0, len(ids), 64):
            want[r.doc_id, start, tuple(ids[start : start + 64].tolist())] += 1
    assert Counter((r.doc_id, r.start, tuple(r.ids)) for r in rows) == want
    places = [(r.sequence_id, r.offset) for r in rows]
    assert len(set(places)) == len(places) and max(r.offset + r.length for r in rows) <= 64
    assert packing.pack(nothing).count() == 0
