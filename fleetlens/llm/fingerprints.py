"""One-permutation MinHash with optimal densification and packed low-order bits.

Each shingle hash falls into one of ``BINS`` bins by its high bits; a bin keeps the low-order byte of its smallest hash.
An empty bin copies the first filled bin in an order of its own, the same for all texts. Two fingerprints agree in a bin
with probability J + (1 - J) / 256, from which the likeness is corrected.

Defined cases: texts without words (null, empty, white space) have the empty fingerprint, like only to one another;
texts of fewer words than a shingle are one shingle; a null id comes after all others in descending order; rows of one id
follow each other by a hash of their text; with one row, that row is its own next; an empty table gives an empty result.
Texts are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.scratch import arrow_map
from fleetlens.llm.shingles import shingle_sets

BINS = 256
SHINGLE = 5
PARTITION_BYTES = 32 << 20
CELLS_A_RANGE = 4
WEIGHT_BYTES = 4096  # a text counts once more for each of these when cells are cut
LOWEST = -(2**63)


def _orders() -> np.ndarray:
    """For each bin the bins in an order of its own: by a hash of both numbers."""
    n = np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        n = n * np.uint64(0x9E3779B97F4A7C15)
        n = (n ^ (n >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        n = (n ^ (n >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.argsort((n ^ (n >> np.uint64(31))).reshape(BINS, BINS), axis=1, kind="stable")


ORDERS = _orders()
EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 8)


def fingerprint(tokens: np.ndarray) -> bytes:
    """``tokens``: the distinct shingle hashes of a text, sorted."""
    if not len(tokens):
        return b""
    first = np.searchsorted(tokens, EDGES)
    filled = np.diff(first, append=len(tokens)) > 0
    low = np.zeros(BINS, np.uint8)
    low[filled] = (tokens[first[filled]] & np.uint64(0xFF)).astype(np.uint8)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = ORDERS[empty]
        low[empty] = low[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return low.tobytes()


def likeness(one: bytes, two: bytes) -> float:
    """The Jaccard similarity that two fingerprints tell, from 0 to 1."""
    if not one or not two:
        return float(one == two)
    same = float(np.mean(np.frombuffer(one, np.uint8) == np.frombuffer(two, np.uint8)))
    return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``fingerprint`` (hexadecimal) to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prints = [fingerprint(tokens).hex() for begin in range(0, len(texts), 256) for tokens in shingle_sets(texts[begin : begin + 256], shingle)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.string())], names=[*batch.schema.names, "fingerprint"])

    rows = docs.select("doc_id", "text")
    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, range, tail), in descending order of doc_id within each range, one range after another.

    Cells are cut by quantiles of the ids, weighed by the lengths of their texts; at an id with many rows (or at the missing one) by hashes of the texts too; cells
    next to each other make a range of about ``PARTITION_BYTES``, a partition of its own. The first row of the range that
    follows is added to each as its tail (to the last, the first row of all), so every row finds the next one in its own
    range and the texts are exchanged once. The driver holds the cuts and a key for each of ``CELLS_A_RANGE`` cells a range.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.xxhash64("text").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shares = [i / 1024 for i in range(1025)]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    weighed = keyed.select(size.alias("size"), F.posexplode(F.array_repeat("key", 1 + (size / WEIGHT_BYTES).cast("int"))).alias("time", "key"))
    stats = weighed.agg(F.percentile_approx("key", shares, 10_000).alias("at"), F.sum(F.when(F.col("time") == 0, F.col("size"))).alias("bytes")).first()
    if stats.at is None:
        return keyed.select("doc_id", "text", F.lit(0).alias("range"), F.lit(False).alias("tail"))
    cells = CELLS_A_RANGE * max(1, -(-int(stats.bytes or 0) // PARTITION_BYTES))
    at = np.array(stats.at, dtype=np.float64)
    cuts, times = np.unique(np.interp(np.linspace(0, 1024, cells + 1)[1:-1], np.arange(1025), at).astype(np.int64), return_counts=True)
    before, steps = np.concatenate([[0], np.cumsum(times)]), np.uint64(2**64 - 1) // times.astype(np.uint64)

    def number(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Cells by (key, hash), the largest first. An id at which several cuts fall is cut by as many hashes."""
        if not len(cuts):
            return np.zeros(len(keys), np.int32)
        found = np.searchsorted(cuts, keys, side="left")
        place = np.minimum(found, len(cuts) - 1)
        shifted = hashes.astype(np.int64).view(np.uint64) ^ np.uint64(2**63)
        among = 1 + np.minimum((shifted // steps[place]).astype(np.int64), times[place] - 1)
        return (before[-1] - before[found] - np.where(cuts[place] == keys, among, 0)).astype(np.int32)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = number(batch.column("key").to_numpy(), batch.column("hash").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=["key", "hash", "bytes", "cell"])

    sized = keyed.select("key", "hash", size.alias("bytes"))
    counted = arrow_map(sized, heads, "key long, hash long, bytes long, cell int").groupBy("cell")
    range_of, found, held = np.zeros(before[-1] + 1, np.int32), [], 0
    for row in sorted(counted.agg(F.max(F.struct("key", "hash")).alias("head"), F.sum("bytes").alias("bytes")).collect()):
        if not found or held + row.bytes > PARTITION_BYTES:
            found.append((len(found), row["head"]["key"], row["head"]["hash"]))
            held = 0
        held += row.bytes
        range_of[row.cell] = len(found) - 1
    # The head of each range is the tail of the one before; that of the first range, of the last one.
    tails = {(key, hash_): found[i - 1][0] for i, (_, key, hash_) in enumerate(found)}
    tail_keys = np.array([key for key, _ in tails], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "key", "hash", "range", "tail"]
        for batch in batches:
            keys = batch.column("key").to_numpy()
            columns = [batch.column(c) for c in ("doc_id", "text", "key", "hash")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range_of[number(keys, batch.column("hash").to_numpy())]), pa.array(np.zeros(len(keys), bool))], names=names)
            for row in np.flatnonzero(np.isin(keys, tail_keys)):
                to = tails.get((int(keys[row]), batch.column("hash")[int(row)].as_py()))
                if to is not None:
                    one = [c.slice(int(row), 1) for c in columns]
                    yield pa.RecordBatch.from_arrays([*one, pa.array([to], pa.int32()), pa.array([True])], names=names)

    routed = arrow_map(keyed, route, "doc_id long, text string, key long, hash long, range int, tail boolean")
    return routed.repartitionById(max(1, len(found)), F.col("range")).sortWithinPartitions("range", "tail", F.desc("key"), F.desc("hash"))


def with_next(docs: DataFrame, shingle: int = SHINGLE, slice_bytes: int = 1_500_000) -> DataFrame:
    """Fingerprints of each text, of the text edited with its next document, and their likenesses."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    columns = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        texts = [text for _, text, _ in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = [fingerprint(tokens) for tokens in shingle_sets(texts + changed, shingle)]
        own, other = prints[: len(texts)], prints[len(texts) :]
        out = [
            (doc_id, len(text), hashlib.sha256(changed[i].encode("utf-8")).hexdigest(), own[i].hex(), other[i].hex(), likeness(own[i], other[i]), likeness(own[i], own[i + 1]))
            for i, (doc_id, text, tail) in enumerate(rows[:-1]) if not tail
        ]
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)] if out else [pa.array([], kind) for kind in kinds], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now = [], 0, None
        for batch in batches:
            for doc_id, text, number, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "tail"))):
                if number != now:
                    if len(rows) > 1:
                        yield answer(rows)
                    rows, held, now = [], 0, number
                rows.append((doc_id, text or "", tail))
                held += len(text or "")
                if held > slice_bytes and len(rows) > 1:
                    yield answer(rows)
                    rows, held = rows[-1:], len(rows[-1][1])
        if len(rows) > 1:
            yield answer(rows)

    return arrow_map(in_order(docs).select("doc_id", "text", "range", "tail"), run, schema)
