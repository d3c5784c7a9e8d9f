"""Packing into windows by minimum bin slack.

A document's ids are cut into full windows and one remainder. Only the histogram of remainder lengths, at most one count
a length, goes to the driver. There, a bitset dynamic programme over subset sums finds the multiset of remaining lengths
that fills a window closest to its capacity, always with the longest length left, and backtracks the counts; the multiset
is used as often as the histogram allows, so the number of programmes follows the number of lengths, not of documents.
Pieces are then numbered within their length and take the place the plan has for that number.

Defined cases: a null or empty text is its closing id alone; a null doc_id is kept; repeated rows are packed each;
an empty table gives an empty result; other columns are not read. Texts are tokenised whole, whatever their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fleetlens.llm.scratch import Scratch, arrow_map, extended, slices
from fleetlens.llm.tokens import VOCABULARY, encode

END_ID = 0
ROWS_A_RUN = 500  # pieces numbered together at least
RUNS = 20_000  # and runs at most, besides one a length

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt int"


def pieces(docs: DataFrame, window: int, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, salt): full windows and the remainder of each document."""
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                out: dict[str, list] = {name.split()[0]: [] for name in schema.split(", ")}
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    ids = np.append(encode(text, vocabulary), np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        part = ids[start : start + window]
                        crc = zlib.crc32(part.tobytes())
                        out["doc_id"].append(doc_id)
                        out["start"].append(start)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(crc)
                        out["doc_tokens"].append(len(ids))
                        out["salt"].append((crc ^ (crc >> 16)) & 0x7FFFFFFF if doc_id is None else zlib.crc32(f"{doc_id}:{start}".encode()) & 0x7FFFFFFF)
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                kinds = {"salt": pa.int32(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_pydict({name: pa.array(values, kinds.get(name, pa.int64())) for name, values in out.items()})

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the longest among them, whose sum is nearest to the capacity from below."""
    lengths = sorted((length for length, n in counts.items() if n and length <= capacity), reverse=True)
    first, room = lengths[0], capacity - lengths[0]
    reached, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        left = counts[length] - (length == first)
        if length > room or not left:
            continue
        before, unit = reached, 1
        left = min(left, room // length)
        while left:  # counts in powers of two: every number of copies up to the count can be made
            take = min(unit, left)
            reached |= (reached << (length * take)) & mask
            left, unit = left - take, unit * 2
        steps.append((length, before))
        if reached >> room & 1:
            break
    total = reached.bit_length() - 1
    chosen = {first: 1}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = chosen.get(length, 0) + n
    return chosen


@dataclass(frozen=True)
class Use:
    """A multiset that fills ``times`` windows from number ``window`` on."""

    window: int
    times: int
    counts: dict[int, int]


def plan(histogram: dict[int, int], capacity: int) -> list[Use]:
    left = {length: n for length, n in histogram.items() if n}
    uses, window = [], 0
    while left:
        counts = fullest(left, capacity)
        times = min(left[length] // n for length, n in counts.items())
        uses.append(Use(window, times, counts))
        window += times
        for length, n in counts.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return uses


def places(uses: list[Use]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length, in order of its numbers: (first number, copies a window, first window, offset of the first copy)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    for use in uses:
        offset = 0
        for length in sorted(use.counts, reverse=True):
            n = use.counts[length]
            out.setdefault(length, []).append((taken.get(length, 0), n, use.window, offset))
            taken[length] = taken.get(length, 0) + n * use.times
            offset += length * n
    return out


def ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds ``rank``: the number of a piece among those of its length, from 0.

    Pieces of a length are numbered in runs that then move up; a frequent length has more runs, so that no task holds a
    share of the rows that one length has.
    """
    a_run = max(ROWS_A_RUN, sum(histogram.values()) // RUNS)
    runs = F.array(*[F.lit(-(-histogram.get(length, 0) // a_run) or 1) for length in range(max(histogram, default=0) + 1)])
    split = rows.withColumn("run", F.pmod("salt", F.get(runs, F.col("length").cast("int"))))
    counts = split.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "run").orderBy("doc_id", "start", "ids_crc32")
    numbered = split.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "run"]).withColumn("rank", F.col("first") + F.col("place")).drop("run", "first", "place", "salt")


def pack(docs: DataFrame, window: int = 1024, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where asked for."""
    if window < 1:
        raise ValueError("a window takes one token at least")
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.table(pieces(docs, window, vocabulary, end_id, with_ids), "pieces")
    histogram = {int(r.length): int(r["count"]) for r in rows.groupBy("length").count().collect()}  # at most ``window`` rows
    at = places(plan(histogram, window))
    firsts = {length: [entry[0] for entry in entries] for length, entries in at.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                first, copies, window_number, offset = at[length][bisect_right(firsts[length], rank) - 1]
                turn, copy = divmod(rank - first, copies)
                sequences.append(window_number + turn)
                offsets.append(offset + copy * length)
            kept = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                names=[*kept, "sequence_id", "offset"],
            )

    numbered = ranked(rows, histogram)
    return arrow_map(numbered, put, extended([f for f in numbered.schema.fields if f.name != "rank"], "sequence_id long, `offset` long"))
