"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id). Splitters between shards are sought by counting the exact bytes below
candidate boundaries over all partitions; each round refines the probes around the targets only, until every splitter
meets the tolerance. Then the rows are exchanged once.

Defined cases: a null text is empty; a null id sorts before all others; equal rows (same id, same text) share a key and
are never parted; an empty table gives an empty result. Copies of a text stay together, unless keeping them together
would miss the target by more than ``split_tolerance`` of a shard: then the group is cut between neighbours by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens.llm.scratch import Scratch, text_or_empty

LOWEST = -(2**63)
FAN_OUT_BITS = 8  # probes a round puts between two boundaries, as a power of two
ROWS_A_RUN = 100_000  # rows that one task puts in order, about
PLACE_BITS = 33  # of monotonically_increasing_id: the place in the partition


@dataclass(frozen=True)
class Splitter:
    """The first key of a shard: rows below (hash, id) go to the shards before it."""

    hash: int
    id: int = LOWEST


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    text = text_or_empty(text_column)
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("key_hash"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("key_id"),
    )


def _histogram(rows: DataFrame, column: str, low: int, step_bits: int, cells: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Exact bytes per probe interval of ``2**step_bits`` values, within the given (low, high) cells of the column."""
    value = F.col(column)
    near = None
    for begin, end in cells:
        inside = (value >= F.lit(begin)) & (value <= F.lit(end))
        near = inside if near is None else near | inside
    # An arithmetic shift keeps the order of signed numbers.
    probe = F.shiftright(value, step_bits)
    found = rows.where(near).groupBy(probe.alias("probe")).agg(F.sum("size").alias("bytes")).collect()
    return {int(r.probe): int(r.bytes) for r in found}


def _locate(rows: DataFrame, column: str, low: int, high: int, targets: list[int], close: float) -> list[tuple[int, int, int, int]]:
    """For each target: (value, bytes below it, next value, bytes below that), the edges nearest to the target.

    A driver-side list holds 2**FAN_OUT_BITS intervals a target and round, whatever the number of rows.
    """
    span_bits = max(1, (high - low).bit_length())
    state = {t: (low, high, 0) for t in set(targets)}  # cell and the bytes below it
    done: dict[int, tuple[int, int, int, int]] = {}
    bits = max(0, span_bits - FAN_OUT_BITS)
    while state:
        cells = sorted({(a, b) for a, b, _ in state.values()})
        counts = _histogram(rows, column, low, bits, cells)
        for target, (begin, end, below) in list(state.items()):
            total = below
            for probe in sorted(p for p in counts if begin <= (p << bits) + (2**bits - 1) and (p << bits) <= end):
                first, last = max(begin, probe << bits), min(end, (probe << bits) + 2**bits - 1)
                if total + counts[probe] >= target:
                    edges = (first, total, last + 1, total + counts[probe])
                    if bits == 0 or min(target - total, total + counts[probe] - target) <= close:
                        done[target] = edges
                        del state[target]
                    else:
                        state[target] = (first, last, total)
                    break
                total += counts[probe]
            else:  # beyond the last row
                done[target] = (end, total, end + 1, total)
                del state[target]
        bits = max(0, bits - FAN_OUT_BITS)
    return [done[t] for t in targets]


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.002, split_tolerance: float = 0.02) -> list[Splitter]:
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    share = total / shards
    targets = [round(share * k) for k in range(1, shards)]
    found: list[Splitter] = []
    edges = _locate(rows, "key_hash", -(2**63), 2**63 - 1, targets, tolerance * share)
    for target, (first, below, after, upto) in zip(targets, edges):
        low_gap, high_gap = target - below, upto - target
        if min(low_gap, high_gap) <= split_tolerance * share or after - first > 1:
            value = first if low_gap <= high_gap else after
            found.append(Splitter(min(value, 2**63 - 1)))
            continue
        group = rows.where(F.col("key_hash") == F.lit(first))
        ids = group.agg(F.min("key_id"), F.max("key_id")).first()
        ((a, a_below, b, b_below),) = _locate(group, "key_id", ids[0], ids[1], [low_gap], tolerance * share)
        found.append(Splitter(first, a) if low_gap - a_below <= b_below - low_gap else Splitter(first, b))
    return sorted(found, key=lambda s: (s.hash, s.id))


def shard_of(marks: list[Splitter]) -> Column:
    number = F.lit(0)
    for mark in marks:
        above = (F.col("key_hash") > F.lit(mark.hash)) | (
            (F.col("key_hash") == F.lit(mark.hash)) & (F.col("key_id") >= F.lit(mark.id))
        )
        number = number + above.cast("int")
    return number


def numbered(rows: DataFrame, group: str, scratch: Scratch, slot: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without a gap, by (key_hash, key_id).

    Rows are exchanged once, into sorted key ranges of about ``ROWS_A_RUN`` rows. A row's number is its place in its
    range and the rows of its group in the ranges before. A group may hold any share of the rows: the last part of the
    key is the number of the row, so that ranges can be cut inside rows of one id and text, and the size of a range
    decides cost only. ``group`` must not fall as keys rise.
    """
    ranges = max(1, -(-rows.count() // ROWS_A_RUN))
    order = [group, "key_hash", "key_id", "_row"]
    sorted_rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # Of a stored, sorted partition the number of a row is the partition above PLACE_BITS and the place in it below.
    ranged = scratch.table(sorted_rows.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranged")
    run = F.shiftright("_at", PLACE_BITS)
    counts = ranged.groupBy(group, run.alias("_run")).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_run", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_moved"))
    placed = ranged.withColumn("_run", run).join(starts, [group, "_run"])
    return placed.withColumn(slot, F.col("_at") + F.col("_moved")).drop("_run", "_at", "_moved")


def shard_by_bytes(
    docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text",
    tolerance: float = 0.002, split_tolerance: float = 0.02,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (its number in the shard, from 0)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.table(keyed(docs, id_column, text_column), "keys")
    marks = splitters(rows, shards, tolerance, split_tolerance)
    placed = numbered(rows.withColumn("shard", shard_of(marks)), "shard", scratch)
    scratch.drop("keys")
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")
