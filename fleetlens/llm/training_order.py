"""Materialising sequences in training order.

Texts are tokenised and joined, each closed by an end id, into sequences of fixed length. A keyed Feistel permutation of
0 .. N-1 (a power of four, walked along its cycles until the value is below N) gives every sequence its global slot
without a sort or a table. Slots are cut into ranges; one task writes a range as a shard in which every sequence takes
the same number of bytes. So a reader finds slot s at byte (s mod slots a shard) * stride, reads on sequentially, and
can stop and go on anywhere.

Texts are tokenised once, into a table of compressed blocks in the shared folder. Its counts give N and the number of
every sequence; the blocks are then dealt to the shards. A task writes under a name of its own attempt and renames the
file when it is whole, so lost executors leave no half shard. A manifest beside the shards tells key, lengths, ids and a
digest of the blocks. With ``resume`` and the same manifest, shards that are whole are not written again, though their rows
are returned; with another one, or without ``resume``, the shards that are there are removed first. As each input partition
fills up its last sequence, the number of sequences, and with it the digest, depends on how the input is split.

Defined cases: a null or empty text is its end id alone; null ids and repeated rows are kept; the last sequence of a
partition is filled up with ``pad_id``; an empty table gives no shard and no row; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.scratch import Scratch, arrow_map, slices
from fleetlens.llm.tokens import VOCABULARY, encode

END_ID = 50256  # the end-of-text id of the vocabulary
ROUNDS = 6
MANIFEST = "_manifest.json"
SHARD_NAME = re.compile(r"shard-\d{8,}\.bin")
BLOCK = 64  # sequences compressed together in the table of blocks
DEALT = 4096  # sequences a task deals to shards at a time


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0 .. size-1."""

    size: int
    key: int

    @property
    def half_bits(self) -> int:
        return max(1, -(-max(1, self.size - 1).bit_length() // 2))

    def _round(self, value: np.ndarray, number: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = value + np.uint64((self.key * 0x9E3779B97F4A7C15 + (number + 1) * 0xD1B54A32D192ED03) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & np.uint64(2**self.half_bits - 1)

    def _once(self, values: np.ndarray, back: bool) -> np.ndarray:
        bits, low = np.uint64(self.half_bits), np.uint64(2**self.half_bits - 1)
        left, right = values >> bits, values & low
        for number in range(ROUNDS):
            if back:
                left, right = right ^ self._round(left, ROUNDS - 1 - number), left
            else:
                left, right = right, left ^ self._round(right, number)
        return (left << bits) | right

    def _walk(self, values: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(values, dtype=np.uint64), back)
        outside = out >= np.uint64(self.size)
        while outside.any():
            out[outside] = self._once(out[outside], back)
            outside = out >= np.uint64(self.size)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, back=False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, back=True)


def sequences(batches: Iterator[pa.RecordBatch], length: int, vocabulary: str, end_id: int, pad_id: int) -> Iterator[tuple[np.ndarray, int, int | None, int]]:
    """(ids, number of them before the padding, doc_id of the first, its ids before) for one partition, in its order."""
    held, first, count = [], None, 0
    for batch in batches:
        for piece in slices(batch, "text"):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                ids = np.append(encode(text, vocabulary), np.uint32(end_id))
                at = 0
                while at < len(ids):
                    if not count:
                        first = (doc_id, at)
                    part = ids[at : at + length - count]
                    held.append(part)
                    count, at = count + len(part), at + len(part)
                    if count == length:
                        yield np.concatenate(held), length, *first
                        held, count = [], 0
    if count:
        yield np.concatenate([*held, np.full(length - count, pad_id, np.uint32)]), count, *first


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_name(number: int) -> str:
    return f"shard-{number:08d}.bin"


def whole_shards(uri: str, total: int, a_shard: int, stride: int) -> set[int]:
    """The shards below ``uri`` that have all their bytes."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    sizes = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True))}
    return {k for k in range(-(-total // a_shard)) if sizes.get(shard_name(k)) == min(a_shard, total - k * a_shard) * stride}


def same_manifest(uri: str, manifest: dict) -> bool:
    from pyarrow import fs

    system, path = _filesystem(uri)
    if system.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.File:
        return False
    with system.open_input_file(f"{path}/{MANIFEST}") as file:
        return json.loads(file.read()) == manifest


def begin_anew(uri: str, manifest: dict) -> None:
    """Removes the manifest first, then the shards, and writes the new manifest: a stop between leaves nothing to resume."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    system.create_dir(path, recursive=True)
    names = {f.base_name for f in system.get_file_info(fs.FileSelector(path))}
    for name in [n for n in names if n == MANIFEST] + [n for n in names if SHARD_NAME.fullmatch(n)]:
        system.delete_file(f"{path}/{name}")
    with system.open_output_stream(f"{path}/{MANIFEST}") as stream:
        stream.write(json.dumps(manifest).encode())


def stored_blocks(docs: DataFrame, length: int, kind: np.dtype, vocabulary: str, end_id: int, pad_id: int) -> DataFrame:
    """Rows (part, number, n_tokens, doc_ids, starts, ids): ``BLOCK`` sequences in a row, by input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, number, squeeze, held = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3), []

        def block() -> pa.RecordBatch:
            ids, counts, doc_ids, starts = zip(*held)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int64()), "n_tokens": pa.array([list(counts)], pa.list_(pa.int32())),
                "doc_ids": pa.array([list(doc_ids)], pa.list_(pa.int64())), "starts": pa.array([list(starts)], pa.list_(pa.int64())),
                "ids": pa.array([squeeze.compress(np.concatenate(ids).astype(kind).tobytes())], pa.binary()),
            })

        for sequence in sequences(batches, length, vocabulary, end_id, pad_id):
            held.append(sequence)
            if len(held) == BLOCK:
                yield block()
                number, held = number + BLOCK, []
        if held:
            yield block()

    return arrow_map(docs, run, "part int, number long, n_tokens array<int>, doc_ids array<long>, starts array<long>, ids binary")


def materialise(
    docs: DataFrame, uri: str, key: int, length: int = 2048, shard_bytes: int = 32 << 20, vocabulary: str = VOCABULARY,
    end_id: int = END_ID, pad_id: int = 0, resume: bool = False,
) -> DataFrame:
    """Writes the shards when an action runs on the result, and gives a row per sequence, those of resumed shards too.

    slot, shard, byte_offset, n_tokens (without padding), ids_crc32 (of its bytes), first_doc_id, first_start (ids of that
    document before the sequence). Ids are little-endian, of two bytes if the vocabulary allows.
    """
    kind = np.dtype("<u2") if vocabulary == VOCABULARY else np.dtype("<u4")
    stride = length * kind.itemsize
    a_shard = max(1, shard_bytes // stride)
    scratch = Scratch(docs.sparkSession, "training-blocks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.table(stored_blocks(rows, length, kind, vocabulary, end_id, pad_id), "blocks")

    counts = {r.part: int(r.n) for r in blocks.groupBy("part").agg(F.sum(F.size("n_tokens")).alias("n")).collect()}  # a row per input partition
    firsts, total = {}, 0
    for part in sorted(counts):
        firsts[part], total = total, total + counts[part]
    order = Permutation(max(1, total), key)
    # Equal whatever the order of the blocks: sums of hashes, as decimals, which do not overflow.
    content = F.xxhash64("part", "number", "n_tokens", "doc_ids", "starts", "ids").cast("decimal(38,0)")
    manifest = {
        "key": key, "length": length, "sequences": total, "slots_a_shard": a_shard, "bytes_an_id": kind.itemsize, "vocabulary": vocabulary.rsplit("/", 1)[-1],
        "end_id": end_id, "pad_id": pad_id, "blocks": str(blocks.agg(F.sum(content)).first()[0]),
    }
    resumed = resume and same_manifest(uri, manifest)
    if not resumed:
        begin_anew(uri, manifest)
    done = whole_shards(uri, total, a_shard, stride) if resumed else set()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, expand, held, waiting = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor(), [], 0

        def dealt() -> pa.RecordBatch:
            numbers, n_tokens, doc_ids, starts, ids = (np.concatenate([h[k] for h in held]) for k in range(5))
            slots = order.slots(numbers)
            shards = slots // a_shard
            out = {name: [] for name in ("shard", "slots", "n_tokens", "doc_ids", "starts", "ids")}
            by_slot = np.argsort(slots, kind="stable")
            for rows_of in np.split(by_slot, np.flatnonzero(np.diff(shards[by_slot])) + 1):
                shard = int(shards[rows_of[0]])
                out["shard"].append(shard)
                out["slots"].append(slots[rows_of])
                out["n_tokens"].append(n_tokens[rows_of].astype(np.int32))
                out["doc_ids"].append([doc_ids[i] for i in rows_of])
                out["starts"].append(starts[rows_of])
                out["ids"].append(squeeze.compress(ids[rows_of].tobytes()))
            kinds = {"shard": pa.int32(), "n_tokens": pa.list_(pa.int32()), "ids": pa.binary()}
            return pa.RecordBatch.from_pydict({name: pa.array(values, kinds.get(name, pa.list_(pa.int64()))) for name, values in out.items()})

        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["n_tokens"])
                first = firsts[row["part"]] + row["number"]
                held.append((
                    np.arange(first, first + n, dtype=np.uint64), np.array(row["n_tokens"]), np.array(row["doc_ids"], dtype=object), np.array(row["starts"], np.int64),
                    np.frombuffer(expand.decompress(row["ids"]), kind).reshape(n, length),
                ))
                waiting += n
                if waiting >= DEALT:
                    yield dealt()
                    held, waiting = [], 0
        if held:
            yield dealt()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        (system, path), expand = _filesystem(uri), zstandard.ZstdDecompressor()
        system.create_dir(path, recursive=True)
        attempt, now, held = TaskContext.get().taskAttemptId(), None, []

        def whole() -> pa.RecordBatch:
            # One shard at a time: ``shard_bytes`` of ids.
            slots = np.concatenate([np.array(row["slots"], np.int64) for row in held])
            expected = min(a_shard, total - now * a_shard)
            if len(slots) != expected:
                raise RuntimeError(f"shard {now} has {len(slots)} of {expected} sequences")
            place = np.argsort(slots, kind="stable")
            records = np.empty((expected, length), kind)
            for row in held:
                n = len(row["slots"])
                records[np.array(row["slots"], np.int64) - now * a_shard] = np.frombuffer(expand.decompress(row["ids"]), kind).reshape(n, length)
            if now not in done:
                temporary = f"{path}/_writing-{now}-{attempt}"
                with system.open_output_stream(temporary) as stream:
                    stream.write(records.tobytes())
                system.move(temporary, f"{path}/{shard_name(now)}")
            gathered = {name: [v for row in held for v in row[name]] for name in ("n_tokens", "doc_ids", "starts")}
            return pa.RecordBatch.from_pydict({
                "slot": pa.array(slots[place]), "shard": pa.array(np.full(expected, now, np.int32)),
                "byte_offset": pa.array(np.arange(expected, dtype=np.int64) * stride), "n_tokens": pa.array([gathered["n_tokens"][i] for i in place], pa.int32()),
                "ids_crc32": pa.array([zlib.crc32(record.tobytes()) for record in records], pa.int64()),
                "first_doc_id": pa.array([gathered["doc_ids"][i] for i in place], pa.int64()),
                "first_start": pa.array([gathered["starts"][i] for i in place], pa.int64()),
            })

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if held:
                        yield whole()
                    now, held = row["shard"], []
                held.append(row)
        if held:
            yield whole()

    placed = arrow_map(blocks, deal, "shard int, slots array<long>, n_tokens array<int>, doc_ids array<long>, starts array<long>, ids binary")
    ranged = placed.repartitionById(max(1, -(-total // a_shard)), F.col("shard")).sortWithinPartitions("shard")
    return arrow_map(ranged, write, "slot long, shard int, byte_offset long, n_tokens int, ids_crc32 long, first_doc_id long, first_start long")


def read_from(uri: str, slot: int, length: int, a_shard: int, width: int = 2) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in training order, shard after shard."""
    from pyarrow import fs

    system, path = _filesystem(uri)
    stride, number, within = length * width, slot // a_shard, slot % a_shard
    while system.get_file_info(f"{path}/{shard_name(number)}").type == fs.FileType.File:
        with system.open_input_file(f"{path}/{shard_name(number)}") as file:
            file.seek(within * stride)
            while len(record := file.read(stride)) == stride:
                yield np.frombuffer(record, f"<u{width}")
        number, within = number + 1, 0
