"""Repair of damaged conversations: the cheapest edits to a legal order of roles, by Four-Russians block tables.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. Edits, one letter each: Keep costs 0, Rerole
(to user or assistant) 1, Delete 2, Insert (an empty user or assistant turn, anywhere) 5; a truncated turn that is not
deleted adds 5; blank and duplicate turns must be deleted. Of the cheapest audits (letters in order) the ASCII-least counts.

The method. What lies before a turn matters only through one of four states (nothing, s, u, a), so the cost of
finishing from there is a vector of four numbers. Less its minimum it is one of a few dozen vectors, as no two entries can
differ by more than a few edits. For every such vector and every block of ``BLOCK`` symbols a table gives the vector before
the block and the cost that was taken off. Turns are looked up a block at a time from the last to the first; the trace
runs the other way, expands each block into its inner vectors and takes, at each turn, the least letter that keeps the
cost: as a letter leads from a state to one state only, this settles ties exactly.

How it runs. Turns are put in order by range partitions and stored once with their position. ``CHUNK`` positions of a
conversation are one row of symbols (a byte a turn). Two streams over sorted partitions follow: chunks from the last to the first
carry one vector, then chunks and texts from the first to the last carry a state and a running SHA-256. Nothing of a conversation
is held but a chunk and the audit that is returned, so a conversation may have any length; as a hash has to read its text
in order, one conversation's text passes through one task.

Defined cases: a null role or text is one space; an empty or unknown role has no legal initial, so its turn is reroled or
deleted; turns go by number (nulls first), then role, then text; rows that agree in all three are duplicates but for the
first; a null ``conv_id`` is a conversation of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.scratch import Scratch, arrow_map

BLOCK = 4  # symbols a table lookup
CHUNK_BITS = 16  # positions a chunk, as a power of two: 65,536 turns
INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5

BLANKS = " \t\n\v\f\r"
# States: nothing yet, after s, after u, after a. What an initial leads to, and what an inserted or reroled turn leads to.
STATES, FINAL = range(4), (0, INSERT * 2, INSERT, 0)
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURNS = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
# A stored symbol is initial + 4 * fault, a table symbol initial + 4 * truncated, or DROP.
INITIALS, FAULTS = "sua?", ("whole", "truncated", "blank", "duplicate")
DROP = 8
SYMBOLS = DROP + 1
TO_TABLE = np.array([0, 1, 2, 3, 4, 5, 6, 7] + [DROP] * 8, np.int64)
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _options(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of the edits that take one turn."""
    yield "D", DELETE, state
    if symbol != DROP:
        cut = CUT if symbol >= 4 else 0
        kept = KEEPS[state].get(INITIALS[symbol % 4])
        if kept is not None:
            yield "K", cut, kept
        yield "R", REROLE + cut, TURNS[state]


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs of finishing in front of a turn, from those behind it."""
    cost = [min(c + after[to] for _, c, to in _options(symbol, s)) for s in STATES]
    for _ in range(2):  # u and a may each be reached by an insertion from the other; nothing and s from u
        cost = [min(cost[s], INSERT + cost[TURNS[s]]) for s in STATES]
    return tuple(cost)


class Tables:
    """Vectors that can occur, and for each of them and each block the vector before it and the cost taken off."""

    def __init__(self) -> None:
        self.vectors, ids = [FINAL], {FINAL: 0}
        step, taken = [], []
        for vector in self.vectors:  # grows while new vectors appear
            row, off = [], []
            for symbol in range(SYMBOLS):
                cost = _before(vector, symbol)
                least = min(cost)
                normal = tuple(c - least for c in cost)
                if normal not in ids:
                    ids[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append(ids[normal])
                off.append(least)
            step.append(row)
            taken.append(off)
        self.step, self.taken = np.array(step, np.int32), np.array(taken, np.int32)
        # A block's number has its last symbol in the highest place: longer blocks add a symbol in front.
        block, cost = self.step, self.taken
        for _ in range(BLOCK - 1):
            cost = (cost[:, :, None] + self.taken[block]).reshape(len(block), -1)
            block = self.step[block].reshape(len(block), -1)
        self.block, self.cost = block, cost
        self.letters = [[[self._trace(v, y, s) for s in STATES] for y in range(SYMBOLS)] for v in range(len(self.vectors))]

    def _trace(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """The least letters up to the edit that takes this turn, and the state behind it."""
        behind = self.vectors[after]
        cost = _before(behind, symbol)
        options = {letter: (c, to) for letter, c, to in _options(symbol, state)}
        if options["D"][0] + behind[state] == cost[state]:
            return "D", state
        if INSERT + cost[TURNS[state]] == cost[state]:
            letters, end = self._trace(after, symbol, TURNS[state])
            return "I" + letters, end
        for letter in "KR":
            if letter in options and options[letter][0] + behind[options[letter][1]] == cost[state]:
                return letter, options[letter][1]
        raise AssertionError("no edit gives the cost")

    def back(self, symbols: np.ndarray, vector: int) -> tuple[int, int, list[int]]:
        """Vector and cost in front of the symbols, and the vectors behind each whole block, last block first."""
        numbers = self._numbers(symbols)
        total, behind = 0, []
        for number in numbers:
            behind.append(vector)
            total += int(self.cost[vector, number])
            vector = int(self.block[vector, number])
        for symbol in symbols[: len(symbols) % BLOCK][::-1].tolist():
            total += int(self.taken[vector, symbol])
            vector = int(self.step[vector, symbol])
        return vector, total, behind

    def _numbers(self, symbols: np.ndarray) -> list[int]:
        whole = symbols[len(symbols) % BLOCK :].reshape(-1, BLOCK)[::-1, ::-1]
        return (whole @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()

    def expand(self, symbols: list[int], vector: int, state: int) -> tuple[list[str], int]:
        """Letters of each turn of a block, from the vector behind it and the state in front."""
        inner = [vector]
        for symbol in symbols[:0:-1]:
            inner.append(int(self.step[inner[-1], symbol]))
        letters = []
        for symbol, behind in zip(symbols, reversed(inner)):
            found, state = self.letters[behind][symbol][state]
            letters.append(found)
        return letters, state

    def trace(self, symbols: np.ndarray, vector: int, state: int) -> tuple[list[str], int]:
        front, _, behind = self.back(symbols, vector)
        odd = len(symbols) % BLOCK
        first = int(self.block[behind[-1], self._numbers(symbols)[-1]]) if behind else vector
        letters, state = self.expand(symbols[:odd].tolist(), first, state)
        for begin, after in zip(range(odd, len(symbols), BLOCK), reversed(behind)):
            found, state = self.expand(symbols[begin : begin + BLOCK].tolist(), after, state)
            letters += found
        return letters, state


@functools.lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def damage(rows: DataFrame) -> DataFrame:
    """Turns with the faults that crc32 of ``conv_id:turn`` modulo 20 deals out; nulls are one space."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    dealt = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20).alias("_dealt"),
    ).where("_dealt <> 0")
    text = F.when(F.col("_dealt") == 1, "").when(F.col("_dealt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return dealt.select(
        "conv_id", "turn", F.when(F.col("_dealt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_dealt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_again"),
    ).drop("_again")


def _placed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns in order, with a position that grows with it, stored."""
    whole = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    ordered = whole.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64)))
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text")
    return scratch.table(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _symbol(repeated: Column) -> Column:
    initial = F.left("role", F.lit(1))
    last = F.right("stripped", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(F.col("stripped") == "", 2).when(repeated, 3).when(~last.isin(".", "!", "?"), 1).otherwise(0)
    return (kind + 4 * fault).cast("tinyint")


def _chunks(placed: DataFrame) -> DataFrame:
    """Symbols of up to 65,536 adjacent turns a row; duplicates by the first position of each role and text."""
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    narrow = placed.select("conv_id", "turn", "pos", F.left("role", F.lit(1)).alias("role"), digest.alias("digest"),
                           F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).alias("stripped"))
    first = narrow.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    marked = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    symbols = marked.select("conv_id", "turn", "pos", _symbol(F.coalesce(F.col("pos") > F.col("first"), F.lit(False))).alias("symbol"))
    held = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    return symbols.groupBy("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk")).agg(
        F.min("pos").alias("pos"), F.transform(held, lambda x: x["symbol"]).alias("symbols"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.array_distinct(F.collect_list("turn"))).cast("long").alias("turns"),
    )


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Totals:
    """What is summed over the chunks of a conversation, from the last to the first."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.vector = np.zeros(4, np.int64), 0, 0, 0
        self.low = self.high = self.initial = None
        self.turns = 0

    def add(self, symbols: np.ndarray, row: dict) -> int:
        behind = self.vector
        self.vector, cost, _ = tables().back(TO_TABLE[symbols], behind)
        self.cost += cost
        self.faults += np.bincount(symbols // 4, minlength=4)
        initials = (symbols % 4).tolist() + ([] if self.initial is None else [self.initial])
        self.illegal += sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
        self.initial = initials[0]
        if row["low"] is not None:
            self.turns += row["turns"] - (self.low is not None and self.low == row["high"])
            self.low, self.high = row["low"], row["high"] if self.high is None else self.high
        return behind

    def result(self) -> tuple[int, ...]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost = self.cost + tables().vectors[self.vector][0]
        return (gaps, int(self.faults[2]), int(self.faults[3]), int(self.faults[1]), self.illegal, cost)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, last to first within a conversation, with the vector behind each; the first one carries the totals."""
    totals, waiting, kind = _Totals(), None, None
    for batch in batches:
        done, kind, listed = [], batch.schema.field("conv_id").type, batch.column("symbols")
        for i, row in enumerate(batch.drop_columns(["symbols"]).to_pylist()):
            if waiting is not None:
                ended = row["conv_id"] != waiting["conv_id"]
                done.append(waiting | dict(zip(TOTALS, totals.result() if ended else ())))
                totals = _Totals() if ended else totals
            symbols = listed[i].values.to_numpy(zero_copy_only=False).astype(np.uint8)
            behind = totals.add(symbols, row)
            waiting = {"conv_id": row["conv_id"], "pos": row["pos"], "symbols": symbols.tobytes(), "behind": behind}
        if done:
            yield _batch(done, kind)
    if waiting is not None:
        yield _batch([waiting | dict(zip(TOTALS, totals.result()))], kind)


def _batch(rows: list[dict], conv: pa.DataType) -> pa.RecordBatch:
    fields = [("conv_id", conv), ("pos", pa.int64()), ("symbols", pa.binary()), ("behind", pa.int32())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields + [(c, pa.int64()) for c in TOTALS]))


class _Conversation:
    """Audit and hash of one conversation, turn by turn."""

    def __init__(self, conv, sums: tuple) -> None:
        self.conv, self.sums, self.state, self.walked = conv, sums, 0, 0
        self.audit: list[str] = []
        self.pending: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def chunk(self, symbols: np.ndarray, behind: int) -> None:
        letters, self.walked = tables().trace(TO_TABLE[symbols], behind, self.walked)
        self.pending = letters[::-1]

    def line(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":").encode("utf-8"))
        self.hash.update(text.encode("utf-8"))
        self.empty = False

    def letter(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self.state = INITIALS.index(role[0]) + 1
            self.line(role, text)
        elif letter != "D":
            self.state = TURNS[self.state]
            self.line(ROLE[self.state], text if letter == "R" else "")

    def turn(self, role: str, text: str) -> None:
        letters = self.pending.pop()
        self.audit.append(letters)
        for letter in letters:
            self.letter(letter, role, text)

    def result(self) -> dict:
        while FINAL[self.state]:
            self.audit.append("I")
            self.letter("I", "", "")
        return {"conv_id": self.conv, **dict(zip(TOTALS, self.sums)), "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks and, behind each, its turns, in order: one row a conversation."""
    current, schema = None, None
    for batch in batches:
        schema = pa.schema(
            [("conv_id", batch.schema.field("conv_id").type), *[(c, pa.int64()) for c in TOTALS], ("audit", pa.string()), ("repaired_sha256", pa.string())]
        )
        done = []
        for row in batch.to_pylist():
            if row["symbols"] is None:
                current.turn(row["role"], row["text"])
                continue
            if row["cost"] is not None:
                if current is not None:
                    done.append(current.result())
                current = _Conversation(row["conv_id"], tuple(row[c] for c in TOTALS))
            current.chunk(np.frombuffer(row["symbols"], np.uint8), row["behind"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.result()], schema=schema)


def repaired(rows: DataFrame) -> DataFrame:
    """A row per conversation of (conv_id, turn, role, text): faults, cost, audit and hash of the repaired turns."""
    scratch = Scratch(rows.sparkSession, "conversation-repair")
    placed = _placed(rows, scratch)
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    sums = ", ".join(f"{c} long" for c in TOTALS)
    chunks = _chunks(placed).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("chunk").desc()).drop("chunk")
    looked_up = arrow_map(chunks, _looked_up, f"{conv}, pos long, symbols binary, behind int, {sums}")
    plans = looked_up.withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    turns = placed.select("conv_id", "pos", "role", "text")
    both = plans.unionByName(turns, allowMissingColumns=True)
    # A chunk has the position of its first turn and comes in front of it.
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("symbols").isNull())
    return arrow_map(both, _traced, f"{conv}, {sums}, audit string, repaired_sha256 string")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """``repaired`` after ``damage``, with a row for every conversation of the undamaged table."""
    found = repaired(damage(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    whole = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    empty = hashlib.sha256().hexdigest()
    return whole.fillna(0, list(TOTALS)).fillna({"audit": "", "repaired_sha256": empty})
