"""Conversation repair against the plain recursion over turns."""

import hashlib
import random
import zlib

import pytest

from fleetlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, pos string, symbols string, behind string"


def plain(turns):
    """Audit values by the definition: the least (cost, audit) per state, one turn at a time."""
    fold = {}
    seen, totals = set(), dict.fromkeys(repair.TOTALS, 0)

    def put(into, state, cost, audit, lines):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, lines)

    def insertions(into):
        for state in (0, 1, 3, 2, 3):
            if state in into:
                cost, audit, lines = into[state]
                to = 3 if state == 2 else 2
                put(into, to, cost + 5, audit + "I", lines + [("assistant" if to == 3 else "user") + ":"])
        return into

    fold = insertions({0: (0, "", [])})
    previous = None
    for _, role, text in turns:
        bare = text.strip(" \t\n\v\f\r")
        blank, again = not bare, (role, text) in seen
        cut = not blank and not again and bare[-1] not in ".!?"
        totals["blank"] += blank
        totals["duplicate"] += again and not blank
        totals["truncated"] += cut
        seen.add((role, text))
        totals["illegal"] += previous is not None and previous + role[:1] not in ("su", "ua", "au")
        previous = role[:1]
        after = {}
        for state, (cost, audit, lines) in fold.items():
            put(after, state, cost + 2, audit + "D", lines)
            if blank or again:
                continue
            extra = 5 if cut else 0
            to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
            if to is not None:
                put(after, to, cost + extra, audit + "K", lines + [f"{role}:{text}"])
            to = 3 if state == 2 else 2
            put(after, to, cost + extra + 1, audit + "R", lines + [("assistant" if to == 3 else "user") + f":{text}"])
        fold = insertions(after)
    numbers = [t for t, _, _ in turns if t is not None]
    totals["gaps"] = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    totals["cost"], audit, lines = min((fold[s] for s in (0, 3) if s in fold), key=lambda x: x[:2])
    return (*[int(totals[c]) for c in repair.TOTALS], audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    out = {}
    for conv in {row[0] for row in rows}:
        damaged = []
        for c, turn, role, text in (row[:4] for row in rows):
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
            role = "user" if fault == 4 else role
            damaged += [(turn, role, text)] * (2 if fault == 3 else 1)
        damaged.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        out[conv] = plain(damaged)
    return out


def rows_of(rng, conv, n, roles=("system", "user", "assistant", None, "", "tool", "unknown")):
    texts = ["Yes.", "No!", "Why?", "cut off", "", None, " \n\t", "end . \n", "Ünï 漢字.", "x" * 50 + "?"]
    rows = []
    for _ in range(n):
        turn = None if rng.random() < 0.05 else rng.randrange(n + 3)
        rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"Turn {rng.random()}" + rng.choice(".,"), "c", 1, "p", "s", "b"))
    return rows


def found(frame):
    return {row.conv_id: tuple(row[c] for c in (*repair.TOTALS, "audit", "repaired_sha256")) for row in frame.collect()}


@pytest.mark.parametrize("bits", [2, 16])
def test_equals_the_plain_recursion(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rng = random.Random(bits)
    rows = [row for conv in (None, *range(150)) for row in rows_of(rng, conv, rng.randrange(1, 14))]
    rows += rows_of(rng, 1000, 700) + rows_of(rng, 1001, 900, ("user",)) + [(1002, 3, "user", "Same.", "c", 1, "p", "s", "b")] * 40
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(repair.damaged_and_repaired(frame)) == expected(rows)


def test_every_short_sequence_of_symbols():
    """Blocks, odd ends and the trace give the least audit of all sequences of up to five turns of three roles."""
    import itertools

    import numpy as np

    tables = repair.tables()
    role, text = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}, {0: "t{}.", 1: "t{}", 2: " "}
    for n in range(6):
        for stored in itertools.islice(itertools.product([0, 1, 2, 3, 4, 5, 6, 8], repeat=n), 0, None, 7):
            symbols = repair.TO_TABLE[np.array(stored, np.int64)]
            vector, cost, _ = tables.back(symbols, 0)
            letters, state = tables.trace(symbols, 0, 0)
            audit = "".join(letters) + "I" * (repair.FINAL[state] // repair.INSERT)
            turns = [(i, role["sua?"[s % 4]], text[s // 4].format(i)) for i, s in enumerate(stored)]
            want = plain(turns)
            assert (cost + tables.vectors[vector][0], audit) == (want[5], want[6])


def test_empty_table_and_very_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.damaged_and_repaired(empty).collect() == []
    rows = [(7, k, "user" if k % 2 else "assistant", ("ab " * 400_000) + "." * (k % 3), "c", 1, "p", "s", "b") for k in range(6)]
    rows += [(8, 1, "user", " " * 1_000_000 + "a", "c", 1, "p", "s", "b"), (8, 2, "user", "a" + "\n" * 1_000_000, "c", 1, "p", "s", "b")]
    assert found(repair.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
