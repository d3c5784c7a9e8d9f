"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's score is linear in features of itself and of its neighbours, and neighbouring labels
are tied by transition weights. Forward and backward sums give the chance that a line is good; their mean, weighted by
line length, is the document's raw quality, and a logistic curve fitted on the training documents turns it into a score.

Lines carry no labels of their own: training finds them, given that most of a document's length has the document's label.
It reads a bounded sample of whole documents: ``SAMPLE_A_CLASS`` ids of each label at most, the smallest by a hash of the
id, as far as they fit into ``SAMPLE_LINES`` lines a label; a document that does not fit is not learnt from. All else reads
all texts. Labels, ids, language and source are never features.

Defined cases: a null or empty text is one empty line; documents without a label are scored and not learnt from; ids with
contradicting labels are not learnt from; a null id belongs to no held-out fold; without labels of both classes every
score is 0.5; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.scratch import arrow_map, extended, slices

SAMPLE_A_CLASS = 1500
SAMPLE_LINES = 200_000
MOST = 0.9
STEPS = 150
PENALTY, BESIDE_PENALTY, MOVE_PENALTY = 1e-3, 1.0, 3e-2

# Bytes by kind: one table per kind, counted a line at a time.
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "symbol": b"#*$%&<>=~^@{}[]\\_", "bar": b"|", "cry": b"!",
}
_TABLES = {name: np.isin(np.arange(256), np.frombuffer(kind, np.uint8)).astype(np.float32) for name, kind in _KINDS.items()}
OWN = 13
NEIGHBOUR = (1, 2, 3, 4, 6, 7, 8)  # own features that the lines beside also see
WIDTH = 1 + OWN + 2 * len(NEIGHBOUR) + 2


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features a line, lines a text, characters a line)."""
    lines = [text.split("\n") if text else [""] for text in texts]
    counts = np.array([len(each) for each in lines], np.int64)
    flat = [line for each in lines for line in each]
    encoded = [line.encode("utf-8") + b"\n" for line in flat]
    starts = np.concatenate([[0], np.cumsum([len(e) for e in encoded])[:-1]]).astype(np.int64) if encoded else np.empty(0, np.int64)
    data = np.frombuffer(b"".join(encoded), np.uint8)
    kinds = {name: np.add.reduceat(table[data], starts) if len(starts) else np.empty(0, np.float32) for name, table in _TABLES.items()}
    n, distinct, again, ends, seen_before = (np.zeros(len(flat), np.float32) for _ in range(5))
    row = 0
    for each in lines:
        seen: set[str] = set()
        for line in each:
            words = line.split()
            n[row] = len(words)
            distinct[row] = len(set(words))
            again[row] = sum(map(eq, words, words[1:]))
            ends[row] = line.rstrip()[-1:] in ".!?…\"'»"
            seen_before[row] = bool(words) and line in seen
            seen.add(line)
            row += 1
    chars = np.array([len(line) for line in flat], np.float64)
    some, letters = np.maximum(n, 1), np.maximum(kinds["upper"] + kinds["lower"], 1)
    own = np.stack([
        np.log1p(n), np.minimum(kinds["symbol"] / some, 3), np.minimum(kinds["cry"] / some, 2), kinds["upper"] / letters,
        np.minimum(kinds["bar"] / some, 1), kinds["digit"] / np.maximum(chars, 1), 1 - distinct / some * (n > 0) - (n == 0), again / some,
        seen_before, ends, (n < 4).astype(np.float32), (n == 0).astype(np.float32), np.minimum(chars / some / 10, 3),
    ], axis=1).astype(np.float64)
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    at_first, at_last = np.zeros(len(flat)), np.zeros(len(flat))
    at_first[first], at_last[last] = 1, 1
    before, after = np.roll(own[:, NEIGHBOUR], 1, axis=0), np.roll(own[:, NEIGHBOUR], -1, axis=0)
    before[at_first == 1], after[at_last == 1] = 0, 0
    return np.column_stack([np.ones(len(flat)), own, before, after, at_first, at_last]), counts, chars


def marginals(emit: np.ndarray, counts: np.ndarray, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of each state a line, summed chances of each transition, log of the partition sum a text).

    The sums take each line's transition from the line before by its ``weight``, if there is one.

    All texts advance together, line by line; those that have ended drop out.
    """
    ends = np.cumsum(counts)
    order = np.argsort(-counts, kind="stable")
    start, size = (ends - counts)[order], counts[order]
    forward, backward = emit.copy(), np.zeros_like(emit)
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
    for t in range(1, longest):
        at = start[: alive[t]] + t
        forward[at] += np.logaddexp(forward[at - 1, :1] + move[0], forward[at - 1, 1:] + move[1])
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        onward = emit[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(move[:, 0] + onward[:, :1], move[:, 1] + onward[:, 1:])
    total = np.logaddexp(*forward[ends - 1].T)
    by_line = np.repeat(total, counts)[:, None]
    chance = np.exp(forward + backward - by_line)
    inner = np.ones(len(emit), bool)
    inner[ends - counts] = False
    later = np.flatnonzero(inner)
    joint = forward[later - 1][:, :, None] + move[None] + (emit + backward)[later][:, None, :] - by_line[later][:, :, None]
    moves = np.exp(joint)
    return chance, (moves if weight is None else moves * weight[later, None, None]).sum(axis=0), total


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # features x states
    move: np.ndarray  # states x states
    slope: float
    offset: float

    def raw(self, features: np.ndarray, counts: np.ndarray, chars: np.ndarray) -> np.ndarray:
        good = marginals(features @ self.weights, counts, self.move)[0][:, 1]
        starts, weight = np.cumsum(counts) - counts, chars + 1e-6
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return 1 / (1 + np.exp(-(self.slope * (self.raw(*line_features(texts)) - 0.5) + self.offset)))


def fit(features: np.ndarray, counts: np.ndarray, chars: np.ndarray, labels: np.ndarray, shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Line labels are hidden; a document's label only says that ``MOST`` of its length has it.

    Each step takes the chances of the lines under the model and those nearest to them that keep to what the documents'
    labels say (a tilt a document, raised while too little of its length has the label, lowered otherwise), and moves
    the weights towards the latter, by Adam with a squared penalty; both classes weigh the same. What lines beside a
    line look like, and their labels, weigh less than the line itself: texts of one kind of line cannot tell them apart.
    In the logistic curve classes weigh by ``shares``, how often each label occurs.
    """
    by_class = np.array([0.5 / max(1, (labels == k).sum()) for k in (0, 1)])
    text_weight = by_class[labels] * len(labels)
    line_label, line_weight = np.repeat(labels, counts), np.repeat(text_weight, counts)
    begins, every = np.cumsum(counts) - counts, np.arange(len(line_label))
    weight = chars + 1e-6
    part = weight / np.repeat(np.add.reduceat(weight, begins), counts)
    pull = part * np.repeat(counts, counts) * (2 * line_label - 1)
    tilt = np.full(len(labels), 2.0)
    scale = np.maximum(np.sqrt((features**2).mean(axis=0)), 1e-3)
    x = features / scale
    penalty = np.full((x.shape[1] + 2, 1), PENALTY)
    penalty[1 + OWN : 1 + OWN + 2 * len(NEIGHBOUR)], penalty[-2:] = BESIDE_PENALTY, MOVE_PENALTY
    params, first, second = np.zeros((x.shape[1] + 2, 2)), 0.0, 0.0
    size = text_weight.sum()
    for step in range(1, STEPS + 1):
        emit, move = x @ params[:-2], params[-2:]
        free, free_moves, _ = marginals(emit, counts, move, line_weight)
        tilted = emit.copy()
        tilted[:, 1] += pull * np.repeat(tilt, counts)
        held, held_moves, _ = marginals(tilted, counts, move, line_weight)
        tilt = np.clip(tilt + 2 * (MOST - np.add.reduceat(held[every, line_label] * part, begins)), 0, 30)
        gradient = np.concatenate([x.T @ ((held - free) * line_weight[:, None]), held_moves - free_moves]) / size - penalty * params
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        params = params + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model = Model(params[:-2] / scale[:, None], params[-2:], 1.0, 0.0)
    return calibrated(model, model.raw(features, counts, chars), labels, shares)


def calibrated(model: Model, raw: np.ndarray, labels: np.ndarray, shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """The model with the logistic curve of these raw scores."""
    by_class = np.array([0.5 / max(1, (labels == k).sum()) for k in (0, 1)])
    text_weight = by_class[labels] * len(labels) * np.array(shares)[labels] / sum(shares) * 2
    raw = raw - 0.5
    slope, offset = 8.0, 0.0
    for _ in range(50):  # Newton steps of a penalised logistic fit
        p = 1 / (1 + np.exp(-(slope * raw + offset)))
        curve = text_weight * p * (1 - p)
        g = np.array([(text_weight * (labels - p) * raw).sum() - 0.1 * slope, (text_weight * (labels - p)).sum() - 0.1 * offset])
        h = np.array([[(curve * raw * raw).sum() + 0.1, (curve * raw).sum()], [(curve * raw).sum(), curve.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        slope, offset = float(np.clip(slope + step[0], 0.1, 60)), float(np.clip(offset + step[1], -10, 10))
    return Model(model.weights, model.move, slope, offset)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labelled documents outside the held-out fold; None if a class is missing."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    )
    frequency = {int(r.quality): float(r["count"]) for r in known.groupBy("quality").count().collect()}
    place = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for k in (0, 1):
        some = known.where(F.col("quality") == k).orderBy(place, "doc_id").limit(SAMPLE_A_CLASS)
        chosen = some if chosen is None else chosen.unionByName(some)

    # Two times SAMPLE_A_CLASS ids at most: small enough to send to every task.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))), "doc_id"
    )
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(1)).cast("long")
    sizes = joined.groupBy("doc_id", "quality").agg(F.sum(lines).alias("n")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").collect()
    taken, room = [], {0: SAMPLE_LINES, 1: SAMPLE_LINES}
    for row in sizes:
        if row.n <= room[row.quality]:
            room[row.quality] -= row.n
            taken.append(row.doc_id)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found, counts, chars = line_features(piece.column("text").to_pylist())
                ends = np.cumsum(counts).tolist()
                spans = list(zip([0, *ends], ends))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": piece.column("doc_id"), "quality": piece.column("quality"),
                    "features": pa.array([found[i:j].astype("<f4").tobytes() for i, j in spans], pa.binary()),
                    "chars": pa.array([chars[i:j].astype("<f4").tobytes() for i, j in spans], pa.binary()),
                })

    few = joined.where(F.col("doc_id").isin(taken))
    rows = arrow_map(few.select("doc_id", "quality", "text"), gather, "doc_id long, quality int, features binary, chars binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    labels_of = np.array([r.quality for r in rows], np.int64)
    if len(set(labels_of.tolist())) < 2:
        return None
    features = np.concatenate([np.frombuffer(bytes(r.features), "<f4").reshape(-1, WIDTH) for r in rows]).astype(np.float64)
    chars = np.concatenate([np.frombuffer(bytes(r.chars), "<f4") for r in rows]).astype(np.float64)
    return fit(features, np.array([len(r.chars) // 4 for r in rows], np.int64), chars, labels_of, (frequency[0], frequency[1]))


def scored(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; columns of these names are replaced."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text_column):
                texts = piece.column(text_column).to_pylist()
                score = np.full(len(texts), 0.5) if model is None else model.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())],
                    names=[*piece.schema.names, "score", "predicted"],
                )

    return arrow_map(kept, run, extended(kept.schema.fields, "score double, predicted int"))
