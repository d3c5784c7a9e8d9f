"""Near duplicates among vectors: spherical k-means cells, blocked cosine products, one representative a group.

Centroids are fitted on a bounded sample; every vector falls into the cell of the nearest one. Two vectors can only link if
their angle is at most alpha, the angle of the least cosine. That is looked for in the vector's own cell, and in every other cell
that bounds do not rule out, so that no link at a border is lost and the result does not depend on the fit:

* a cell's vectors lie between two angles around its centroid; a vector farther than alpha from that ring has no link there;
* a cell lies on its side of the plane halfway between two centroids; a vector farther than alpha from that plane has none.

Vectors within alpha / 2 of their centroid (the core of the cell) are all linked to one another, by the triangle inequality:
they are counted, never compared, so a family of near copies costs one pass however large it is. The rest is compared as
matrix products. Cells are put on shelves of about ``SHELF`` vectors, a task each, and a larger cell is cut over
several shelves; a vector is sent once to each shelf that may hold a link, and a shelf holds its members only while the others stream past.
Of the links a task gives counts and a spanning forest, never pairs.

Cost: bounds rule out most cells where vectors form clusters; vectors without any structure in many dimensions are compared all
with all, as exactness asks for.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors link only to
vectors of their length; repeated rows are vectors of their own, rows of one id included; a null id has the smallest
id of its group as component and is not kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm.components import components
from fleetlens.llm.scratch import Scratch, arrow_map

SAMPLE = 16_384  # vectors the centroids are fitted on; decides cost only
CELLS = 1_024  # most cells of one length
SHELF = 4_096  # vectors a task holds
ROUNDS = 10
MARGIN = 1e-6  # radians, far above the rounding of an angle


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, k: int, alpha: float, seed: int = 7) -> np.ndarray:
    """Spherical k-means; of centroids within alpha / 2 the one with most vectors stays, so that a family has one cell."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    counts = np.ones(len(centroids))
    for _ in range(ROUNDS):
        nearest = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        length = np.sqrt((sums * sums).sum(1))
        moved = length > 1e-9
        centroids = np.where(moved[:, None], sums / np.maximum(length, 1e-9)[:, None], centroids)
        counts = np.bincount(nearest, minlength=len(centroids))
    kept: list[int] = []
    for c in np.argsort(-counts, kind="stable"):
        if not kept or (centroids[kept] @ centroids[c]).max() < math.cos(alpha / 2):
            kept.append(int(c))
    return centroids[kept]


@dataclass
class Model:
    """Centroids of each vector length, and where their cells begin in the numbering of all cells."""

    dtype: str
    alpha: float
    centroids: dict[int, np.ndarray]
    begin: dict[int, int]

    def angles(self, raw: bytes | list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, and their angles to the centroids of their length."""
        x = unit(np.frombuffer(b"".join(raw), self.dtype).reshape(-1, length))
        return x, np.arccos(np.clip(x @ self.centroids[length].T, -1, 1))


@dataclass
class Shelves:
    """Units (cell, core or not, part) in order, each on a shelf, with the ring of angles its vectors lie in."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray
    shelf: np.ndarray
    parts: dict[tuple[int, bool], int]
    first: dict[tuple[int, bool], int]
    family: dict[int, tuple[int, int]]  # cell: vectors in its core, the first of them


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        raw = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(ends), pa.int32()), pa.array(raw, pa.binary())], ["row", "length", "raw"])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column("length").to_numpy()
    for length in np.unique(lengths).tolist():
        yield length, batch.filter(pa.array(lengths == length))


def _assigned(model: Model):
    """Function for tasks: cell and angle of every vector; the core is what lies within alpha / 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows in _by_length(batch):
                _, angles = model.angles(rows.column("raw").to_pylist(), length)
                nearest = angles.argmin(1)
                angle = angles[np.arange(len(nearest)), nearest]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), rows.column("length"), rows.column("raw"), pa.array(nearest + model.begin[length], pa.int32()),
                     pa.array(angle), pa.array(angle <= model.alpha / 2 - MARGIN)],
                    ["row", "length", "raw", "cell", "angle", "core"],
                )

    return run


def _shelves(assigned: DataFrame, model: Model) -> Shelves:
    """The plan of the tasks, from a row per cell and core."""
    stats = assigned.groupBy("length", "cell", "core").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("row").alias("first")
    ).collect()  # at most two rows a cell
    stats.sort(key=lambda s: (s.length, s.cell, not s.core))
    cell, low, high, core, shelf, parts, first, family = [], [], [], [], [], {}, {}, {}
    current, held, length = -1, SHELF, None
    for s in stats:
        n_parts = -(-s.n // SHELF)
        parts[s.cell, s.core], first[s.cell, s.core] = n_parts, len(cell)
        if s.core:
            family[s.cell] = (s.n, s.first)
        for _ in range(n_parts):
            if held + s.n / n_parts > SHELF or s.length != length:
                current, held, length = current + 1, 0, s.length
            held += s.n / n_parts
            cell.append(s.cell)
            low.append(s.low)
            high.append(s.high)
            core.append(s.core)
            shelf.append(current)
    return Shelves(*map(np.array, (cell, low, high, core, shelf)), parts, first, family)


def _routed(model: Model, plan: Shelves):
    """Function for tasks: every vector as a member of its shelf and as a visitor of later ones that may hold a link."""
    sine = math.sin(model.alpha) + MARGIN

    def units(length: int) -> np.ndarray:
        begin = model.begin[length]
        return np.flatnonzero((plan.cell >= begin) & (plan.cell < begin + len(model.centroids[length])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows in _by_length(batch):
                x, angles = model.angles(rows.column("raw").to_pylist(), length)
                near, begin = units(length), model.begin[length]
                cells, core = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "core"))
                ids = rows.column("row").to_numpy()
                key = list(zip(cells.tolist(), core.tolist()))
                own = np.array([plan.first[k] for k in key]) + ids % np.array([plan.parts[k] for k in key])
                of = plan.cell[near] - begin  # centroid of each unit
                to = angles[:, of]
                open_ = (to <= plan.high[near] + model.alpha + MARGIN) & (to >= plan.low[near] - model.alpha - MARGIN)
                # Distance from the plane between the two centroids.
                centroids = model.centroids[length]
                apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
                lead = (x * centroids[cells - begin]).sum(1)[:, None] - (x @ centroids.T)[:, of]
                open_ &= lead <= sine * apart[cells - begin][:, of] + MARGIN
                open_ &= ~(core[:, None] & plan.core[near] & (plan.cell[near] == cells[:, None]))  # one family: counted, not compared
                open_ &= plan.shelf[near] > plan.shelf[own][:, None]
                row, unit_ = np.nonzero(open_)
                visits = np.unique(np.stack([row, plan.shelf[near][unit_]], 1), axis=0)
                pick = np.concatenate([np.arange(rows.num_rows), visits[:, 0]])
                shelf = np.concatenate([plan.shelf[own], visits[:, 1]])
                visitor = np.arange(len(pick)) >= rows.num_rows
                for a in range(0, len(pick), 4096):
                    part = rows.select(["row", "length", "raw", "cell", "core"]).take(pa.array(pick[a : a + 4096]))
                    yield part.append_column("shelf", pa.array(shelf[a : a + 4096], pa.int32())).append_column("visitor", pa.array(visitor[a : a + 4096]))

    return run


class _Block:
    """The members of one shelf: what they link to, and a forest over their links."""

    def __init__(self, least: float, dtype: str, family: dict[int, tuple[int, int]]) -> None:
        self.least, self.dtype, self.family = least, dtype, family
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.x = None

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        length = batch.column("length")[0].as_py()
        x = unit(np.frombuffer(b"".join(batch.column("raw").to_pylist()), self.dtype).reshape(-1, length))
        ids, cells, core = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "cell", "core"))
        return x, ids, np.where(core, cells, -1 - ids)  # outside cores everyone is a family of their own

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(self.read(batch))

    def close(self) -> None:
        """All members are here: their links to one another."""
        self.x, self.ids, self.kin = (np.concatenate(each) for each in zip(*self.parts))
        n = len(self.ids)
        self.count, self.parent = np.zeros(n, np.int64), np.arange(n)
        for begin in range(0, n, 512):
            end = min(begin + 512, n)
            links = self.x[begin:end] @ self.x[begin:].T >= self.least
            links &= self.kin[begin:end, None] != self.kin[begin:]
            links &= np.arange(begin, end)[:, None] < np.arange(begin, n)
            row, col = np.nonzero(links)
            np.add.at(self.count, row + begin, 1)
            np.add.at(self.count, col + begin, 1)
            self.join(row + begin, col + begin)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect members pairwise: hang the larger root below the smaller until nothing changes."""
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up

    def visit(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Visitors' links; members that one visitor links to are connected through it."""
        x, ids, kin = self.read(batch)
        row, col = np.nonzero((x @ self.x.T >= self.least) & (kin[:, None] != self.kin))
        np.add.at(self.count, col, 1)
        found, at, n = np.unique(row, return_index=True, return_counts=True)
        leader = col[at]
        self.join(np.repeat(leader, n), col)
        return _out(ids[found], n, self.ids[leader])

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.x is None:
            self.close()
        linked = self.count > 0
        yield _out(self.ids[linked], self.count[linked], self.ids[self.parent][linked])
        kin = self.kin[self.kin >= 0]
        if len(kin):
            size, first = (np.array(v) for v in zip(*[self.family[c] for c in kin.tolist()]))
            yield _out(self.ids[self.kin >= 0], size - 1, first)


def _out(ids: np.ndarray, n: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], ["row", "n", "other"])


def _compared(least: float, dtype: str, family: dict[int, tuple[int, int]]):
    """Function for tasks: rows of a shelf, members first; counts of links and edges that connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, current = None, None
        for batch in batches:
            shelves, visitors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shelf", "visitor"))
            cuts = np.flatnonzero((np.diff(shelves) != 0) | (np.diff(visitors.astype(int)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if b <= a:
                    continue
                if shelves[a] != current:
                    if block is not None:
                        yield from block.result()
                    block, current = _Block(least, dtype, family), shelves[a]
                if not visitors[a]:
                    block.add(batch.slice(a, b - a))
                    continue
                if block.x is None:
                    block.close()
                yield block.visit(batch.slice(a, b - a))
        if block is not None:
            yield from block.result()

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, cells: int | None = None) -> DataFrame:
    """A row per vector of (vec_id, embedding): how many others it links to, its group's smallest id, whether it stays."""
    spark = vectors.sparkSession
    scratch, alpha = Scratch(spark, "near-vectors"), math.acos(least)
    rows = scratch.table(vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")), "rows")
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    good = rows.where(whole).select("row", "embedding")
    counts = {r.length: r.n for r in good.groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    dtype = "<f4" if "float" in vectors.schema["embedding"].dataType.simpleString() else "<f8"
    if dtype == "<f8":
        good = good.withColumn("embedding", x.cast("array<double>"))
    packed = arrow_map(good, _packed, "row long, length int, raw binary")
    sample = packed.orderBy(F.rand(7)).limit(SAMPLE).select("length", "raw").collect()
    model, begin = Model(dtype, alpha, {}, {}), 0
    for length, n in sorted(counts.items()):
        mine = [r.raw for r in sample if r.length == length]
        if mine:
            k = cells or min(CELLS, max(1, round(math.sqrt(n) / 2)))
            model.centroids[length] = fit(unit(np.frombuffer(b"".join(mine), dtype).reshape(-1, length)), k, alpha)
        else:
            model.centroids[length] = np.eye(1, length)
        model.begin[length], begin = begin, begin + len(model.centroids[length])
    assigned = scratch.table(arrow_map(packed, _assigned(model), "row long, length int, raw binary, cell int, angle double, core boolean"), "assigned")
    plan = _shelves(assigned, model)
    if not len(plan.shelf):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    routed = arrow_map(assigned, _routed(model, plan), "row long, length int, raw binary, cell int, core boolean, shelf int, visitor boolean")
    routed = routed.repartitionById(int(plan.shelf[-1]) + 1, "shelf").sortWithinPartitions("shelf", "visitor")
    found = scratch.table(arrow_map(routed, _compared(least, dtype, plan.family), "row long, n long, other long"), "links")
    scratch.drop("assigned")
    links = found.groupBy("row").agg(F.sum("n").alias("n_links")).where("n_links > 0")
    groups = components(found.where("row <> other").select(F.col("row").alias("a"), F.col("other").alias("b")), scratch)
    groups = groups.select(F.col("id").alias("row"), "component")
    members = rows.select("row", "vec_id").join(groups, "row")
    smallest = members.groupBy("component").agg(F.min("vec_id").alias("smallest"))
    named = groups.join(smallest, "component").select("row", "smallest")
    return rows.select("row", "vec_id").join(links, "row", "left").join(named, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("smallest", "vec_id"), F.lit(False)).alias("kept"),
    )
