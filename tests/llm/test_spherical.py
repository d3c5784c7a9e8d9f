"""Near duplicates among vectors against all pairs."""

import numpy as np
import pytest

from fleetlens.llm import spherical

CLASHING = "label int, row int, cell string, n string, core int, length string, raw string, angle int, component string"


def frame_of(spark, rows, kind="float"):
    rows = [(i, x, 1, 2, "c", "n", 3, "l", "r", 4, "x") for i, x in rows]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, {CLASHING}").repartition(4)


def plain(rows, least=0.9, kind=np.float32):
    good = {}
    for i, (_, x) in enumerate(rows):
        if x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x):
            y = np.array(x, kind).astype(np.float64)
            y /= np.abs(y).max()
            good[i] = y / np.sqrt(y @ y)
    links = {i: [] for i in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= least:
                links[i].append(j)
                links[j].append(i)
    out, group = [], {}
    for i in links:
        if i in group:
            continue
        todo, seen = [i], {i}
        while todo:
            new = [k for k in links[todo.pop()] if k not in seen]
            seen.update(new)
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        group |= dict.fromkeys(seen, min(ids, default=None))
    for i, (vec_id, _) in enumerate(rows):
        out.append((vec_id, len(links[i]), group[i], vec_id is not None and vec_id == group[i]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((c is None, c or 0) for c in r))


def found(frame, **options):
    out = spherical.near_duplicates(frame, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return order(tuple(r) for r in out.collect())


def near(rng, center, n, spread):
    x = center + rng.normal(0, spread, (n, len(center)))
    return x.tolist()


@pytest.mark.parametrize(("shelf", "cells"), [(4096, None), (40, 12), (16, 40)])
def test_families_borders_and_noise(spark, monkeypatch, shelf, cells):
    monkeypatch.setattr(spherical, "SHELF", shelf)
    rng = np.random.default_rng(shelf)
    vectors = rng.normal(size=(150, 64)).tolist()
    center = rng.normal(size=64)
    vectors += near(rng, center, 120, 0.05) + [center.tolist()] * 60 + near(rng, center, 40, 0.35) + near(rng, -center, 30, 0.3)
    vectors += [(center * np.cos(t) + vectors[0] * np.array(np.sin(t))).tolist() for t in np.linspace(0, 1.5, 15)]
    rows = list(enumerate(vectors))
    assert found(frame_of(spark, rows), cells=cells) == order(plain(rows))


def test_dense_sphere(spark, monkeypatch):
    """Vectors all over a sphere of three dimensions: most links cross a border of cells."""
    monkeypatch.setattr(spherical, "SHELF", 60)
    rng = np.random.default_rng(4)
    rows = [(i, (x * rng.choice([1e-30, 1.0, 1e30])).tolist()) for i, x in enumerate(rng.normal(size=(400, 3)))]
    assert found(frame_of(spark, rows, "double"), cells=25, least=0.985) == order(plain(rows, 0.985, np.float64))


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(1, base.tolist()), (1, base.tolist()), (1, (-base).tolist()), (None, base.tolist()), (None, (-base * 2).tolist()), (5, None), (6, []), (7, [0.0] * 8)]
    rows += [(8, [None] + base.tolist()[1:]), (9, [float("nan")] * 8), (10, [float("inf")] + [1.0] * 7), (3, base.tolist()[:7]), (4, base.tolist()[:7])]
    rows += [(None, [1.0, 0.0]), (12, (base * 1e-3).tolist())]
    assert found(frame_of(spark, rows)) == order(plain(rows))


def test_no_vectors(spark):
    assert found(frame_of(spark, [])) == []
    assert found(frame_of(spark, [(1, None), (2, [0.0, 0.0])])) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_a_family_of_copies_is_not_compared(spark):
    """All of one tight family: its links are counted from the size of the core."""
    rng = np.random.default_rng(8)
    rows = list(enumerate(near(rng, rng.normal(size=64), 3000, 0.03)))
    assert set(found(frame_of(spark, rows))) == {(i, 2999, 0, i == 0) for i in range(3000)}
