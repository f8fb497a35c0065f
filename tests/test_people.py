"""Tasks that hold people against tasks that hold blocks of edges: masks of every kind, plans that differ, constant and tied edges."""

from __future__ import annotations

import numpy as np
import pytest

from edgeloom.operators import engine, kernel, people

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def tables(spark):
    draw = np.random.default_rng(8)
    n, edges, iters = 230, 12, 4
    x, y = draw.normal(size=(n, edges)) + 1e4, draw.normal(size=n)
    x[:, :4] += 0.3 * y[:, None]
    x[:, 4] -= 0.3 * y
    x[:, 5] = 0.1
    x[:, 6] = np.round(x[:, 6] - 0.3 * y)
    x[:180, 7] = 0.7  # constant in the training parts that leave out fold 4 of the first plan
    z = np.column_stack([np.arange(n) % 3, y + draw.normal(size=n), 2.0 * (np.arange(n) % 3)])
    rows = [(i, e, float(x[i, e])) for i in range(n) for e in range(edges)]
    fold = lambda t, i: min(i // 45, 4) if t < 4 else i % 4
    scores = [(10 * t, i, fold(t, i), float(v)) for t in range(1, iters + 1) for i, v in enumerate(y if t in (1, 4) else draw.permutation(y)) if t < 4 or i % 7]
    covariates = [(i, *map(float, z[i])) for i in range(n)]
    return tuple(spark.createDataFrame(d, s).localCheckpoint() for d, s in ((rows, "subject_row long, edge_id int, value double"), (scores, "iter int, subject_row long, fold int, y double"), (covariates, "subject_row long, a double, b double, c double")))


def _both(monkeypatch, f):
    made = f()
    monkeypatch.setattr(kernel, "MANY", 10**9)
    return made, f()


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("ranks", [False, True])
def test_people_equal_blocks(tables, monkeypatch, adjust, ranks):
    edges, outcome, z = tables
    more = {"covariates": z if adjust else None, "names": NAMES, "ranks": ranks}
    key = ["iter", "held", "subject_row"]
    near, far = (f.toPandas().sort_values(key).reset_index(drop=True) for f in _both(monkeypatch, lambda: kernel.block_strengths(edges, outcome, 0.05, **more)))
    assert (near[[*key, "fold", "y"]].to_numpy() == far[[*key, "fold", "y"]].to_numpy()).all()
    assert (near.pos != 0).any() and (near.neg != 0).any()
    assert np.abs(near[["pos", "neg"]] - far[["pos", "neg"]]).to_numpy().max() < 1e-8
    monkeypatch.undo()
    a, b = (f.toPandas().sort_values(["iter", "model"]).reset_index(drop=True) for f in _both(monkeypatch, lambda: kernel.cross_validate(edges, outcome, 0.05, **more)))
    assert (a[["iter", "model"]].to_numpy() == b[["iter", "model"]].to_numpy()).all() and len(a) == 12
    assert np.allclose(a[["r", "mse"]].to_numpy(float), b[["r", "mse"]].to_numpy(float), atol=1e-7, equal_nan=True)


def test_votes_of_people_and_slices(tables, monkeypatch):
    edges, outcome, _ = tables
    monkeypatch.setattr(people, "MOST", 70)  # one iteration a slice
    near = sorted(map(tuple, kernel.block_votes(edges, outcome, 0.05, 3).collect()))
    monkeypatch.setattr(kernel, "MANY", 10**9)
    assert near and near == sorted(map(tuple, kernel.block_votes(edges, outcome, 0.05, 3).collect()))


def test_many_people_never_meet_in_a_task(tables, monkeypatch):
    """No step of a task holds more people than its size allows, and the driver gets no row a person."""
    edges, outcome, _ = tables
    monkeypatch.setattr(kernel, "Scores", None)  # the form that brings all scores to the driver
    assert kernel.cross_validate(edges, outcome, 0.05).count() == 12


def test_a_missing_edge_is_an_error(tables):
    edges, outcome, _ = tables
    with pytest.raises(Exception, match="a person lacks an edge"):
        kernel.cross_validate(edges.filter("NOT (subject_row = 5 AND edge_id = 3)"), outcome, 0.05).collect()


def test_models_of_moments(tables):
    edges, outcome, _ = tables
    rows = kernel.block_strengths(edges, outcome, 0.05)
    want = {(r["iter"], r.model): (r.r, r.mse) for r in engine.measure(rows).collect()}
    for r in kernel.cross_validate(edges, outcome, 0.05).collect():
        assert (r.r, r.mse) == pytest.approx(want[r["iter"], r.model], abs=1e-7)
