"""The block kernel against the relational form, also for values far from zero."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import adjusted, engine, kernel


@pytest.fixture(scope="module")
def tables(spark):
    draw = np.random.default_rng(2)
    people, edges, iters = 60, 45, 4
    x, y = draw.normal(size=(people, edges)), draw.normal(size=people)
    x[:, :6] += y[:, None]
    x[:, 7] = 3.0
    rows = [(i, e, float(x[i, e])) for i in range(people) for e in range(edges)]
    scores = [(t, i, i % 5, float(y[i] if t == 1 else v)) for t in range(1, iters + 1) for i, v in enumerate(draw.permutation(y))]
    return spark.createDataFrame(rows, "subject_row long, edge_id int, value double"), spark.createDataFrame(scores, "iter int, subject_row long, fold int, y double")


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_kernel_equals_relational_form(tables, offset):
    edges, outcome = tables
    edges = edges.selectExpr("subject_row", "edge_id", f"value + {offset!r}D AS value")
    masks = engine.select_edges(engine.fold_correlations(edges, outcome), 0.05, engine.group_sizes(outcome))
    key = ["iter", "held", "subject_row"]
    slow = engine.strengths(edges, masks, outcome).toPandas().sort_values(key).reset_index(drop=True)
    fast = kernel.block_strengths(edges, outcome, 0.05, block=10, chunk=3).toPandas().sort_values(key).reset_index(drop=True)
    assert (slow[[*key, "fold"]].to_numpy() == fast[[*key, "fold"]].to_numpy()).all() and (slow.pos != 0).any()
    for c in ("pos", "neg", "y"):
        assert np.abs(slow[c] - fast[c]).max() <= 1e-10 * (1 + offset)


def test_centred_moments_keep_their_digits(tables):
    edges, outcome = tables
    near = engine.fold_correlations(edges, outcome).toPandas().set_index(["iter", "fold", "edge_id"]).sort_index()
    far = engine.fold_correlations(edges.selectExpr("subject_row", "edge_id", "value + 1e6D AS value"), outcome.selectExpr("iter", "subject_row", "fold", "y - 1e6D AS y"))
    far = far.toPandas().set_index(["iter", "fold", "edge_id"]).sort_index()
    live = near.index.get_level_values("edge_id") != 7
    assert np.abs(near.r[live] - far.r[live]).max() < 1e-8  # what rounding of the shifted values leaves
    rows = edges.toPandas().pivot(index="subject_row", columns="edge_id", values="value")
    y = outcome.filter("iter = 1").toPandas().set_index("subject_row").sort_index()
    for held in range(5):
        train = y.fold != held
        assert near.r.loc[(1, held, 3)] == pytest.approx(np.corrcoef(rows.loc[train, 3], y.y[train])[0, 1], abs=1e-10)


def test_refusals_and_slices(tables, monkeypatch):
    edges, outcome = tables
    with pytest.raises(Exception, match="lacks an edge"):
        kernel.block_strengths(edges.filter("NOT (subject_row = 3 AND edge_id = 4)"), outcome, 0.05).collect()
    whole = _sorted(kernel.block_strengths(edges, outcome, 0.05, block=10))
    monkeypatch.setattr(kernel, "MOST", 700)  # two iterations of 60 people and 5 folds
    assert len(kernel.slices(outcome, 700)) == 2
    assert np.allclose(_sorted(kernel.block_strengths(edges, outcome, 0.05, block=10)).to_numpy(), whole.to_numpy(), atol=1e-12)


def _sorted(df):
    return df.toPandas().sort_values(["iter", "held", "subject_row"]).reset_index(drop=True).astype(float)


@pytest.fixture(scope="module")
def people(spark):
    draw = np.random.default_rng(8)
    rows = [(i, float(i % 4 == 0), float(draw.normal()), 3.0 - float(i % 4 == 0), float(draw.integers(0, 6))) for i in range(60)]
    return spark.createDataFrame(rows, "subject_row long, a double, b double, again double, c double")


@pytest.mark.parametrize("ranks", [False, True])
def test_adjusted_kernel_equals_relational_form(tables, people, ranks):
    """Covariates of which one repeats another; also ranks of each training part."""
    edges, outcome = tables
    names = ["a", "b", "again", "c"]
    partial = adjusted.rank_partial_correlations if ranks else adjusted.fold_partial_correlations
    masks = adjusted.select_adjusted(partial(edges, outcome, people, names), 0.1, engine.group_sizes(outcome), 4)
    slow = _sorted(engine.strengths(edges, masks, outcome))
    fast = _sorted(kernel.block_strengths(edges, outcome, 0.1, 10, 3, people, names, ranks)[slow.columns.tolist()])
    assert (slow.pos != 0).any() and (slow.neg != 0).any() and np.abs(slow.to_numpy() - fast.to_numpy()).max() <= 1e-10


@pytest.mark.parametrize("ties", [False, True])
def test_rank_kernel_equals_relational_form(tables, ties):
    edges, outcome = tables
    if ties:
        edges = edges.selectExpr("subject_row", "edge_id", "CASE WHEN edge_id % 2 = 0 THEN round(value, 1) ELSE value END AS value")
        outcome = outcome.selectExpr("iter", "subject_row", "fold", "CASE WHEN iter % 2 = 0 THEN round(y, 1) ELSE y END AS y")
    slow = _sorted(engine.strengths(edges, adjusted.rank_masks(edges, outcome, 0.1, engine.group_sizes(outcome)), outcome))
    fast = _sorted(kernel.block_strengths(edges, outcome, 0.1, 10, 3, ranks=True)[slow.columns.tolist()])
    assert (slow.pos != 0).any() and np.abs(slow.to_numpy() - fast.to_numpy()).max() <= 1e-10


def test_small_parts_take_the_exact_test(tables):
    """Training parts of 8 and 9 with ties: the kernel selects what the relational form does, which is what the exact ends say."""
    edges, outcome = tables
    edges = edges.filter("subject_row < 11").selectExpr("subject_row", "edge_id", "CASE WHEN edge_id % 2 = 0 THEN round(value, 0) ELSE value END AS value")
    outcome = outcome.filter("subject_row < 11").selectExpr("iter", "subject_row", "fold", "CASE WHEN iter % 2 = 0 THEN round(y, 0) ELSE y END AS y")
    slow = _sorted(engine.strengths(edges, adjusted.rank_masks(edges, outcome, 0.1, engine.group_sizes(outcome)), outcome))
    fast = _sorted(kernel.block_strengths(edges, outcome, 0.1, 10, 3, ranks=True)[slow.columns.tolist()])
    assert (slow.pos != 0).any() and np.abs(slow.to_numpy() - fast.to_numpy()).max() <= 1e-10


def test_votes_and_plans_of_their_own(tables, people):
    """Iterations with other people and other folds: each is what it would be alone."""
    edges, outcome = tables
    outcome = outcome.filter("iter = 1 OR subject_row % iter > 0").selectExpr("iter", "subject_row", "int((fold + iter * (subject_row div 7)) % 5) AS fold", "y")
    votes = {(r.iter, r.edge_id, r.sign): r.votes for r in kernel.block_votes(edges, outcome, 0.05, 3, block=10).collect()}
    names, fast = ["a", "b"], _sorted(kernel.block_strengths(edges, outcome, 0.1, 10, 3, people, ["a", "b"]))
    for i in range(1, 5):
        one = outcome.filter(F.col("iter") == i).withColumn("iter", F.lit(1))
        found = engine.select_edges(engine.fold_correlations(edges, one), 0.05, engine.group_sizes(one))
        assert {(i, r.edge_id, r.sign): r.votes for r in engine.consensus(found, ["iter"], 3).collect()} == {k: v for k, v in votes.items() if k[0] == i}
        sets = adjusted.select_adjusted(adjusted.fold_partial_correlations(edges, one, people, names), 0.1, engine.group_sizes(one), 2)
        slow = _sorted(engine.strengths(edges, sets, one))
        mine = fast[fast.iter == i].reset_index(drop=True)[slow.columns]
        assert np.abs(slow.drop(columns="iter").to_numpy() - mine.drop(columns="iter").to_numpy()).max() <= 1e-10


def test_ranks_and_designs():
    draw = np.random.default_rng(1)
    v = draw.integers(0, 5, (30, 7)).astype(float)
    want = np.array([[(c < x).sum() + ((c == x).sum() + 1) / 2 for x in c] for c in v.T]).T
    assert (kernel.ranked(v) == want).all() and kernel.tied(v).all() and not kernel.tied(np.arange(12.0).reshape(4, 3)).any()
    z = np.column_stack([v[:, 0], 2 * v[:, 0] + 1, np.ones(30), v[:, 1], v[:, 0] - v[:, 1], v[:, 2]])
    q = kernel.basis(z)
    assert kernel.independent(z) == [0, 3, 5] and q.shape[1] == 3 and np.allclose(q.T @ q, np.eye(3))
