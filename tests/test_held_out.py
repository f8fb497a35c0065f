"""Prediction with adjusted and rank selection in each training part, against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from edgeloom import queries as core
from edgeloom import whole_queries as inference
from edgeloom.functions import stats
from edgeloom.sources import readers

SMALL, ITERATIONS = "/root/testdata/sf0.001", 3


def _ranks(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def _whole(spark, fold_of, ranks: bool, adjust: bool) -> dict:
    """model -> (r, p, mse) by loops over iterations, folds and edges."""
    v = readers.table(spark, SMALL, "embeddings")
    edges = readers.connectome(v).toPandas().pivot(index="subject_row", columns="edge_id", values="value").sort_index()
    s = core._subjects(spark, SMALL).toPandas().set_index("subject_row").sort_index()
    x, y, names = edges.to_numpy(), s["y"].to_numpy(), ["study_2", "study_3", "sex", "age"]
    z, fold = s[names].to_numpy(float), fold_of(s)
    order = core.plans.permutations(core._subjects(spark, SMALL), ITERATIONS).toPandas()
    measured = []
    for i in range(1, ITERATIONS + 1):
        source = order[order.iter == i].set_index("subject_row").sort_index()["source_row"]
        t, predicted = s.loc[source, "y"].to_numpy(), np.zeros((3, len(y)))
        for h in np.unique(fold):
            train, test = fold != h, fold == h
            kept, design = [], np.ones((train.sum(), 1))
            for j in range(len(names) * adjust):
                more = np.column_stack([design, z[train, j]])
                if np.linalg.matrix_rank(more) > design.shape[1]:
                    kept, design = [*kept, j], more
            turn = _ranks if ranks else (lambda a: a)
            design = np.column_stack([np.ones(train.sum()), *(turn(z[train, j]) for j in kept)])
            rest = lambda a: a - design @ np.linalg.lstsq(design, a, rcond=None)[0]  # noqa: B023,E731
            left = rest(turn(t[train]))
            r = np.array([np.corrcoef(rest(turn(x[train, e])), left)[0, 1] for e in range(x.shape[1])])
            if ranks and not adjust:
                n = int(train.sum())
                gap = np.array([((_ranks(x[train, e]) - _ranks(t[train])) ** 2).sum() for e in range(x.shape[1])])
                chosen = np.round(np.minimum(gap, (n**3 - n) // 3 - gap)) <= stats.critical_distance(core.P, n)
            else:
                chosen = np.abs(r) > stats.critical_r(core.P, int(train.sum()) - len(kept) - 2)
            pos, neg = x[:, chosen & (r > 0)].sum(1), x[:, chosen & (r < 0)].sum(1)
            for m, columns in enumerate(([pos], [neg], [pos, neg])):
                a = np.column_stack([np.ones(len(y)), *columns])
                predicted[m, test] = a[test] @ np.linalg.lstsq(a[train], t[train], rcond=None)[0]
        measured.append([(np.corrcoef(q, t)[0, 1] if np.ptp(q) > 0 else np.nan, ((q - t) ** 2).mean()) for q in predicted])
    found = np.array(measured)
    return {m: (found[0, k, 0], (found[:, k, 0] >= found[0, k, 0]).mean(), found[0, k, 1]) for k, m in enumerate(("positive", "negative", "combined"))}


@pytest.mark.parametrize("ranks", [False, True])
def test_study_held_out_equals_loops(spark, ranks):
    made = inference.study_held_out_cpm(spark, SMALL, ranks, ITERATIONS).collect()
    wanted = _whole(spark, lambda s: s["study_id"].to_numpy(), ranks, True)["positive"]
    assert [r.model for r in made] == ["positive"]
    assert (made[0].r, made[0].p, made[0].mse) == pytest.approx(wanted, abs=2e-6, nan_ok=True)


@pytest.mark.parametrize(("query", "ranks", "adjust"), [(inference.adjusted_cpm, False, True), (inference.adjusted_rank_cpm, True, True), (inference.rank_cpm, True, False)])
def test_fold_variants_equal_loops(spark, query, ranks, adjust):
    made = {r.model: r for r in query(spark, SMALL, ITERATIONS).collect()}
    folds = core.plans.folds(core._subjects(spark, SMALL), core.FOLDS).toPandas().set_index("subject_row").sort_index()["fold"].to_numpy()
    wanted = _whole(spark, lambda s: folds, ranks, adjust)
    for model, numbers in wanted.items():
        assert (made[model].r, made[model].p, made[model].mse) == pytest.approx(numbers, abs=2e-6, nan_ok=True), model
