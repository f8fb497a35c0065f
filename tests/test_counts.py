"""Queries with whole counts of iterations: p-values can come out, and equal a plain computation."""

from __future__ import annotations

import numpy as np
import pytest

from edgeloom import whole_queries  # noqa: F401  registers the whole forms
from edgeloom import queries as core
from edgeloom.functions import stats
from edgeloom.plans import plans
from edgeloom.sources import readers

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    v = readers.table(spark, SMALL, "embeddings")
    edges = readers.connectome(v).toPandas().pivot(index="subject_row", columns="edge_id", values="value").sort_index()
    s = core._subjects(spark, SMALL)
    return s, edges, s.toPandas().set_index("subject_row").sort_index()


def _correlations(x, y):
    x, y = x - x.mean(0), y - y.mean()
    return (x * y[:, None]).sum(0) / np.sqrt((x**2).sum(0) * (y**2).sum())


@pytest.mark.parametrize(("name", "by"), [("m11_kfold_cpm_whole", ()), ("w09_cohort_permutation_cpm_whole", ("study_id",))])
def test_p_values_of_a_hundred_iterations(spark, tables, name, by):
    s, edges, behavior = tables
    x, fold = edges.to_numpy(), plans.folds(s, core.FOLDS).toPandas().set_index("subject_row").sort_index()["fold"].to_numpy()
    order = plans.permutations(s, 100, by=by).toPandas()
    found = []
    for _, own in order.groupby("iter"):
        y = behavior.loc[own.set_index("subject_row").sort_index()["source_row"], "y"].to_numpy()
        predicted = np.zeros((3, len(y)))
        for h in range(core.FOLDS):
            train, test = fold != h, fold == h
            r = _correlations(x[train], y[train])
            chosen = np.abs(r) > stats.critical_r(core.P, int(train.sum()) - 2)
            pos, neg = x[:, chosen & (r > 0)].sum(1), x[:, chosen & (r < 0)].sum(1)
            for m, columns in enumerate(([pos], [neg], [pos, neg])):
                a = np.column_stack([np.ones(len(y)), *columns])
                predicted[m, test] = a[test] @ np.linalg.lstsq(a[train], y[train], rcond=None)[0]
        found.append([np.corrcoef(p, y)[0, 1] for p in predicted])
    found = np.array(found)
    made = {r.model: r for r in core.QUERIES[name](spark, SMALL).collect()}
    for k, model in enumerate(("positive", "negative", "combined")):
        assert made[model].r == pytest.approx(found[0, k], abs=2e-6)
        assert made[model].p == pytest.approx((found[:, k] >= found[0, k]).mean(), abs=1e-9)
    assert min(r.p for r in made.values()) == 0.01


def test_stability_of_a_hundred_partitions(spark, tables):
    s, edges, behavior = tables
    x, y = edges.to_numpy(), behavior["y"].to_numpy()
    wanted = {}
    for _, own in plans.partitions(s, core.FOLDS, 123, 222).toPandas().groupby("seed"):
        fold = own.set_index("subject_row").sort_index()["fold"].to_numpy()
        r = np.array([_correlations(x[fold != h], y[fold != h]) for h in range(core.FOLDS)])
        cut = np.array([stats.critical_r(core.P, int((fold != h).sum()) - 2) for h in range(core.FOLDS)])[:, None]
        for sign in (1, -1):
            for e, n in zip(edges.columns, (sign * r > cut).sum(0), strict=True):
                folds, parts = wanted.get((e, sign), (0, 0))
                wanted[e, sign] = (folds + n, parts + (n >= 8))
    made = {(r.edge_id, r.sign): (r.folds, r.partitions) for r in core.QUERIES["m23_stability_whole"](spark, SMALL).collect()}
    assert made == {k: v for k, v in wanted.items() if v[0]}


def test_p_of_enrichment_and_transfer_is_in_hundredths(spark):
    enriched = core.QUERIES["a19_network_enrichment_whole"](spark, SMALL).collect()
    total = core.QUERIES["a22_mask_totals_whole"](spark, SMALL).first()
    assert min(r.p for r in enriched) < 1 / 6 and all(abs(r.p * 100 - round(r.p * 100)) < 1e-6 for r in [*enriched, total])
