"""Intervals of all edges and of predictions, against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from edgeloom import inference_queries as inference
from edgeloom import queries as core
from edgeloom.plans import plans
from edgeloom.sources import readers

SMALL = "/root/testdata/sf0.001"


def test_every_edge_has_draws_and_left_out_rows(spark):
    v = readers.table(spark, SMALL, "embeddings")
    s = readers.behavior(v).toPandas().set_index("subject_row").sort_index()
    x = readers.connectome(v).toPandas().pivot(index="subject_row", columns="edge_id", values="value").sort_index()
    r = lambda e, rows: np.corrcoef(x.loc[rows, e], s.loc[rows, "y"])[0, 1]
    drawn = plans.bootstraps(readers.behavior(v), 20).toPandas().groupby("replicate")["subject_row"].apply(list)
    found = {(m.edge_id, m.replicate): m.r for m in core.bootstrap(spark, SMALL).collect()}
    assert found == pytest.approx({(e, k): r(e, rows) for e in x.columns for k, rows in drawn.items()}, abs=2e-6)
    left = {(m.edge_id, m.subject_row): m.r for m in core.jackknife(spark, SMALL).collect()}
    assert left == pytest.approx({(e, k): r(e, x.index.drop(k)) for e in x.columns for k in x.index}, abs=2e-6)
    whole = {m.edge_id: m for m in inference.bias_corrected_interval(spark, SMALL).collect()}
    assert {e: m.r for e, m in whole.items()} == pytest.approx({e: r(e, x.index) for e in x.columns}, abs=2e-6)
    assert all(m.low <= m.high and m.bca_low <= m.bca_high for m in whole.values())
    many = plans.bootstraps(readers.behavior(v), 200).toPandas().groupby("replicate")["subject_row"].apply(list)
    low, high = np.quantile([r(3 * 8, rows) for rows in many], [0.025, 0.975], method="hazen")
    assert (whole[3 * 8].low, whole[3 * 8].high) == pytest.approx((low, high), abs=2e-6)


def test_predictions_have_intervals(spark):
    sf = "/root/testdata/sf0.01"
    made = {m.model: m for m in inference.prediction_interval(spark, sf).collect()}
    wanted = {m.model: m.r for m in core.kfold_cpm(spark, sf).collect()}
    assert {k: m.r for k, m in made.items()} == pytest.approx(wanted, abs=2e-6)
    assert all(m.low < m.r < m.high for m in made.values() if m.r is not None)
