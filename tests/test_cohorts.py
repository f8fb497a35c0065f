"""Designs of outcomes against numpy's rank, node groups, masks joined, shapes of connectomes, types by names."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.config import Settings
from edgeloom.operators import audits, designs, networks

_SCHEMA = "outcome string, study_id int, study_2 int, study_3 int, sex int, age double, motion double"


def _rows(seed: int) -> list[tuple]:
    r = np.random.default_rng(seed)
    rows = []
    for outcome in "abcde":
        studies = sorted(r.choice([1, 2, 3], int(r.integers(1, 4)), replace=False).tolist())
        for _ in range(int(r.integers(1, 12))):
            study, sex, age = int(r.choice(studies)), int(r.integers(0, 2)), float(r.integers(20, 23))
            rows.append((outcome, study, int(study == 2), int(study == 3), sex, age, age * 2 - sex if outcome < "c" else float(r.normal())))
    return rows


def _plain(rows: list[tuple]) -> tuple[int, list[str], int]:
    """Columns taken one by one while numpy's rank rises."""
    study = sorted({r[1] for r in rows})
    names = [f"study_{s}" for s in study[1:]] + ["sex", "age", "motion"]
    at = {"study_2": 2, "study_3": 3, "sex": 4, "age": 5, "motion": 6}
    design, kept = np.ones((len(rows), 1)), []
    for name in names:
        wider = np.c_[design, [r[at[name]] for r in rows]]
        if np.linalg.matrix_rank(wider) > np.linalg.matrix_rank(design):
            design, kept = wider, [*kept, name]
    return study[0], kept, 1 + len(kept)


@pytest.mark.parametrize("seed", range(4))
def test_outcome_designs_match_ranks(spark, seed):
    rows = _rows(seed)
    found = designs.outcome_designs(spark.createDataFrame(rows, _SCHEMA), {2: "study_2", 3: "study_3"}, ["sex", "age", "motion"]).collect()
    assert {r.outcome: (r.reference_study, r["columns"], r["rank"]) for r in found} == {o: _plain([r for r in rows if r[0] == o]) for o in {r[0] for r in rows}}


@pytest.mark.parametrize("row", [("a", 2, 0, 0, 1, 20.0, 0.1), ("a", 1, 1, 0, 1, 20.0, 0.1), ("a", 4, 0, 0, 1, 20.0, 0.1), ("a", 1, 0, 0, None, 20.0, 0.1), ("a", None, 0, 0, 1, 20.0, 0.1)])
def test_outcome_designs_refuse_clashing_studies(spark, row):
    df = spark.createDataFrame([("a", 1, 0, 0, 0, 30.0, 0.2), row], _SCHEMA)
    with pytest.raises(Exception, match="do not agree"):
        designs.outcome_designs(df, {2: "study_2", 3: "study_3"}, ["sex", "age", "motion"]).collect()


def test_outcome_designs_of_no_rows(spark):
    assert designs.outcome_designs(spark.createDataFrame([], _SCHEMA), {2: "study_2", 3: "study_3"}, ["sex"]).collect() == []


def test_node_groups(spark):
    atlas = [(0, "Cortex"), (1, "CEREBELLUM"), (2, "Cerebellum"), (3, None)]
    frame = lambda rows: spark.createDataFrame(rows, "node int, structure string")
    group = networks.node_group(frame(atlas), 4, "cerebellum")
    assert sorted(r.node for r in group.collect()) == [1, 2]
    for wrong in (atlas[:3], [*atlas, (3, "Cortex")], [*atlas[:3], (9, "Cortex")], []):
        with pytest.raises(ValueError, match="exactly once"):
            networks.node_group(frame(wrong), 4, "cerebellum")
    layout = spark.createDataFrame([(10, 0, 1), (11, 1, 2), (12, 0, 3), (13, 2, 3)], "edge_id int, node_i int, node_j int")
    masks = spark.createDataFrame([("y", 10), ("y", 11), ("y", 12), ("z", 12)], "outcome string, edge_id int")
    outcomes = spark.createDataFrame([("y",), ("z",), ("none",)], "outcome string")
    found = {r.outcome: tuple(r)[1:] for r in networks.group_edges(masks, layout, group, outcomes).collect()}
    assert found == {"y": (3, 2, pytest.approx(2 / 3), 1), "z": (1, 0, 0.0, 0), "none": (0, 0, 0.0, 0)}


def test_masks_by_or_and_and(spark):
    masks = spark.createDataFrame([("a", 1, 7), ("a", 2, 7), ("a", 2, 7), ("a", 1, 8), ("b", 3, 7)], "g string, fold int, edge_id int")
    found = {(r.g, r.edge_id): (r.masks, r.in_any, r.in_all) for r in networks.mask_logic(masks, ["g"], "fold", 2).collect()}
    assert found == {("a", 7): (2, True, True), ("a", 8): (1, True, False), ("b", 7): (1, True, False)}


def test_shapes_of_connectomes(spark):
    inf, nan = float("inf"), float("nan")
    v = spark.createDataFrame([(1, [0.0] * 4), (2, [0.0] * 4), (3, [0.0] * 3), (4, [0.0] * 9), (5, None), (6, [inf, 0.0, 0.0, 0.0]), (7, [nan] * 4), (8, [None] * 4)], "vec_id int, embedding array<double>")
    bad = lambda checks: {name: df.count() for name, df in checks.items()}
    assert bad(audits.connectome_checks(v, subjects=8, finite=True)) == {"square": 1, "one size": 3, "subjects": 0, "finite": 3}
    assert bad(audits.connectome_checks(v, nodes=3, subjects=9)) == {"square": 1, "nodes": 7, "subjects": 1}
    empty = audits.connectome_checks(v.limit(0), subjects=1, finite=True)
    assert bad(empty) == {"square": 0, "one size": 0, "subjects": 1, "finite": 0}


def test_types_by_names(spark):
    s = Settings()
    names = ["LSD_OBN_score", "x_LSD_VRS", "LSD_GDE", "", None]
    df = spark.createDataFrame([(n, "Kendall" if n == "" else None) for n in names], "name string, other string")
    found = [tuple(r) for r in df.select(s.correlation_type(F.col("name")), s.correlation_type(F.col("name"), F.col("other"))).collect()]
    assert [r[0] for r in found] == [s.correlation_of(n or "") for n in names]
    assert [r[1] for r in found] == ["Pearson", "Pearson", "Spearman", "Kendall", "Spearman"]
