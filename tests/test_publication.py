"""Publication tables on small planted results."""

from __future__ import annotations

import pytest

from edgeloom.operators import publication


def test_classes_side_by_side(spark):
    rows = [("a", "near", 0.5, 0.01), ("b", "near", 0.4, 0.04), ("c", "near", 0.1, 0.03), ("a", "far", 0.2, 0.2), ("b", "far", None, 1.0), ("c", "far", 0.3, 0.01), ("d", "far", 0.9, 0.001)]
    results = spark.createDataFrame(rows, "outcome string, condition string, r double, p double")
    table = {r.outcome: r for r in publication.class_table(results, ["c", "a", "b"], {"near": "n", "far": "f"}).collect()}
    assert [table[k].place for k in "cab"] == [1, 2, 3] and table["b"].f_r is None
    assert [table[k].n_q for k in "abc"] == pytest.approx([0.03, 0.04, 0.04]) and [table[k].f_q for k in "abc"] == pytest.approx([0.3, 1.0, 0.03])
    with pytest.raises(ValueError, match="one row each"):
        publication.class_table(results.union(results.limit(1)), ["a", "b", "c"], {"near": "n", "far": "f"})
    with pytest.raises(ValueError, match="each class"):
        publication.class_table(results, ["a", "b", "c", "d"], {"near": "n", "far": "f"})


def test_overlaps_of_planted_masks(spark):
    """Two of three edges shared in the observed iteration and in one of three others; a threshold whose masks are all empty."""
    first = {1: [1, 2, 3], 2: [1, 2], 3: [4], 4: []}
    second = {1: [2, 3], 2: [1, 2], 3: [5], 4: [1]}
    rows = [(0.01, name, i, e) for name, masks in (("a", first), ("b", second)) for i, edges in masks.items() for e in edges]
    masks = spark.createDataFrame(rows, "threshold double, outcome string, iter int, edge_id long")
    found = {(r.threshold, r.first, r.second): r for r in publication.overlaps(masks, ["a", "b", "c"], [0.01, 0.05], 10, 4, 0.01).collect()}
    assert len(found) == 6
    r = found[(0.01, "a", "b")]
    assert (r.size_first, r.size_second, r.shared, r.expected, r.p) == (3, 2, 2, 0.6, 0.5) and r.dice == pytest.approx(0.8) and r.ratio == pytest.approx(2 / 0.6) and r.q == 1.0
    empty = found[(0.05, "b", "c")]
    assert (empty.size_first, empty.shared, empty.ratio, empty.dice, empty.p, empty.q) == (0, 0, None, None, 1.0, None)
    shown = {(r.threshold, r.pair): r for r in publication.printed_overlaps(publication.overlaps(masks, ["a", "b", "c"], [0.01, 0.05], 10, 4, 0.01), 0.01).collect()}
    r = shown[("p < .01", "a–b")]
    assert (r.mask_edges, r.shared, r.ratio, r.dice, r.p, r.q) == ("3 / 2", "2 (0.60)", "3.33", ".800", ".5000", "1.0000")
    r = shown[("p < .05", "a–b")]
    assert (r.mask_edges, r.ratio, r.dice, r.p, r.q) == ("0 / 0", "—", "—", "—", "—")


def test_printed_numbers(spark):
    df = spark.createDataFrame([(12345.0,), (0.125,), (-0.004,), (None,)], "v double")
    assert [tuple(r) for r in df.select(publication.printed("v", 2), publication.printed("v", 2, True)).collect()] == [("12,345.00", "12,345.00"), ("0.12", ".12"), ("0.00", ".00"), ("—", "—")]


def test_rankings_keep_ties_and_unselected_edges(spark):
    correlations = spark.createDataFrame([("o", p, f, e, r) for p in (1, 2) for f in (0, 1) for e, r in ((1, 0.9), (2, 0.5), (3, 0.5), (4, 0.1))], "outcome string, iter int, fold int, edge_id long, r double")
    masks = correlations.filter("edge_id = 1 OR edge_id IN (2, 3) AND iter = 1")
    stable = publication.stable_edges(correlations, masks, 1, 2, 2, 2)
    assert {(r.edge_id, r.fixed, r.consensus, r.folds) for r in stable.collect()} == {(1, 2, 2, 4), (2, 2, 1, 2), (3, 2, 1, 2), (4, 0, 0, 0)}
    ends = spark.createDataFrame([(1, 0, 1), (2, 0, 2), (3, 1, 2), (4, 2, 3)], "edge_id long, node_i int, node_j int")
    nodes = spark.createDataFrame([(0, "p0", "B"), (1, "p1", "A"), (2, "p2", "B"), (3, "p3", "C")], "node int, parcel string, network string")
    edges = publication.ranked_edges(stable, ends, nodes, 2).orderBy("edge_id").collect()
    assert [(r.edge_id, r.place, r.network_pair, r.frequency, r.maximal) for r in edges] == [(1, 1, "A–B", 100.0, 1), (2, 2, "B", 50.0, 1), (3, 2, "A–B", 50.0, 1)]
    by_node = publication.ranked_nodes(stable, ends, nodes, 2, 2).orderBy("node").collect()
    # weights: nodes 0 and 1 have 1.5, node 2 has 1.0, node 3 none
    assert [(r.node, r.place, r.fixed_degree, r.weighted, r.share) for r in by_node] == [(0, 1, 2, 1.5, 37.5), (1, 1, 2, 1.5, 37.5)]
