"""Boosted trees by SQL aggregates against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import boosting, pii

FEATURES = ["a", "b", "c"]


def _plain(rows, rounds=8, rate=0.6, l2=1.0):
    """Margins of boosted trees of depth two, by trying every split."""
    x, y, n = (np.array([r[k] for r in rows], float) for k in (slice(0, 3), 3, 4))
    margin = np.full(len(rows), math.log((n * y).sum() / (n * (1 - y)).sum()))

    def best(g, h, inside):
        found = None
        for f in sorted(range(3)):
            for v in sorted(set(x[inside, f]))[:-1]:
                low = inside & (x[:, f] <= v)
                high = inside & ~low
                gain = g[low].sum() ** 2 / (h[low].sum() + l2) + g[high].sum() ** 2 / (h[high].sum() + l2) - g[inside].sum() ** 2 / (h[inside].sum() + l2)
                if gain > 1e-6 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, low, high)
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = n * (y - p), n * p * (1 - p)
        top = best(g, h, np.ones(len(rows), bool))
        if top is None:
            break
        for side in top[1:]:
            inner = best(g, h, side)
            for leaf in inner[1:] if inner else [side]:
                margin[leaf] += rate * g[leaf].sum() / (h[leaf].sum() + l2)
    return margin


def test_trees_of_all_groups_equal_plain_ones(spark):
    draw = np.random.default_rng(6)
    rows, seen = [], set()
    for kind in range(3):
        for _ in range(60):
            a, b, c = (int(v) for v in draw.integers(0, 5, 3))
            label = int(draw.random() < 1 / (1 + math.exp(-(a - b * (c > 2)))))
            if (kind, a, b, c, label) not in seen and kind != 1:
                seen.add((kind, a, b, c, label))
                rows.append((kind, a, b, c, label, int(draw.integers(1, 9))))
    rows += [(1, k, 0, 0, 1, 2) for k in range(4)]  # one label only
    folded = spark.createDataFrame(rows, "kind int, a int, b int, c int, label int, n long")
    trees = boosting.fit(folded, FEATURES, [0, 1, 2, 3])
    assert trees[1] == [8.0] and trees[3] == [-8.0] and len(trees[0]) > 3
    for kind in (0, 2):
        made = folded.filter(F.col("kind") == kind).select(*FEATURES, "label", "n", boosting.margin(trees[kind], F.col).alias("m")).collect()
        wanted = _plain([tuple(r)[:5] for r in made])
        assert [r.m for r in made] == pytest.approx(wanted.tolist(), abs=1e-6)


def test_pii_trees_learn_on_every_document(spark, monkeypatch):
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.format_string("write to a%d@example.com", "id").alias("text"))
    seen = []

    def fit(folded, features, groups):
        seen.append(folded.agg(F.sum("n")).first()[0])
        return {k: [-8.0] for k in groups}

    monkeypatch.setattr(boosting, "fit", fit)
    pii.train(docs)
    held = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).count()
    assert seen == [2 * (25_000 - held)]  # each document and its twin have one address


def test_trees_do_not_depend_on_partitions(spark):
    draw = np.random.default_rng(8)
    rows = [(0, a, b, c, label, int(draw.integers(1, 9))) for a in range(6) for b in range(6) for c in range(6) for label in (0, 1)]
    folded = spark.createDataFrame(rows, "kind int, a int, b int, c int, label int, n long")
    made = [boosting.fit(folded.repartition(k), FEATURES, [0]) for k in (1, 3)]
    assert made[0] == made[1]
