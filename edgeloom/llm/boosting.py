"""Gradient-boosted trees of depth two for the logistic loss, whose histograms are SQL aggregates and whose scores are SQL expressions.

Features are small integers. The rows are first folded into distinct ones with counts; each level of a tree is one aggregate
over (node, feature, value), of which at most nodes * features * values sums reach the driver. Gradients are added up as whole
numbers of UNIT, so that the order in which partitions come does not change a tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Gradients and curvatures are whole numbers of this; sums of 8e9 rows fit into a long, more of them fail.
UNIT = 2.0**-30


class Split(NamedTuple):
    feature: str
    most: int
    low: Split | float
    high: Split | float


def value(tree: Split | float, of: Callable[[str], Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(of(tree.feature) <= tree.most, value(tree.low, of)).otherwise(value(tree.high, of))


def margin(trees: list[Split | float], of: Callable[[str], Column]) -> Column:
    total = F.lit(0.0)
    for tree in trees:
        total = total + value(tree, of)
    return total


def probability(trees: list[Split | float], of: Callable[[str], Column]) -> Column:
    return 1 / (1 + F.exp(-margin(trees, of)))


def _best(sums: list[tuple[str, int, float, float]], l2: float) -> tuple[float, str, int, tuple[float, float], tuple[float, float]] | None:
    """The split with the largest gain of (feature, value, gradient, curvature) sums."""
    best = None
    for feature in sorted({s[0] for s in sums}):
        own = sorted(s[1:] for s in sums if s[0] == feature)
        g, h = sum(s[1] for s in own), sum(s[2] for s in own)
        low_g = low_h = 0.0
        for v, dg, dh in own[:-1]:
            low_g, low_h = low_g + dg, low_h + dh
            gain = low_g**2 / (low_h + l2) + (g - low_g) ** 2 / (h - low_h + l2) - g**2 / (h + l2)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, feature, v, (low_g, low_h), (g - low_g, h - low_h))
    return best


def fit(folded: DataFrame, features: list[str], groups: list[int], rounds: int = 8, rate: float = 0.6, l2: float = 1.0) -> dict[int, list[Split | float]]:
    """Trees of each group; all groups share the aggregates of a round.

    folded: `kind` (the group), the features as integers, label 0/1 and n, the number of rows alike. A group without both labels has a constant.
    """
    n = {(int(r.kind), int(r.label)): int(r.n) for r in folded.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    both = [k for k in groups if n.get((k, 0)) and n.get((k, 1))]
    trees: dict[int, list[Split | float]] = {k: [math.log(n[k, 1] / n[k, 0])] if k in both else [8.0 if n.get((k, 1)) else -8.0] for k in groups}

    def each(of: Callable[[int], Column], other: Column) -> Column:
        chosen = other
        for k in both:
            chosen = F.when(F.col("kind") == k, of(k)).otherwise(chosen)
        return chosen

    def histogram(node: Column) -> dict[tuple[int, int], list[tuple[str, int, float, float]]]:
        p = each(lambda k: probability(trees[k], F.col), F.lit(0.5))
        units = lambda c: F.round(c / UNIT).cast("long") * F.col("n")
        at = folded.withColumns({"node": node, "p": p}).withColumns({"g": units(F.col("label") - F.col("p")), "h": units(F.col("p") * (1 - F.col("p")))})
        long = at.select("kind", "node", "g", "h", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("value")) for f in features))).alias("x"))
        found: dict[tuple[int, int], list[tuple[str, int, float, float]]] = {}
        for r in long.groupBy("kind", "node", "x.feature", "x.value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            found.setdefault((int(r.kind), int(r.node)), []).append((r.feature, int(r.value), int(r.g) * UNIT, int(r.h) * UNIT))
        return found

    for _ in range(rounds if both else 0):
        top = histogram(F.lit(0))
        roots = {k: found for k in both if (found := _best(top.get((k, 0), []), l2)) is not None}
        if not roots:
            break
        below = histogram(each(lambda k: F.when(F.col(roots[k][1]) <= roots[k][2], 0).otherwise(1) if k in roots else F.lit(0), F.lit(0)))
        for k, (_, feature, most, *sides) in roots.items():
            leaves: list[Split | float] = []
            for side, (g, h) in enumerate(sides):
                inner = _best(below.get((k, side), []), l2)
                leaves.append(rate * g / (h + l2) if inner is None else Split(inner[1], inner[2], *(rate * a / (b + l2) for a, b in inner[3:])))
            trees[k].append(Split(feature, most, *leaves))
    return trees
