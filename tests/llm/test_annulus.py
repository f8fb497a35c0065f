"""Centroid clusters against plain loops: odd vectors, ties, repeated rows, few and no vectors; the search against all distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from edgeloom.llm import annulus
from edgeloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string, v int, lot int"


def plain(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    kept = [(i, [max(-(2**27), min(2**27, x)) for x in v]) for i, v in kept]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, own in groups.items():
            centroids[n] = [sum(column) // len(own) for column in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, n, d, sums[n], sum(sums.values()), sha(centroids[n])) for i, d, n in found), key=str)


def clusters(df, **more):
    return sorted(map(tuple, annulus.cluster(df, **more).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "c", 1, 2) for i, e in rows], SCHEMA)


def test_odd_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(k, [float(np.float32(x)) for x in draw.choice([-1.0, 0.0, 0.5, 1.0], 64)]) for k in range(90)]
    rows += [(k, rows[3][1]) for k in range(200, 260)]  # one vector very often
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 63), (303, [0.0] * 65), (304, [None] + [0.0] * 63), (305, [float("nan")] + [0.0] * 63), (306, [float("inf")] * 64), (307, [3.0e38] * 64), (308, [0.0] * 64), (309, [-0.001] * 64)]
    assert clusters(frame(spark, rows)) == plain(rows)


def test_few_and_no_vectors(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(5)]  # centroids that are equal: the smaller number wins
    assert clusters(frame(spark, rows)) == plain(rows)
    assert clusters(frame(spark, rows), k=3, rounds=0) == plain(rows, 3, 0)
    assert annulus.cluster(frame(spark, [(1, None)])).count() == 0
    assert annulus.cluster(frame(spark, []).limit(0)).count() == 0


def test_a_drivers_table(spark):
    df = table(spark, SMALL, "embeddings")
    assert clusters(df) == plain([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("spread", [1, 40, 3000])
def test_the_search_gives_the_nearest_of_all(spread):
    draw = np.random.default_rng(spread)
    centroids = draw.integers(-spread, spread + 1, (40, 64)) * draw.integers(1, 30, (40, 1))
    centroids[7], centroids[31], centroids[12] = centroids[3], -centroids[3], 0
    x = np.concatenate([draw.integers(-spread, spread + 1, (800, 64)) * draw.integers(1, 30, (800, 1)), centroids, np.zeros((2, 64), np.int64), (centroids[3] + centroids[20])[None] // 2])
    number, distance, compared = annulus.Annuli(centroids).nearest(x)
    far = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (number == far.argmin(1)).all() and (distance == far.min(1)).all()
    assert compared < 0.9 * far.size  # norms leave some centroids out
