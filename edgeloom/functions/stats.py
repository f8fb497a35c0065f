"""Statistics as column expressions; what Spark lacks (critical values, rank-distance and hypergeometric tails) as small driver tables."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact(c: Column | str, digits: int = 6) -> Column:
    """Rounded half up, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def decimals(c: Column | str, digits: int, grouped: bool = False) -> Column:
    """A number as printf writes it: the double itself rounded, a true half to even. format_string would round its shortest decimal half up (0.015 to 0.02)."""
    pattern = ("#,##0" if grouped else "0") + ("." + "0" * digits if digits else "")
    return F.call_function("format_number", F.col(c) if isinstance(c, str) else c, F.lit(pattern))


def pearson(n, sx, sy, sxy, sxx, syy) -> Column:
    """Pearson's r of moment sums; NULL where a side is constant."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.try_divide(n * sxy - sx * sy, F.when((vx > 0) & (vy > 0), F.sqrt(vx) * F.sqrt(vy)))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate; NULL instead of an error where a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread))


def mse(y: str, predicted: str) -> Column:
    return F.avg((F.col(y) - F.col(predicted)) * (F.col(y) - F.col(predicted)))


def average_rank(value: str, *by: str) -> Column:
    """Ranks from 1, ties sharing their mean rank."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], order: list[str], q: str = "q") -> DataFrame:
    """df with q: p * m / rank, the running minimum from the largest rank, at most 1; `order` breaks ties of p."""
    family = W.partitionBy(*by)
    df = df.withColumn("__rank", F.row_number().over(family.orderBy(p, *order))).withColumn("__raw", F.col(p) * F.count(p).over(family) / F.col("__rank"))
    upwards = family.orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(q, F.least(F.lit(1.0), F.min("__raw").over(upwards))).drop("__rank", "__raw")


def hazen(values: str | Column, share: float) -> Column:
    """Quantile (i - 0.5) / n of a group's values, as an aggregate."""
    ordered = F.sort_array(F.collect_list(values))
    n = F.size(ordered)
    at = F.least(F.greatest(n * F.lit(share) + 0.5, F.lit(1.0)), n.cast("double"))
    low = F.floor(at).cast("int")
    below, above = F.element_at(ordered, low), F.element_at(ordered, F.least(low + 1, n))
    return below + (at - low) * (above - below)


def hazen_at_scale(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """The same quantiles of groups of any size: a rank window that spills, and two order statistics for each share."""
    group = W.partitionBy(*by)
    ranked = df.filter(F.col(value).isNotNull()).withColumns({"__i": F.row_number().over(group.orderBy(value)), "__n": F.count("*").over(group)})

    def one(share: float) -> Column:
        at = F.least(F.greatest(F.col("__n") * F.lit(share) + 0.5, F.lit(1.0)), F.col("__n").cast("double"))
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("__i") - at))
        return F.sum(F.when(weight > 0, weight * F.col(value)))

    return ranked.groupBy(*by).agg(*(one(s).alias(f"q{str(s).replace('0.', '')}") for s in shares))


def permutation_p(statistic: str, observed: Column, rows: WindowSpec, larger: bool = True) -> Column:
    """Share of all iterations, the observed one included, at least as extreme as the observed value."""
    extreme = F.col(statistic) >= observed if larger else F.col(statistic) <= observed
    return F.try_divide(F.sum(F.coalesce(extreme.cast("int"), F.lit(0))).over(rows), F.count("*").over(rows))


def critical_r(p: float, df: int) -> float:
    """The |r| whose two-sided p-value is p: tails of cos(a) ** (df - 1) over angles."""
    if df <= 0:
        return 1.0
    angle = np.linspace(0, math.pi / 2, 200_001)
    density = np.cos(angle) ** (df - 1)
    tail = np.r_[0, np.cumsum((density[1:] + density[:-1])[::-1])][::-1]
    return float(math.sin(np.interp(-p, -tail / tail[0], angle)))


def spearman_p(d: float, n: int) -> float:
    """Upper-tail probability of rank distance d without ties, by an Edgeworth series (fixed coefficients of algorithm AS 89)."""
    b = 1 / n
    x = (6 * (d - 1) * b / (n * n - 1) - 1) * math.sqrt(1 / b - 1)
    y = x * x
    u = x * b * (0.2274 + b * (0.2531 + 0.1745 * b) + y * (-0.0758 + b * (0.1033 + 0.3932 * b) - y * b * (0.0879 + 0.0151 * b - y * (0.0072 - 0.0831 * b + y * b * (0.0131 - 4.6e-4 * y)))))
    return min(1.0, max(0.0, u * math.exp(-y / 2) + math.erfc(x / math.sqrt(2)) / 2))


def overlap_tail(shared: int, first: int, second: int, total: int) -> float:
    """-log10 of the hypergeometric P[X >= shared]; 0 without a shared edge, at most that of the smallest normal double."""
    if shared <= 0:
        return 0.0
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    whole = choose(total, second)
    terms = [choose(first, x) + choose(total - first, second - x) - whole for x in range(shared, min(first, second) + 1) if second - x <= total - first]
    top = max(terms, default=-math.inf)
    if top == -math.inf:
        return -math.log10(np.finfo(float).tiny)
    return min(-(top + math.log(sum(math.exp(t - top) for t in terms))) / math.log(10), -math.log10(np.finfo(float).tiny)) + 0.0


def exact_tail(n: int):
    """P[D >= d] of n < 10 untied ranks, as a function of d: all n! orders are counted."""
    orders = np.zeros((1, 0), np.int64)
    for k in range(n):
        orders = np.concatenate([np.insert(orders, at, k, axis=1) for at in range(k + 1)])
    distances = np.sort(((orders - np.arange(n)) ** 2).sum(1))
    return lambda d: float(len(distances) - np.searchsorted(distances, d - 1e-9)) / len(distances)


def critical_distance(p: float, n: int) -> int:
    """The largest D that selects an untied pair of n ranks: two-sided p-value of min(D, n3 - D) below p; -1 if none. The p-value grows with D."""
    whole = (n**3 - n) // 3
    tail = exact_tail(n) if n < 10 else lambda d: spearman_p(d, n)
    low, high = -1, whole // 2
    while low < high:
        middle = (low + high + 1) // 2
        if min(1.0, 2 * tail(whole - middle)) < p:
            low = middle
        else:
            high = middle - 1
    return low


@lru_cache(maxsize=4096)
def arrangements(first: tuple[int, ...], second: tuple[int, ...]) -> np.ndarray:
    """How many distinct arrangements of `second` beside `first` have each sum of products; whole numbers above 0.

    Counted place by place over what is left of each distinct value, so ties cost less, not more.
    """
    values, counts = np.unique(second, return_counts=True)
    size = int(np.dot(np.sort(first), np.sort(second))) + 1
    left = {tuple(counts.tolist()): np.eye(1, size, dtype=np.int64)[0]}
    for a in first:
        after: dict[tuple[int, ...], np.ndarray] = {}
        for rest, ways in left.items():
            for j, b in enumerate(values.tolist()):
                if rest[j]:
                    key = (*rest[:j], rest[j] - 1, *rest[j + 1 :])
                    sums = after.setdefault(key, np.zeros(size, np.int64))
                    sums[a * b :] += ways[: size - a * b]
        left = after
    return left[(0,) * len(values)]


@lru_cache(maxsize=65_536)
def exact_ends(first: tuple[int, ...], second: tuple[int, ...], p: float) -> tuple[float, float]:
    """(near, far): rank distances of at most near or at least far have an exact two-sided p-value below p; -1 and infinity if none has.

    first, second: doubled ranks of n < 10 subjects, in any order, ties sharing their mean. p-values are twice the smaller tail over all orders, at most 1.
    """
    first, second = tuple(sorted(first)), tuple(sorted(second))
    ways = arrangements(first, second)
    sums = np.flatnonzero(ways)
    share = ways[sums] / ways.sum()
    low, high = np.cumsum(share), np.cumsum(share[::-1])[::-1]
    whole = sum(a * a for a in first) + sum(b * b for b in second)
    distance = (whole - 2 * sums) / 4
    slack = 1e-12  # a tail of exactly p / 2 does not select, whatever the order of its sum
    near, far = distance[2 * high < p - slack], distance[2 * low < p - slack]
    return float(near.max()) if len(near) else -1.0, float(far.min()) if len(far) else math.inf


def _small_ends(p: float):
    def run(frames):
        for f in frames:
            ends = [exact_ends(tuple(a), tuple(b), p) for a, b in zip(f["edge_ranks"], f["y_ranks"], strict=True)]
            yield f.assign(near=[e[0] for e in ends], far=[e[1] for e in ends])

    return run


def doubled_ranks(ranks: Column | str) -> Column:
    """Twice the ranks of a group of less than ten rows, in ascending order, as an aggregate."""
    return F.sort_array(F.collect_list((F.col(ranks) * 2 if isinstance(ranks, str) else ranks * 2).cast("int")))


def rank_selection(distances: DataFrame, p: float, n: int) -> DataFrame:
    """distances (distance, rho, edge_ties, y_ties) with `selected`: the rank-distance test for untied pairs, Student's t for others.

    Below ten subjects every pair, tied or not, takes its exact distribution; distances then have edge_ranks and y_ranks (`doubled_ranks`). Ranks of n subjects have
    at most 2 ** (n - 1) patterns, so what is computed once a pair of patterns has at most 65,536 rows.
    """
    if n < 10:
        patterns = distances.select("edge_ranks", "y_ranks").distinct()
        ends = patterns.mapInPandas(_small_ends(p), "edge_ranks array<int>, y_ranks array<int>, near double, far double")
        found = distances.join(F.broadcast(ends), ["edge_ranks", "y_ranks"])
        beyond = (F.col("distance") <= F.col("near") + 0.1) | (F.col("distance") >= F.col("far") - 0.1)
        return found.withColumn("selected", beyond).drop("edge_ranks", "y_ranks", "near", "far")
    nearest = F.least(F.col("distance"), F.lit(float((n**3 - n) // 3)) - F.col("distance"))
    untied = (F.col("edge_ties") == 0) & (F.col("y_ties") == 0)
    return distances.withColumn("selected", F.when(untied, F.round(nearest) <= critical_distance(p, n)).otherwise(F.abs("rho") > critical_r(p, n - 2)))


def bias_corrected(replicates: DataFrame, point: DataFrame, jackknife: DataFrame, by: list[str]) -> DataFrame:
    """(by..., r, low, high, bca_low, bca_high): 95 % percentile and bias-corrected accelerated intervals.

    replicates (by..., r), point (by..., r), jackknife (by..., r). Sums are aggregates; only normal tails of one row a group are computed in numpy.
    """
    observed = point.select(*by, F.col("r").alias("point"))
    share = replicates.join(observed, by).groupBy(*by).agg(F.avg((F.col("r") < F.col("point")).cast("double")).alias("below"))
    gap = F.avg("r").over(W.partitionBy(*by)) - F.col("r")
    sums = jackknife.withColumn("gap", gap).groupBy(*by).agg(F.sum(F.col("gap") ** 3).alias("cubes"), F.sum(F.col("gap") ** 2).alias("squares"))
    summary = observed.join(share, by).join(sums, by)

    def shares(frames):
        from statistics import NormalDist

        normal, eps = NormalDist(), float(np.finfo(float).eps)
        for f in frames:
            for column, z in (("low_share", normal.inv_cdf(0.025)), ("high_share", normal.inv_cdf(0.975))):
                found = []
                for below, cubes, squares in zip(f["below"], f["cubes"], f["squares"], strict=True):
                    if not 0 < below < 1:  # all replicates on one side: z0 is infinite
                        found.append(float(below))
                        continue
                    z0, a = normal.inv_cdf(below), cubes / (6 * max(squares**1.5, eps))
                    found.append(normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))))
                f[column] = found
            yield f.drop(columns=["below", "cubes", "squares"])

    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summary.schema.fields if f.name in by)
    asked = summary.mapInPandas(shares, f"{keys}, point double, low_share double, high_share double")
    group = W.partitionBy(*by)
    ranked = replicates.filter("r IS NOT NULL").withColumns({"__i": F.row_number().over(group.orderBy("r")), "__n": F.count("*").over(group)}).join(asked, by)

    def at(name: str, share) -> Column:
        place = F.least(F.greatest(F.col("__n") * share + 0.5, F.lit(1.0)), F.col("__n").cast("double"))
        weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("__i") - place))
        return F.sum(F.when(weight > 0, weight * F.col("r"))).alias(name)

    ends = {"low": F.lit(0.025), "high": F.lit(0.975), "bca_low": F.col("low_share"), "bca_high": F.col("high_share")}
    return ranked.groupBy(*by, F.col("point").alias("r")).agg(*(at(name, s) for name, s in ends.items()))


def independent_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that raise the rank of (1, columns before them), in order. One aggregate gives the Gram matrix; its size is that of the design."""
    k = len(columns)
    cells = [F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]
    row = df.agg(*cells).first()
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            gram[i, j] = gram[j, i] = row[f"c{i}_{j}"] or 0.0
    kept: list[int] = []
    for i in range(k):
        left = gram[i, i]
        if kept:
            part = gram[np.ix_(kept, kept)]
            left -= gram[i, kept] @ np.linalg.solve(part, gram[kept, i])
        if left > 1e-10 * max(gram[i, i], np.finfo(float).tiny):
            kept.append(i)
    return [columns[i] for i in kept]
