"""Selection of edges adjusted for covariates: partial correlations in the training part of each fold, from moments alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from . import engine


def _whitening(k: int):
    """Mapper over folds: rows w of a square root of the inverse covariate matrix, the projections of y on them, what is left of y, and the rank."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["n"].to_numpy()
            z = f[[f"z{j}" for j in range(k)]].to_numpy()
            gram = np.stack([np.stack([f[f"z{max(i, j)}z{min(i, j)}"].to_numpy() for j in range(k)], 1) for i in range(k)], 1) - z[:, :, None] * z[:, None, :] / n[:, None, None]
            # columns are brought to one scale, so that the rank does not depend on units
            scale = np.sqrt(np.maximum(np.einsum("njj->nj", gram), 0))
            scale[scale <= 1e-12 * (1 + np.abs(z))] = np.inf
            value, vector = np.linalg.eigh(gram / (scale[:, :, None] * scale[:, None, :]))
            good = value > 1e-10
            w = np.where(good, 1 / np.sqrt(np.where(good, value, 1)), 0)[:, :, None] * vector.transpose(0, 2, 1) / scale[:, None, :]
            y = f[[f"yz{j}" for j in range(k)]].to_numpy() - z * f["sy"].to_numpy()[:, None] / n[:, None]
            p = np.einsum("nij,nj->ni", w, y)
            whole = f["syy"].to_numpy() - f["sy"].to_numpy() ** 2 / n
            out = {"iter": f["iter"], "fold": f["fold"], "n": n, "sy": f["sy"], "rank": good.sum(1), "left_y": whole - (p**2).sum(1), "whole_y": whole}
            yield pd.DataFrame(out | {"z": list(z), "w": list(w.reshape(len(f), -1)), "p": list(p)})

    return run


def fold_partial_correlations(edges: DataFrame, outcome: DataFrame, covariates: DataFrame, names: list[str]) -> DataFrame:
    """(iter, fold, edge_id, n, rank, r): like engine.fold_correlations, with edges and y adjusted for the covariates in the training part.

    covariates: (subject_row, names...). They stay with the subject when y is permuted. Training sums are totals less the fold's own, so edges are read
    once; a covariate that adds nothing to the others does not count in `rank`. r is NULL where an adjusted side has no variance left.
    """
    k = len(names)
    c = F.col
    z = [c(name).cast("double") for name in names]
    rows = outcome.join(covariates.select("subject_row", *(v.alias(f"__z{j}") for j, v in enumerate(z))), "subject_row")
    less = lambda df, sums, *by: df.withColumns({s: F.sum(s).over(W.partitionBy(*by)) - c(s) for s in sums})
    own, sums = _sums(k)
    folds = less(rows.groupBy("iter", "fold").agg(*(v.alias(s) for s, v in own.items())), own, "iter")
    moments = edges.select("subject_row", "edge_id", "value").join(rows, "subject_row").groupBy("iter", "edge_id", "fold").agg(*(v.alias(s) for s, v in sums.items()))
    return _partial(less(moments, sums, "iter", "edge_id"), folds, k)


def _sums(k: int) -> tuple[dict[str, Column], dict[str, Column]]:
    """Sums of a design (y and covariates __z0, ...) and of an edge with it."""
    x, y, z = F.col("value"), F.col("y"), [F.col(f"__z{j}") for j in range(k)]
    own = {"n": F.count("y").cast("double"), "sy": F.sum("y"), "syy": F.sum(y * y)}
    own |= {f"z{j}": F.sum(z[j]) for j in range(k)} | {f"yz{j}": F.sum(y * z[j]) for j in range(k)} | {f"z{i}z{j}": F.sum(z[i] * z[j]) for i in range(k) for j in range(i + 1)}
    return own, {"sx": F.sum(x), "sxx": F.sum(x * x), "sxy": F.sum(x * y)} | {f"xz{j}": F.sum(x * z[j]) for j in range(k)}


def _partial(moments: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """(iter, fold, edge_id, n, rank, r) of the training sums of edges and of designs."""
    c = F.col
    designs = folds.mapInPandas(_whitening(k), "iter int, fold long, n double, sy double, rank int, left_y double, whole_y double, z array<double>, w array<double>, p array<double>")
    train = moments.withColumn("fold", c("fold").cast("long")).join(designs, ["iter", "fold"])
    centred = [c(f"xz{j}") - c("sx") * c("z")[j] / c("n") for j in range(k)]
    shadow = [sum((c("w")[i * k + j] * centred[j] for j in range(1, k)), c("w")[i * k] * centred[0]) for i in range(k)]
    whole = c("sxx") - c("sx") * c("sx") / c("n")
    train = train.withColumns({f"__p{i}": s for i, s in enumerate(shadow)})
    left_x = whole - sum((c(f"__p{i}") * c(f"__p{i}") for i in range(1, k)), c("__p0") * c("__p0"))
    both = c("sxy") - c("sx") * c("sy") / c("n") - sum((c(f"__p{i}") * c("p")[i] for i in range(1, k)), c("__p0") * c("p")[0])
    train = train.withColumns({"__x": left_x, "__whole": whole, "__xy": both})
    lives = (c("__x") > 1e-10 * c("__whole")) & (c("left_y") > 1e-10 * c("whole_y"))
    return train.select("iter", "fold", "edge_id", c("n").cast("long").alias("n"), "rank", F.try_divide("__xy", F.when(lives, F.sqrt("__x") * F.sqrt("left_y"))).alias("r"))


def _ranked_training(edges: DataFrame, outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with `value`, ties `tx`; scores with `y`, ties `ty`): ranks in the training part of each fold, which `fold` names. Scores are ranked by iteration."""
    held = outcome.select(F.col("fold").alias("held")).distinct()
    own = outcome.filter("iter = 1").select("subject_row", F.col("fold").alias("own"))
    parts = own.join(F.broadcast(held), F.col("own") != F.col("held")).select("subject_row", F.col("held").alias("fold"))
    ties = lambda *by: F.count("*").over(W.partitionBy(*by)).cast("double")
    x = edges.select("subject_row", "edge_id", "value").join(parts, "subject_row")
    x = x.select("fold", "subject_row", "edge_id", stats.average_rank("value", "fold", "edge_id").alias("rx"), ties("fold", "edge_id", "value").alias("tx"))
    y = outcome.select("iter", "subject_row", "y").join(parts, "subject_row")
    y = y.select("iter", "fold", "subject_row", stats.average_rank("y", "iter", "fold").alias("ry"), ties("iter", "fold", "y").alias("ty"))
    return x.withColumnRenamed("rx", "value"), y.withColumnRenamed("ry", "y")


def rank_partial_correlations(edges: DataFrame, outcome: DataFrame, covariates: DataFrame, names: list[str]) -> DataFrame:
    """Like fold_partial_correlations, of ranks: edges, scores and covariates are ranked in each training part, then adjusted.

    Covariates are selected in each training part before they are ranked: one that adds nothing to those before it is a constant there.
    """
    k = len(names)
    x, y = _ranked_training(edges, outcome)
    own = outcome.filter("iter = 1").select("subject_row", F.col("fold").alias("own")).join(covariates.select("subject_row", *names), "subject_row").cache()
    held = sorted(r.own for r in own.select("own").distinct().collect())
    designs = None
    for h in held:
        part = own.filter(F.col("own") != h)
        kept = stats.independent_columns(part, names)
        ranked = part.withColumn("__one", F.lit(1)).select(F.lit(h).alias("fold"), "subject_row", *((stats.average_rank(name, "__one") if name in kept else F.lit(0.0)).alias(f"__z{j}") for j, name in enumerate(names)))
        designs = ranked if designs is None else designs.unionByName(ranked)
    rows = y.join(designs, ["fold", "subject_row"])
    own_sums, sums = _sums(k)
    folds = rows.groupBy("iter", "fold").agg(*(v.alias(s) for s, v in own_sums.items()))
    moments = x.join(rows, ["fold", "subject_row"]).groupBy("iter", "edge_id", "fold").agg(*(v.alias(s) for s, v in sums.items()))
    return _partial(moments, folds, k)


def select_adjusted(correlations: DataFrame, p: float, sizes: list[int], k: int) -> DataFrame:
    """Masks as of engine.select_edges; each fold's critical value takes off the rank of its own covariates, of which there are k at most."""
    left = sorted({max(n - rank, 0) for n in sizes for rank in range(k + 1)})
    return engine.select_edges(correlations.withColumn("n", F.col("n") - F.col("rank")), p, left)


def rank_masks(edges: DataFrame, outcome: DataFrame, p: float, sizes: list[int]) -> DataFrame:
    """(iter, fold, edge_id, sign, r): rank selection in the training part of each fold; untied pairs take the rank-distance test, parts below ten the exact one."""
    x, y = _ranked_training(edges, outcome)
    gap = F.col("value") - F.col("y")
    tied = lambda t: F.sum(F.col(t) * F.col(t) - 1) / 2
    paired = x.join(y, ["fold", "subject_row"]).groupBy("iter", "fold", "edge_id")
    sums = [F.count("*").alias("n"), stats.correlation("value", "y").alias("rho"), F.sum(gap * gap).alias("distance"), tied("tx").alias("edge_ties"), tied("ty").alias("y_ties")]
    masks = None
    for n in sizes:
        patterns = [stats.doubled_ranks("value").alias("edge_ranks"), stats.doubled_ranks("y").alias("y_ranks")] if n < 10 else []
        found = paired.agg(*sums, *patterns)
        own = stats.rank_selection(found.filter(F.col("n") == n), p, n).filter("selected AND rho <> 0").select("iter", "fold", "edge_id", F.signum("rho").cast("int").alias("sign"), F.col("rho").alias("r"))
        masks = own if masks is None else masks.unionByName(own)
    return masks
