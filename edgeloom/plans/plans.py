"""Resampling plans as tables: folds, permutations, bootstraps, quotas and nested samples.

Every random order is that of md5(name:seed:...), so a plan is data that any engine can rebuild. Orders run over subjects, never over edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(*parts: str | int | Column) -> Column:
    return F.md5(F.concat_ws(":", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def folds(subjects: DataFrame, k: int, seed: int = 123) -> DataFrame:
    """(subject_row, fold): folds of equal size but for one."""
    order = W.orderBy(draw("cv", seed, F.col("subject_row").cast("string")), "subject_row")
    return subjects.select("subject_row", ((F.row_number().over(order) - 1) % k).cast("int").alias("fold"))


def iterations(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(n))))


def permutations(subjects: DataFrame, n: int, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """(iter, subject_row, source_row): iteration 1 is the identity; others shuffle, within `by` if given."""
    every = iterations(subjects.select("subject_row", *by), n)
    here = W.partitionBy("iter", *by)
    ranked = every.withColumns({"__k": F.row_number().over(here.orderBy("subject_row")), "__h": F.row_number().over(here.orderBy(F.when(F.col("iter") == 1, "").otherwise(draw("perm", seed, F.col("iter").cast("string"), F.col("subject_row").cast("string"))), "subject_row"))})
    a = ranked.select("iter", *by, "subject_row", F.col("__k").alias("__at"))
    b = ranked.select("iter", *by, F.col("subject_row").alias("source_row"), F.col("__h").alias("__at"))
    return a.join(b, ["iter", *by, "__at"]).select("iter", *by, "subject_row", "source_row")


def bootstraps(subjects: DataFrame, n: int, seed: int = 11) -> DataFrame:
    """(replicate, slot, subject_row): draws with replacement; a slot's draw is a hash modulo the number of subjects."""
    numbered = subjects.select("subject_row", (F.row_number().over(W.orderBy("subject_row")) - 1).alias("place"))
    size = subjects.count()
    # slots come from a range that all tasks share: those of `numbered` would all leave the one task that numbers people
    slots = subjects.sparkSession.range(size * n).select((F.col("id") % max(size, 1)).cast("int").alias("slot"), (F.floor(F.col("id") / max(size, 1)) + 1).cast("int").alias("replicate"))
    picked = slots.withColumn("place", F.conv(F.substring(draw("boot", seed, F.col("replicate").cast("string"), F.col("slot").cast("string")), 1, 12), 16, 10).cast("long") % size)
    return picked.join(numbered, "place").select("replicate", "slot", "subject_row")


def quotas(strata: DataFrame, size: int, by: str = "study_id") -> DataFrame:
    """(by, n, quota): proportional shares of `size`, largest remainders first, ties to the lower stratum."""
    counted = strata.groupBy(by).agg(F.count("*").alias("n"))
    share = F.col("n") * size / F.sum("n").over(W.partitionBy())
    parts = counted.withColumn("__share", share).withColumn("__floor", F.floor("__share"))
    left = size - F.sum("__floor").over(W.partitionBy())
    extra = F.row_number().over(W.orderBy(F.desc(F.col("__share") - F.col("__floor")), by)) <= left
    return parts.select(by, "n", (F.col("__floor") + extra.cast("int")).alias("quota"))


def nested_sample(strata: DataFrame, sizes: list[int], repetitions: int, seed: int = 5) -> DataFrame:
    """(rep, size, subject_row): stratified samples; a larger one holds the smaller ones of its repetition as long as quotas grow."""
    order = W.partitionBy("rep", "study_id").orderBy(draw("nest", seed, F.col("rep").cast("string"), F.col("subject_row").cast("string")), "subject_row")
    ranked = strata.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("place", F.row_number().over(order))
    every = None
    for size in sizes:
        part = quotas(strata, size).select("study_id", "quota").withColumn("size", F.lit(size))
        every = part if every is None else every.unionByName(part)
    return ranked.join(every, "study_id").filter("place <= quota").select("rep", "size", "subject_row", "study_id")


def partitions(subjects: DataFrame, k: int, first_seed: int, last_seed: int) -> DataFrame:
    """(seed, subject_row, fold): one partition into folds for each seed; a seed's folds are those of `folds`."""
    every = subjects.select("subject_row", F.explode(F.sequence(F.lit(first_seed), F.lit(last_seed))).alias("seed"))
    order = W.partitionBy("seed").orderBy(draw("cv", F.col("seed").cast("string"), F.col("subject_row").cast("string")), "subject_row")
    return every.select("seed", "subject_row", ((F.row_number().over(order) - 1) % k).cast("int").alias("fold"))


def _least_norm(k: int):
    """Mapper over groups: slopes of y on k centred covariates from their covariances, least in norm where some repeat others."""

    def run(frames):
        for f in frames:
            gram = np.stack([np.stack([f[f"zz{max(i, j)}_{min(i, j)}"].to_numpy() for j in range(k)], 1) for i in range(k)], 1).astype(float)
            right = np.stack([f[f"zy{j}"].to_numpy() for j in range(k)], 1).astype(float)
            scale = np.sqrt(np.maximum(np.einsum("njj->nj", gram), 0))
            scale[scale == 0] = np.inf
            value, vector = np.linalg.eigh(gram / (scale[:, :, None] * scale[:, None, :]))
            good = value > 1e-10
            inverse = np.where(good, 1 / np.where(good, value, 1), 0)
            slopes = np.einsum("nij,nj,nkj,nk->ni", vector, inverse, vector, right / scale) / scale
            means = np.stack([f[f"m{j}"].to_numpy() for j in range(k)], 1)
            kept = [c for c in f.columns if not c.startswith(("zz", "zy")) and c not in {f"m{j}" for j in range(k)}]
            yield f[kept].assign(means=list(means), slopes=list(slopes), rank=good.sum(1))

    return run


def fitted_values(outcomes: DataFrame, covariates: list[str], by: list[str]) -> DataFrame:
    """(by..., subject_row, y, fitted, rank): least squares of y on an intercept and all covariates, by group; rank counts covariates that add something.

    One aggregate gives each group's covariances; a constant or repeated covariate changes nothing.
    """
    k, c = len(covariates), [F.col(name).cast("double") for name in covariates]
    cells = {f"zz{i}_{j}": F.covar_pop(c[i], c[j]) for i in range(k) for j in range(i + 1)} | {f"zy{j}": F.covar_pop(c[j], F.col("y")) for j in range(k)} | {f"m{j}": F.avg(c[j]) for j in range(k)}
    summed = outcomes.groupBy(*by).agg(F.avg("y").alias("my"), *(v.alias(name) for name, v in cells.items()))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in summed.schema.fields if f.name in by)
    fit = summed.mapInPandas(_least_norm(k), f"{keys}, my double, means array<double>, slopes array<double>, rank int")
    part = sum((F.col("slopes")[j] * (c[j] - F.col("means")[j]) for j in range(k)), F.lit(0.0))
    return outcomes.join(fit, by).select(*by, "subject_row", "y", (F.col("my") + part).alias("fitted"), "rank")


def freedman_lane(outcomes: DataFrame, permuted: DataFrame, covariates: str | list[str], by: list[str]) -> DataFrame:
    """(by..., iter, subject_row, y): values fitted on the covariates plus permuted residuals; outcomes share the order of `permuted`.

    outcomes: (by..., subject_row, covariates..., y). An outcome measured in part of the subjects needs an order that keeps to that part.
    """
    reduced = fitted_values(outcomes, [covariates] if isinstance(covariates, str) else covariates, by)
    source = reduced.select(*by, F.col("subject_row").alias("source_row"), (F.col("y") - F.col("fitted")).alias("residual"))
    here = reduced.select(*by, "subject_row", "fitted")
    return permuted.select("iter", "subject_row", "source_row").join(source, "source_row").join(here, [*by, "subject_row"]).select(*by, "iter", "subject_row", (F.col("fitted") + F.col("residual")).alias("y"))


def sample_folds(samples: DataFrame, k: int, by: list[str], seed: str) -> DataFrame:
    """samples with fold: each sample (a value of `by`) is cut into k folds of its own, by the order of its seed, a column of `by`."""
    order = W.partitionBy(*by).orderBy(draw("cv", F.col(seed).cast("string"), F.col("subject_row").cast("string")), "subject_row")
    return samples.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))
