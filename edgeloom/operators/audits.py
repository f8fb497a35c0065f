"""Audits: tables compared cell by cell, settings of runs, completeness of releases, and checks that end in one verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differing_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of either table that the other one lacks, repeats counted, with the side that has them."""
    second = second.select(first.columns)
    return first.exceptAll(second).withColumn("side", F.lit("first")).unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))


def beyond_tolerance(stored: DataFrame, computed: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(keys..., column, stored, computed): values that differ by the tolerance or more, and keys that one side lacks."""
    pair = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("double").alias("stored"), F.col(f"b.{c}").cast("double").alias("computed"))
    a, b = stored.alias("a"), computed.alias("b")
    both = a.join(b, reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), "full")
    long = both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), F.explode(F.array(*map(pair, values))).alias("v")).select(*keys, "v.*")
    near = F.abs(F.col("stored") - F.col("computed")) < tolerance
    return long.filter(~F.coalesce(near | F.col("stored").eqNullSafe(F.col("computed")), F.lit(False)))


def incompatible(stored: DataFrame, current: DataFrame, presentation: list[str]) -> DataFrame:
    """(key, stored, current): settings, inputs or code hashes (key, value) that forbid resuming; presentation-only keys never do."""
    a = stored.select("key", F.col("value").cast("string").alias("stored"))
    b = current.select("key", F.col("value").cast("string").alias("current"))
    return a.join(b, "key", "full").filter(~F.col("key").isin(presentation) & ~F.col("stored").eqNullSafe(F.col("current")))


def release_gaps(records: DataFrame, signed: DataFrame, owner: str, order: str, status: str, complete: str) -> DataFrame:
    """(owner, last_status, signed): owners whose last record is not complete or that lack a signature."""
    last = records.groupBy(owner).agg(F.max_by(status, order).alias("last_status"))
    both = last.join(signed.select(owner).distinct().withColumn("__signed", F.lit(True)), owner, "left").withColumn("signed", F.coalesce("__signed", F.lit(False))).drop("__signed")
    return both.filter((F.col("last_status") != complete) | F.col("last_status").isNull() | ~F.col("signed"))


def verdict(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, violations, ok): one row a check; a check is a table of violations."""
    rows = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations", (F.col("violations") == 0).alias("ok")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def assert_ok(checks: DataFrame) -> None:
    failed = [r["name"] for r in checks.filter("NOT ok").collect()]  # one row a check
    if failed:
        raise ValueError("failed checks: " + ", ".join(failed))


def preferred_file(current: DataFrame, legacy: DataFrame, names: dict[str, str]) -> DataFrame:
    """(path, sha256, source): the current file of a release where it exists, else its legacy name (names: current to legacy). Raises if both exist and differ.

    Both tables are (path, sha256), as sinks.manifest gives them.
    """
    now = current.select("path", F.col("sha256").alias("__now"))
    old = legacy.replace({v: k for k, v in names.items()}, subset=["path"]).select("path", F.col("sha256").alias("__old"))
    both = now.join(old, "path", "full")
    clash = [r["path"] for r in both.filter(F.col("__now") != F.col("__old")).select("path").limit(5).collect()]
    if clash:
        raise ValueError("current and legacy files differ: " + ", ".join(clash))
    return both.select("path", F.coalesce("__now", "__old").alias("sha256"), F.when(F.col("__now").isNotNull(), "current").otherwise("legacy").alias("source"))


def owning_directory(sources: DataFrame, records: DataFrame) -> DataFrame:
    """(source, directory): the nearest folder above a source that holds a run record; NULL without one. sources: (source); records: (directory).

    A source is exploded into its folders, so the lookup is an equi-join and not a join on prefixes.
    """
    parts = F.split("source", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    found = sources.select("source", F.explode(above).alias("directory")).join(records.select("directory").distinct(), "directory")
    nearest = found.groupBy("source").agg(F.max_by("directory", F.length("directory")).alias("directory"))
    return sources.join(nearest, "source", "left").select("source", "directory")


def with_q(summary: DataFrame, p: str, by: list[str], order: list[str], tolerance: float = 1e-12) -> DataFrame:
    """summary with q: derived where the column is missing (old summaries), else checked against the recomputed one."""
    from ..functions.ranks import benjamini_hochberg

    computed = benjamini_hochberg(summary, p, by, order, "__q")
    if "q" not in summary.columns:
        return computed.withColumnRenamed("__q", "q")
    if not computed.filter(~F.coalesce(F.abs(F.col("q") - F.col("__q")) < tolerance, F.lit(False))).isEmpty():
        raise ValueError("stored q differs from the recomputed one")
    return summary


def connectome_checks(vectors: DataFrame, nodes: int | None = None, subjects: int | None = None, finite: bool = False) -> dict[str, DataFrame]:
    """Violations of the shape of flattened matrices (vec_id, embedding), for `verdict`: square ones, of `nodes` nodes or else of the commonest size (the larger of tied ones),
    as many as `subjects`, without NULL and infinite cells if `finite`. A NULL matrix has no cells: it is square and of another size."""
    sizes = vectors.select("vec_id", "embedding", F.coalesce(F.size("embedding"), F.lit(0)).alias("cells")).withColumn("cells", F.greatest("cells", F.lit(0)))
    root = F.round(F.sqrt("cells")).cast("int")
    found = {"square": sizes.filter(root * root != F.col("cells"))}
    if nodes is None:
        commonest = sizes.groupBy("cells").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "cells"))["cells"].alias("usual"))
        found["one size"] = sizes.join(F.broadcast(commonest), F.col("cells") != F.col("usual"))  # one row
    else:
        found["nodes"] = sizes.filter(F.col("cells") != nodes**2)
    if subjects is not None:
        found["subjects"] = sizes.agg(F.count("*").alias("n")).filter(F.col("n") != subjects)
    if finite:
        off = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        found["finite"] = sizes.filter(F.exists("embedding", off))
    return found


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., rows): keys that several rows have, NULL being a key like others; a check of distinct counts for `verdict`."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
