"""Ranks, false-discovery rates and quantiles of groups of any size: rows are range-partitioned, numbered within a partition, and moved by the counts of earlier ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

#: Bits of a row's number within its partition, as monotonically_increasing_id sets them.
_WITHIN = 33


def numbered(df: DataFrame, by: list[str], order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """df with __number (from 1 within each group by `by`, in the order of `order`, nulls first), __size (rows of the group) and __part.

    A group is spread over as many partitions as its share of rows asks for. Rows equal in `by` and `order` lie in one partition, so `order` should tell
    rows apart. The numbered rows are a table in the shared folder: their partitions must not change between its uses.
    """
    keys = [*by, *order]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    placed = written(spread.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__part", F.shiftright("__at", _WITHIN))
    counted = placed.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # one row a group and partition
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = counted.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.col("__part").alias("__p"), (before - F.col("__first") + 1).alias("__move"), F.sum("__n").over(W.partitionBy(*by)).alias("__size"))
    return _joined(placed, parts, by).withColumn("__number", F.col("__at") + F.col("__move")).drop("__at", "__move")


def sorted_rows(df: DataFrame, order: list[str | Column], place: str = "place", partitions: int | None = None) -> DataFrame:
    """df with the place of each row (from 1) in a sort of the whole table: columns ascending with nulls first, or Columns as F.desc gives them.

    As in `numbered`, `order` should tell rows apart; equal rows get places in any order.
    """
    return numbered(df, [], order, partitions).withColumn(place, F.col("__number")).drop("__number", "__size", "__part")


def _joined(placed: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """placed with what parts says of its group (null equal to null) and partition."""
    on = placed["__part"] == parts["__p"]
    for k, c in enumerate(by):
        on = on & placed[c].eqNullSafe(parts[f"__by{k}"])
    return placed.join(parts, on, "left").drop("__p", *(f"__by{k}" for k in range(len(by))))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], order: list[str], q: str = "q", partitions: int | None = None) -> DataFrame:
    """stats.benjamini_hochberg for families of any size: the running minimum from the largest rank is one within partitions and one over their minima.

    p must not be null.
    """
    ranked = numbered(df, by, [p, *order], partitions).withColumn("__raw", F.col(p) * F.col("__size") / F.col("__number"))
    least = ranked.groupBy(*by, "__part").agg(F.min("__raw").alias("__low"))
    later = F.min("__low").over(W.partitionBy(*by).orderBy("__part").rowsBetween(1, W.unboundedFollowing))
    parts = least.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.col("__part").alias("__p"), later.alias("__later"))
    upwards = W.partitionBy(*by, "__part").orderBy(F.desc("__number")).rowsBetween(W.unboundedPreceding, 0)  # the rows of one partition
    found = _joined(ranked, parts, by)
    return found.withColumn(q, F.least(F.lit(1.0), F.min("__raw").over(upwards), "__later")).drop("__part", "__size", "__number", "__raw", "__later")


def hazen(df: DataFrame, value: str, by: list[str], shares: list[float], partitions: int | None = None) -> DataFrame:
    """(by..., q...) as stats.hazen_at_scale gives them: two order statistics for each share; nulls of `value` do not count.

    Values are counted first, so a value that many rows share is one row; a value's rows hold the numbers up to its cumulative count.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__times"))
    ranked = numbered(counted, by, [value], partitions)
    # cumulative counts: within a partition, and of the partitions before
    within = F.sum("__times").over(W.partitionBy(*by, "__part").orderBy("__number").rowsBetween(W.unboundedPreceding, 0))
    totals = ranked.groupBy(*by, "__part").agg(F.sum("__times").alias("__all"))
    before = F.coalesce(F.sum("__all").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select(*(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.col("__part").alias("__p"), before.alias("__before"), F.sum("__all").over(W.partitionBy(*by)).alias("__rows"))
    placed = _joined(ranked.withColumn("__within", within), parts, by)
    last, n = F.col("__before") + F.col("__within"), F.col("__rows")
    first = last - F.col("__times") + 1

    def one(share: float) -> Column:
        at = F.least(F.greatest(n * F.lit(share) + 0.5, F.lit(1.0)), n.cast("double"))
        low = F.floor(at)
        weight = (low.between(first, last)).cast("double") * (1 - (at - low)) + ((low + 1).between(first, last)).cast("double") * (at - low)
        return F.sum(F.when(weight > 0, weight * F.col(value)))

    return placed.groupBy(*by).agg(*(one(s).alias(f"q{str(s).replace('0.', '')}") for s in shares))
