"""Mixing sources to target weights by entropy balancing, in SQL expressions alone.

1. Sizes (words) are summed by source. Targets share `share` of all sizes by the sources' weights; none exceeds `most` times its source's
   size, and what is above is shared again by weight. This is the level at which min(most * size, level * weight) sums up to the whole.
2. Rates r = min(most, exp(lambda * size / mean size)) solve, for each source, the convex dual of: least relative entropy of rates to
   1 under sum(size * r) = target. Newton steps, kept inside a bracket, run for all sources at once; a step is one aggregate over
   the table of (source, size, documents), which is all that Newton needs.
3. Rates become copies: a document has floor(r) of them, and one more where r - floor(r) exceeds a hash of it by more than its source's
   margin. Margins make the words taken meet the target; only the document at the margin takes a part of a copy.

Sources are compared by value, null is a source of its own and comes last. Null texts have size 0; such documents take nothing. A hash
of doc_id and text decides, so reruns agree and equal rows decide alike but for the one at the margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of, written

WEIGHTS = (3, 1, 2)
STEPS, TOLERANCE = 40, 1e-9
#: Documents of one bin of margins (about).
BIN = 2_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """sources (by..., source, source_size, ...) with target; one row a source, null last in the order of weights. Each value of `by` is a mix of its own."""
    here = W.partitionBy(*by)
    turn = (F.row_number().over(here.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("cap", F.col("source_size") * most)
    whole = here.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = here.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = first.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    sums = weighted.withColumns({"rest": rest, "open": F.sum("weight").over(first.rowsBetween(0, W.unboundedFollowing)), "place": F.row_number().over(first)})
    level = F.col("rest") / F.col("open")
    # the first source, by cap per weight, that stays below its cap sets the level for itself and all after it; of sources that tie the first one, whose rest has lost no cap of them
    below = F.when(level * F.col("weight") <= F.col("cap"), F.struct("place", level.alias("level")))
    sums = sums.withColumn("level", F.min(below).over(whole)["level"])
    return sums.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).drop("weight", "cap", "rest", "open", "place", "level")


def _with(df: DataFrame, table: DataFrame, how: str = "left", keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """df joined to table on keys, null equal to null; no hint: Spark broadcasts the table only where its size on disk allows."""
    other = table.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in table.columns))
    on = df[keys[0]].eqNullSafe(other[f"__{keys[0]}"])
    for c in keys[1:]:
        on = on & df[c].eqNullSafe(other[f"__{c}"])
    return df.join(other, on, how).drop(*(f"__{c}" for c in keys))


def rates(counted: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """(source, lam): the dual's solution for each source; infinite where the target is `most` times the size."""
    size, lam = F.col("size"), F.col("lam")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = sources.select("source", "target", "source_size", "mean", F.when(full, float("inf")).otherwise(0.0).alias("lam"), F.lit(-1e3).alias("low"), F.lit(1e6).alias("high"), full.alias("done"))
    for _ in range(STEPS):
        state = written(state.coalesce(1), "dual")
        if not state.filter("NOT done").limit(1).count():
            break
        raw = F.exp(F.least(F.lit(50.0), lam * size / F.col("mean")))
        joined = _with(counted, state.filter("NOT done").select("source", "lam", "mean"), "inner").withColumn("raw", raw)
        sums = joined.groupBy("source").agg(F.sum(F.col("n") * size * F.least(F.lit(most), F.col("raw"))).alias("taken"), F.sum(F.when(F.col("raw") < most, F.col("n") * size * size / F.col("mean") * F.col("raw")).otherwise(0.0)).alias("slope"))
        moved = _with(state, sums)
        gap = F.col("taken") - F.col("target")
        moved = moved.withColumns({"low": F.when(gap < 0, lam).otherwise(F.col("low")), "high": F.when(gap > 0, lam).otherwise(F.col("high"))})
        newton = lam - F.try_divide(gap, F.col("slope"))
        middle = F.when(F.col("high") >= 1e6, F.greatest(F.lit(1.0), 2 * lam)).when(F.col("low") <= -1e3, F.least(F.lit(-1.0), 2 * lam)).otherwise((F.col("low") + F.col("high")) / 2)
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high")) & (F.abs(newton - lam) < 4 + F.abs(lam))
        near = F.abs(gap) <= TOLERANCE * F.greatest(F.lit(1.0), F.col("target"))
        state = moved.select("source", "target", "source_size", "mean", F.when(F.col("done") | near, lam).when(inside, newton).otherwise(middle).alias("lam"), "low", "high", (F.col("done") | near).alias("done"))
    return state.select("source", "lam")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, pick, size, source_size, target, rate, copies, taken), one row a row of docs; pick is a hash of doc_id and text.

    copies counts whole copies; taken has the words, with the part of a copy that the document at its source's margin adds.
    """
    text = text_of(docs)
    slim = written(docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64("doc_id", docs["text"].cast("string")).alias("pick")), "sizes")
    counted = written(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    by_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("filled"))
    known = targets(by_source, weights, share, float(most)).withColumn("mean", F.coalesce(F.try_divide("source_size", "filled"), F.lit(1.0)))
    known = written(known.coalesce(1), "targets")
    known = written(_with(known, rates(counted.filter("size > 0"), known, float(most))).coalesce(1), "solved")

    rated = _with(slim, known.select("source", "source_size", "target", "docs", "mean", "lam"))
    tilted = F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean")))
    rated = rated.withColumn("rate", F.when(F.col("lam") == float("inf"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), tilted)))
    rated = rated.withColumn("whole", F.floor("rate").cast("long"))
    draw = (F.pmod("pick", F.lit(1 << 40)) + 0.5) / float(1 << 40)
    margin = F.when((F.col("whole") < most) & (F.col("size") > 0), F.col("rate") - F.col("whole") - draw)
    rated = rated.withColumn("margin", margin).withColumn("bin", F.floor((1 - F.col("margin")) / 2 * F.ceil(F.col("docs") / BIN)).cast("long"))

    # words that further copies must add, and the bins of falling margin that supply them
    totals = written(rated.groupBy("source", "target", "bin").agg(F.sum(F.col("size") * F.col("whole")).alias("base"), F.sum("size").alias("words")), "bins")
    order = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    need = F.round("target").cast("long") - F.sum("base").over(W.partitionBy("source"))
    left = totals.withColumn("need", need).filter("bin IS NOT NULL").withColumn("left", F.col("need") - F.coalesce(F.sum("words").over(order), F.lit(0)))
    plan = written(left.select("source", "bin", F.greatest(F.lit(0), "left").alias("left"), ((F.col("left") > 0) & (F.col("left") < F.col("words"))).alias("edge")), "plan")
    planned = _with(rated, plan, keys=("source", "bin")).withColumn("edge", F.coalesce("edge", F.lit(False)))
    # about BIN documents a source stand at the margin; they are taken by falling margin, the last one in part
    ahead = W.partitionBy("source").orderBy(F.desc("margin"), "doc_id", "pick").rowsBetween(W.unboundedPreceding, -1)
    at_edge = planned.filter("edge").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(ahead), F.lit(0)))))
    others = planned.filter("NOT edge").withColumn("extra", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0)))
    every = others.unionByName(at_edge)
    # a document of size 0 has the rate exp(0), yet nothing to take
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("extra") == F.col("size")).cast("int")).otherwise(0)
    return every.select("doc_id", "pick", "size", "source_size", "target", "rate", copies.alias("copies"), (F.col("size") * F.col("whole") + F.col("extra")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with each row as often as its whole copies say; rows alike, which share their hash, repeat as one group. All columns pass.

    Null and empty texts take nothing and are left out, as is every row without a copy; an empty table gives an empty result.
    """
    plan = mix(docs, weights, share, most).groupBy(F.col("pick").alias("__pick")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    keyed = docs.withColumn("__pick", F.xxhash64("doc_id", docs["text"].cast("string")))
    joined = keyed.join(plan, "__pick")
    # of rows alike, each repeats as the floor of their mean; a rest of copies falls to none of them
    times = F.floor(F.col("__copies") / F.col("__rows")).cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)
