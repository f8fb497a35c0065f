"""Networks of nodes: pair counts of masks, enrichment against permuted masks, totals, and stability over partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats


def pair_counts(masks: DataFrame, edge_pairs: DataFrame, pairs: DataFrame, iterations: int) -> DataFrame:
    """(iter, pair, capacity, edges): zero where a mask has no edge of a pair. edge_pairs: (edge_id, pair); pairs: (pair, capacity)."""
    counted = masks.join(edge_pairs, "edge_id").groupBy("iter", "pair").agg(F.count("*").alias("edges"))
    grid = pairs.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    return grid.join(counted, ["iter", "pair"], "left").select("iter", "pair", "capacity", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def enrichment(counts: DataFrame) -> DataFrame:
    """(pair, edges, capacity, density, ratio, log2_ratio, p, q, sparse) of iteration 1 against all others.

    ratio: a pair's density over the whole mask's, NULL for an empty mask; p counts the observed mask among the null ones; q is over pairs.
    """
    one, rows = W.partitionBy("iter"), W.partitionBy("pair")
    observed = F.max(F.when(F.col("iter") == 1, F.col("edges"))).over(rows)
    overall = F.sum("edges").over(one) / F.sum("capacity").over(one)
    every = counts.withColumns({"density": F.col("edges") / F.col("capacity"), "__overall": overall, "p": stats.permutation_p("edges", observed, rows)})
    seen = every.filter("iter = 1").withColumn("ratio", F.try_divide("density", "__overall"))
    seen = seen.withColumns({"log2_ratio": F.when(F.col("ratio") > 0, F.log2("ratio")), "sparse": F.col("edges") < 5})
    tested = stats.benjamini_hochberg(seen.withColumn("__all", F.lit(1)), "p", ["__all"], ["pair"])
    return tested.select("pair", "edges", "capacity", "density", "ratio", "log2_ratio", "p", "q", "sparse")


def mask_totals(counts: DataFrame) -> DataFrame:
    """One row: edges of the observed mask, and mean, median, tails, extremes, p and empty masks of the null ones."""
    totals = counts.groupBy("iter").agg(F.sum("edges").alias("edges"))
    null, value = totals.filter("iter > 1").withColumn("one", F.lit(1)), F.col("edges")
    tails = stats.hazen_at_scale(null, "edges", ["one"], [0.025, 0.975])
    spread = null.groupBy("one").agg(F.avg(value).alias("mean"), F.median(value).alias("middle"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(value == 0).alias("empty"))
    rows = W.partitionBy()
    seen = totals.withColumn("p", stats.permutation_p("edges", F.max(F.when(F.col("iter") == 1, value)).over(rows), rows)).filter("iter = 1").select(F.lit(1).alias("one"), "edges", "p")
    return seen.join(spread, "one").join(tails, "one").drop("one")


def stability(correlations: DataFrame, masks: DataFrame, need: int) -> DataFrame:
    """(edge_id, sign, folds, partitions, mean_r): folds that select an edge, partitions in which `need` folds do, and its mean r over all folds.

    `iter` numbers the partitions; votes are counted in each one first, so the second step has one row an edge and partition.
    """
    votes = masks.groupBy("iter", "edge_id", "sign").agg(F.count("*").alias("votes"))
    summed = votes.groupBy("edge_id", "sign").agg(F.sum("votes").alias("folds"), F.count_if(F.col("votes") >= need).alias("partitions"))
    return summed.join(correlations.groupBy("edge_id").agg(F.avg("r").alias("mean_r")), "edge_id")


def edge_layout(cells: DataFrame, corr_type: str = "pearson", eps: float = 2.0**-52) -> tuple[DataFrame, int]:
    """((subject_row, node_i, node_j, correlated, summed), divisor) of full matrices (subject_row, node_i, node_j, value).

    One edge a pair of nodes (node_i < node_j, divisor 1) where the diagonal is constant over subjects and mirrored cells say the same: for Pearson they differ
    by 64 eps of the largest value at most, for Spearman they have the same ranks over subjects. Then the mirrored mean is summed; Pearson correlates it too, Spearman the upper
    side, whose order is exact. Otherwise both triangles and the diagonal stay and sums are halved (divisor 2). A pair that lacks a side counts as different.
    """
    i, j, v = F.col("node_i"), F.col("node_j"), F.col("value")
    pairs = cells.filter(i != j).groupBy("subject_row", F.least(i, j).alias("node_i"), F.greatest(i, j).alias("node_j")).agg(F.max(F.when(i < j, v)).alias("upper"), F.max(F.when(i > j, v)).alias("lower"))
    diagonal = cells.filter(i == j).groupBy("node_i").agg((F.min("value") == F.max("value")).alias("constant"))
    if corr_type == "spearman":
        ranked = pairs.withColumns({"a": stats.average_rank("upper", "node_i", "node_j"), "b": stats.average_rank("lower", "node_i", "node_j")})
        match = ranked.agg(F.bool_and(F.coalesce((F.col("a") == F.col("b")) & F.col("upper").isNotNull() & F.col("lower").isNotNull(), F.lit(False))).alias("match"))
    else:
        gap = F.max(F.coalesce(F.abs(F.col("upper") - F.col("lower")), F.lit(float("inf"))))
        match = pairs.agg((gap <= 64 * eps * F.greatest(F.lit(1.0), F.max(F.abs("upper")), F.max(F.abs("lower")))).alias("match"))
    decided = match.join(diagonal.agg(F.bool_and("constant").alias("constant")), how="cross").first()  # one row each
    if decided["match"] is not False and decided["constant"] is not False:
        mean = (F.col("upper") + F.col("lower")) / 2
        return pairs.select("subject_row", "node_i", "node_j", (F.col("upper") if corr_type == "spearman" else mean).alias("correlated"), mean.alias("summed")), 1
    return cells.select("subject_row", "node_i", "node_j", v.alias("correlated"), v.alias("summed")), 2


def node_group(atlas: DataFrame, nodes: int, structure: str) -> DataFrame:
    """(node): members of a structure, named in any case. atlas: (node, structure), which must describe each node of 0 to nodes - 1 exactly once."""
    seen = atlas.agg(F.count("*").alias("n"), F.count_distinct("node").alias("kinds"), F.min("node").alias("low"), F.max("node").alias("high")).first()
    if (seen["n"], seen["kinds"], seen["low"], seen["high"]) != (nodes, nodes, 0, nodes - 1):
        raise ValueError(f"the atlas must describe each of {nodes} nodes exactly once")
    return atlas.filter(F.lower("structure") == structure.lower()).select("node")


def group_edges(masks: DataFrame, layout: DataFrame, group: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(outcome, edges, touching, share, within) of the masks (outcome, edge_id): edges with one end or both in a node group, and with both; zeros for an empty mask.

    layout: (edge_id, node_i, node_j), one row an edge; group: (node); outcomes: (outcome).
    """
    end = lambda side: group.select(F.col("node").alias(f"node_{side}"), F.lit(True).alias(side))
    known = layout.join(end("i"), "node_i", "left").join(end("j"), "node_j", "left").select("edge_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in "ij"))
    counted = masks.join(known, "edge_id").groupBy("outcome").agg(F.count("*").alias("edges"), F.count_if(F.col("i") | F.col("j")).alias("touching"), F.count_if(F.col("i") & F.col("j")).alias("within"))
    every = outcomes.join(counted, "outcome", "left").fillna(0, ["edges", "touching", "within"])
    return every.select("outcome", "edges", "touching", (F.col("touching") / F.greatest("edges", F.lit(1))).alias("share"), "within")


def mask_logic(masks: DataFrame, by: list[str], member: str, members: int) -> DataFrame:
    """(by..., edge_id, masks, in_any, in_all): OR and AND of the `members` masks of a group, for the edges of at least one; masks with no edge count as members."""
    counted = masks.groupBy(*by, "edge_id").agg(F.count_distinct(member).alias("masks"))
    return counted.withColumns({"in_any": F.col("masks") > 0, "in_all": F.col("masks") == members})
