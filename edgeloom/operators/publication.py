"""Tables as they are published: classes side by side, overlaps of masks, rankings of edges and nodes, with the numbers as they are printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from ..sources import readers

#: Iterations of one outcome; an outcome's place times this is added to its iterations, so that all outcomes are one run.
SPAN = 100_000
DASH = "—"


def coded(place: Column | str, iteration: Column | str) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return (c(place) * SPAN + c(iteration)).cast("int")


def decoded(df: DataFrame, names: list[str]) -> DataFrame:
    """df with `outcome` (its name) and `iter` of its own, from a coded iter."""
    place = F.floor(F.col("iter") / SPAN).cast("int")
    return df.withColumns({"outcome": F.element_at(F.array(*map(F.lit, names)), place), "iter": (F.col("iter") % SPAN).cast("int")})


def printed(value: Column | str, digits: int, short: bool = False) -> Column:
    """A number with thousands separators, rounded half to even; without the zero before the point if short; a dash for NULL."""
    text = F.regexp_replace(stats.decimals((F.col(value) if isinstance(value, str) else value) + F.lit(0.0), digits, True), r"^-(0[.0]*)$", "$1")
    return F.coalesce(F.when(F.col(value).isNotNull() if isinstance(value, str) else value.isNotNull(), F.regexp_replace(text, r"^0\.", ".") if short else text), F.lit(DASH))


def class_table(results: DataFrame, outcomes: list[str], classes: dict[str, str]) -> DataFrame:
    """(place, outcome, {class}_r, {class}_p, {class}_q...) of results (outcome, condition, r, p): q over the outcomes of a class.

    classes: condition to the name in the table. Refused if an outcome of a class has several rows, or none.
    """
    wanted = readers.exactly_one(results.filter(F.col("outcome").isin(outcomes) & F.col("condition").isin(list(classes))), ["outcome", "condition"])
    if wanted.count() != len(outcomes) * len(classes):
        raise ValueError("each outcome must have one row in each class")
    tested = stats.benjamini_hochberg(wanted, "p", ["condition"], ["outcome"])
    place = F.array_position(F.array(*map(F.lit, outcomes)), F.col("outcome")).cast("int").alias("place")
    cells = [F.max(F.when(F.col("condition") == c, F.col(v))).alias(f"{name}_{v}") for c, name in classes.items() for v in ("r", "p", "q")]
    return tested.groupBy(place, "outcome").agg(*cells)


def overlaps(masks: DataFrame, outcomes: list[str], thresholds: list[float], edges: int, iterations: int, primary: float) -> DataFrame:
    """(threshold, first, second, size_first, size_second, shared, expected, ratio, dice, p, q) for each threshold and pair of outcomes, of empty masks too.

    masks: (threshold, outcome, iter, edge_id), one row an edge of a mask; outcomes follow the same permutation in an iteration. p is the share of iterations, the
    observed one included, that share as many edges; q is over the pairs at the primary threshold and NULL elsewhere. An edge's outcomes are one array, paired in its own row.
    """
    names = F.array(*map(F.lit, outcomes))
    held = masks.groupBy("threshold", "iter", "edge_id").agg(F.sort_array(F.collect_set(F.array_position(names, F.col("outcome")).cast("int"))).alias("places"))
    met = held.filter("size(places) > 1").select("threshold", "iter", F.explode("places").alias("a"), "places").select("threshold", "iter", "a", F.explode("places").alias("b")).filter("a < b")
    counts = met.groupBy("threshold", "iter", "a", "b").agg(F.count("*").alias("n"))
    sizes = masks.filter("iter = 1").groupBy("threshold", F.array_position(names, F.col("outcome")).cast("int").alias("at")).agg(F.count("*").alias("size"))
    places = range(1, len(outcomes) + 1)
    grid = masks.sparkSession.createDataFrame([(float(t), a, b) for t in thresholds for a in places for b in places if a < b], "threshold double, a int, b int")
    side = lambda c, name: sizes.select("threshold", F.col("at").alias(c), F.col("size").alias(name))
    seen = counts.filter("iter = 1").select("threshold", "a", "b", F.col("n").alias("shared"))
    at = ["threshold", "a", "b"]
    extreme = counts.join(seen, at).groupBy(*at).agg(F.count_if(F.col("n") >= F.col("shared")).alias("extreme"))
    table = grid.join(side("a", "size_first"), ["threshold", "a"], "left").join(side("b", "size_second"), ["threshold", "b"], "left").join(seen, at, "left").join(extreme, at, "left")
    table = table.fillna(0, ["size_first", "size_second", "shared"])
    # nothing shared: every iteration shares as much
    table = table.withColumns({"expected": F.col("size_first") * F.col("size_second") / F.lit(edges), "p": F.when(F.col("shared") == 0, 1.0).otherwise(F.col("extreme") / F.lit(iterations))})
    table = table.withColumns({"ratio": F.try_divide("shared", "expected"), "dice": F.try_divide(2 * F.col("shared"), F.col("size_first") + F.col("size_second"))})
    table = table.withColumns({"first": F.element_at(names, F.col("a")), "second": F.element_at(names, F.col("b"))})
    tested = stats.benjamini_hochberg(table, "p", ["threshold"], ["a", "b"])
    columns = ["threshold", "first", "second", "size_first", "size_second", "shared", "expected", "ratio", "dice", "p"]
    return tested.select(*columns, F.when(F.col("threshold") == primary, F.col("q")).alias("q"))


def printed_overlaps(table: DataFrame, primary: float) -> DataFrame:
    """`overlaps` as eight columns of text; p and q of other thresholds are dashes."""
    main = F.col("threshold") == primary
    return table.select(
        F.concat(F.lit("p < "), printed("threshold", 2, True)).alias("threshold"),
        F.concat_ws("–", "first", "second").alias("pair"),
        F.concat_ws(" / ", printed("size_first", 0), printed("size_second", 0)).alias("mask_edges"),
        F.concat(printed("shared", 0), F.lit(" ("), printed("expected", 2), F.lit(")")).alias("shared"),
        printed("ratio", 2).alias("ratio"),
        printed("dice", 3, True).alias("dice"),
        F.when(main, printed("p", 4, True)).otherwise(DASH).alias("p"),
        F.when(main, printed("q", 4, True)).otherwise(DASH).alias("q"),
    )


def stable_edges(correlations: DataFrame, masks: DataFrame, fixed: int, need: int, partitions: int, folds: int) -> DataFrame:
    """(outcome, edge_id, fixed, consensus, folds, mean_r) of every edge: folds of the fixed partition that select it, partitions in which `need` folds do, folds of all.

    correlations: (outcome, iter, fold, edge_id, r), iter numbering the partitions; masks: (outcome, iter, fold, edge_id). Edges that nothing selects have zeros.
    """
    votes = masks.groupBy("outcome", "iter", "edge_id").agg(F.count("*").alias("votes"))
    summed = votes.groupBy("outcome", "edge_id").agg(F.sum(F.when(F.col("iter") == fixed, F.col("votes"))).alias("fixed"), F.count_if(F.col("votes") >= need).alias("consensus"), F.sum("votes").alias("folds"))
    means = correlations.groupBy("outcome", "edge_id").agg(F.avg("r").alias("mean_r"))
    whole = means.join(summed, ["outcome", "edge_id"], "left").fillna(0, ["fixed", "consensus", "folds"])
    return whole.withColumns({"partitions": F.lit(partitions), "no_folds": F.lit(folds)})


def ranked_edges(stable: DataFrame, ends: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """The first `top` edges of an outcome and all that tie with the last: by consensus, then folds, then mean r rounded to six digits; competition ranks.

    ends: (edge_id, node_i, node_j); nodes: (node, parcel, network).
    """
    by = W.partitionBy("outcome")
    rounded = F.bround("mean_r", 6) + F.lit(0.0)
    most = (F.col("consensus") == F.col("partitions")) & (F.col("folds") == F.col("partitions") * F.col("no_folds"))
    placed = stable.withColumns({"mean_r": rounded, "maximal": F.count_if(most).over(by)})
    placed = placed.withColumn("place", F.rank().over(by.orderBy(F.desc("consensus"), F.desc("folds"), F.desc("mean_r")))).filter(F.col("place") <= top)
    at = lambda k: nodes.select(F.col("node").alias(f"node_{'ij'[k]}"), F.col("parcel").alias(f"roi{k + 1}"), F.col("network").alias(f"network{k + 1}"))
    named = placed.join(ends, "edge_id").join(at(0), "node_i").join(at(1), "node_j")
    pair = F.when(F.col("network1") == F.col("network2"), F.col("network1")).otherwise(F.concat_ws("–", F.least("network1", "network2"), F.greatest("network1", "network2")))
    frequency = 100 * F.col("folds") / (F.col("partitions") * F.col("no_folds"))
    return named.select("outcome", "place", "edge_id", "roi1", "roi2", pair.alias("network_pair"), "fixed", "consensus", "folds", frequency.alias("frequency"), "mean_r", "maximal")


def ranked_nodes(stable: DataFrame, ends: DataFrame, nodes: DataFrame, need: int, top: int) -> DataFrame:
    """The first `top` nodes of an outcome by the summed selection frequency of their edges, ties of nine digits included, with their degree in the fixed mask."""
    every = stable.join(ends, "edge_id").withColumn("weight", F.col("folds") / (F.col("partitions") * F.col("no_folds")))
    degree = every.select("outcome", "weight", "fixed", F.explode(F.array("node_i", "node_j")).alias("node")).groupBy("outcome", "node").agg(F.count_if(F.col("fixed") >= need).alias("fixed_degree"), F.sum("weight").alias("weighted"))
    by = W.partitionBy("outcome")
    placed = degree.withColumn("share", F.try_divide(100 * F.col("weighted"), F.sum("weighted").over(by)))
    placed = placed.withColumn("place", F.rank().over(by.orderBy(F.desc(F.round("weighted", 9))))).filter(F.col("place") <= top)
    return placed.join(nodes, "node").select("outcome", "place", "node", "parcel", "network", "fixed_degree", "weighted", "share")
