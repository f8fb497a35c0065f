"""Connectome-based prediction: selection of edges, network strengths, linear models, cross-validation and permutation p-values.

A fold's training moments are the totals less the fold's own, so selection reads the edges once and not once a fold. Tables carry an
`iter` (permutation) and a `fold`; the large side is always edges, and every aggregate on it combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import correlation, critical_r, mse, pearson, permutation_p

MOMENTS = ("n", "sx", "sy", "sxy", "sxx", "syy")


def moments(x: str, y: str, when: Column | None = None) -> list[Column]:
    a, b = (F.col(c) if when is None else F.when(when, F.col(c)) for c in (x, y))
    terms = (F.count(a).cast("double"), F.sum(a), F.sum(b), F.sum(a * b), F.sum(a * a), F.sum(b * b))
    return [t.alias(name) for t, name in zip(terms, MOMENTS, strict=True)]


def critical(n_train: Column, p: float, sizes: list[int], rank: int = 0) -> Column:
    """Critical |r| by training size; sizes lists those that occur."""
    return F.element_at(F.create_map(*(F.lit(v) for n in sizes for v in (n, critical_r(p, max(n - rank - 2, 0))))), n_train.cast("int"))


def fold_correlations(edges: DataFrame, outcome: DataFrame) -> DataFrame:
    """(iter, fold, edge_id, n, r): correlation of each edge with y in the training part of each fold. outcome: (iter, subject_row, fold, y).

    One pass over the edges: each fold's own means and centred sums are combined for all folds but one, so values far from zero lose no digits. r is NULL where
    an edge or y has no variance but rounding.
    """
    c = F.col
    n = F.count("*").cast("double")
    own = edges.select("subject_row", "edge_id", "value").join(outcome, "subject_row").groupBy("iter", "edge_id", "fold")
    own = own.agg(n.alias("n"), F.avg("value").alias("x"), F.avg("y").alias("y"), (F.var_pop("value") * n).alias("xx"), (F.var_pop("y") * n).alias("yy"), (F.covar_pop("value", "y") * n).alias("xy"))
    whole = lambda v: F.sum(v).over(W.partitionBy("iter", "edge_id"))
    # each fold's mean less the mean of all folds
    own = own.withColumns({"whole": whole("n"), "mx": whole(c("n") * c("x")) / whole("n"), "my": whole(c("n") * c("y")) / whole("n")})
    own = own.withColumns({"dx": c("x") - c("mx"), "dy": c("y") - c("my"), "left": c("whole") - c("n")})
    # centred sums of all, less the fold's own, less what the mean of the others differs from that of all
    less = lambda s, a, b: whole(c(s) + c("n") * c(a) * c(b)) - c(s) - c("n") * c(a) * c(b) * (1 + F.try_divide(c("n"), c("left")))
    train = own.select("iter", "fold", "edge_id", c("left").alias("n"), "mx", "my", less("xx", "dx", "dx").alias("xx"), less("yy", "dy", "dy").alias("yy"), less("xy", "dx", "dy").alias("xy"))
    lives = lambda s, m: F.sqrt(F.greatest(s, F.lit(0.0))) > 1e-13 * F.sqrt("n") * (1 + F.abs(m))
    spread = F.when(lives("xx", "mx") & lives("yy", "my"), F.sqrt(F.greatest("xx", F.lit(0.0))) * F.sqrt(F.greatest("yy", F.lit(0.0))))
    return train.select("iter", "fold", "edge_id", "n", F.try_divide("xy", spread).alias("r"))


def left_out_correlations(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., fold, r): correlation of value and y without the rows of one fold each. rows: (by..., fold, value, y); both are centred by their group's means first."""
    group = W.partitionBy(*by)
    centred = rows.withColumns({c: F.col(c) - F.avg(c).over(group) for c in ("value", "y")})
    own = centred.groupBy(*by, "fold").agg(*moments("value", "y"))
    return own.select(*by, "fold", pearson(*(F.sum(m).over(group) - F.col(m) for m in MOMENTS)).alias("r"))


def weighted_correlations(rows: DataFrame, by: list[str], weight: str) -> DataFrame:
    """(by..., r): correlation of value and y of rows that count `weight` times."""
    n, x, y = F.col(weight), F.col("value"), F.col("y")
    sums = [F.sum(n * t).alias(m) for m, t in zip(MOMENTS, (F.lit(1.0), x, y, x * y, x * x, y * y), strict=True)]
    return rows.groupBy(*by).agg(*sums).select(*by, pearson(*(F.col(m) for m in MOMENTS)).alias("r"))


def select_edges(correlations: DataFrame, p: float, sizes: list[int], rank: int = 0) -> DataFrame:
    """(iter, fold, edge_id, sign, r): edges beyond the critical value, strictly; sign 1 or -1."""
    return correlations.filter(F.abs("r") > critical(F.col("n"), p, sizes, rank)).select("iter", "fold", "edge_id", F.signum("r").cast("int").alias("sign"), "r")


def strengths(edges: DataFrame, masks: DataFrame, outcome: DataFrame) -> DataFrame:
    """(iter, held, subject_row, fold, y, pos, neg): sums over the mask of each held-out fold for every subject; 0 for an empty mask."""
    summed = edges.select("subject_row", "edge_id", "value").join(masks.select("iter", F.col("fold").alias("held"), "edge_id", "sign"), "edge_id").groupBy("iter", "held", "subject_row").agg(F.sum(F.when(F.col("sign") > 0, F.col("value"))).alias("pos"), F.sum(F.when(F.col("sign") < 0, F.col("value"))).alias("neg"))
    grid = outcome.join(outcome.select("iter", F.col("fold").alias("held")).distinct(), "iter")
    return grid.join(summed, ["iter", "held", "subject_row"], "left").select("iter", "held", "subject_row", "fold", "y", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("pos", "neg")))


def fit_models(strength: DataFrame, by: list[str], training: Column) -> DataFrame:
    """Slopes and intercepts of y on pos, on neg, and on both, by group; a predictor without variance gets slope 0."""
    t = lambda c: F.when(training, c)
    pos, neg, y = (t(F.col(c)) for c in ("pos", "neg", "y"))
    base = strength.groupBy(*by).agg(F.avg(pos).alias("mp"), F.avg(neg).alias("mn"), F.avg(y).alias("my"), F.var_pop(pos).alias("vp"), F.var_pop(neg).alias("vn"), F.covar_pop(pos, neg).alias("cpn"), F.covar_pop(pos, y).alias("cpy"), F.covar_pop(neg, y).alias("cny"))
    return solved(base, by)


def solved(base: DataFrame, by: list[str]) -> DataFrame:
    """The models of fit_models from means, variances and covariances of a training part."""
    tiny = 1e-12
    c = F.col
    single = lambda cov, var: F.when(c(var) > tiny, c(cov) / c(var)).otherwise(0.0)
    det = c("vp") * c("vn") - c("cpn") * c("cpn")
    full = det > tiny * c("vp") * c("vn") + tiny * tiny
    base = base.withColumns({"bp": single("cpy", "vp"), "bn": single("cny", "vn")})
    base = base.withColumns({"cp": F.when(full, (c("cpy") * c("vn") - c("cny") * c("cpn")) / F.when(full, det)).otherwise(c("bp")), "cn": F.when(full, (c("cny") * c("vp") - c("cpy") * c("cpn")) / F.when(full, det)).otherwise(F.when(c("vp") > tiny, 0.0).otherwise(c("bn")))})
    return base.select(*by, "bp", "bn", "cp", "cn", (c("my") - c("bp") * c("mp")).alias("ap"), (c("my") - c("bn") * c("mn")).alias("an"), (c("my") - c("cp") * c("mp") - c("cn") * c("mn")).alias("ac"), c("my").alias("base"))


def predict(strength: DataFrame, models: DataFrame, by: list[str], testing: Column) -> DataFrame:
    """Predictions of the positive, negative, combined and baseline models for the rows under `testing`."""
    c = F.col
    return strength.filter(testing).join(models, by).select(*by, "subject_row", "y", (c("ap") + c("bp") * c("pos")).alias("positive"), (c("an") + c("bn") * c("neg")).alias("negative"), (c("ac") + c("cp") * c("pos") + c("cn") * c("neg")).alias("combined"), c("base").alias("baseline"))


def metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by..., model, r, mse) of the three models."""
    long = predictions.select(*by, "y", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in ("positive", "negative", "combined")))).alias("m")).select(*by, "y", "m.*")
    return long.groupBy(*by, "model").agg(correlation("predicted", "y").alias("r"), mse("y", "predicted").alias("mse"))


def permutation_table(measured: DataFrame, by: list[str]) -> DataFrame:
    """(by..., model, r, p, mse, mse_p): iteration 1 is observed; a NULL r never counts as extreme."""
    rows = W.partitionBy(*by, "model")
    observed = lambda c: F.max(F.when(F.col("iter") == 1, F.col(c))).over(rows)
    both = measured.withColumns({"p": permutation_p("r", observed("r"), rows), "mse_p": permutation_p("mse", observed("mse"), rows, larger=False)})
    return both.filter("iter = 1").select(*by, "model", "r", "p", "mse", "mse_p")


def cross_validate(edges: DataFrame, outcome: DataFrame, p: float, sizes: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(correlations, masks, metrics by iteration) of k-fold prediction with permutations."""
    found = fold_correlations(edges, outcome)
    masks = select_edges(found, p, sizes)
    return found, masks, evaluate(edges, outcome, masks)


def evaluate(edges: DataFrame, outcome: DataFrame, masks: DataFrame) -> DataFrame:
    """(iter, model, r, mse): models of given masks, fitted in the training part of each fold and tried on the fold."""
    return measure(strengths(edges, masks, outcome))


def measure(strength: DataFrame) -> DataFrame:
    """(iter, model, r, mse) of the strengths of all subjects under each held-out fold's masks."""
    models = fit_models(strength, ["iter", "held"], F.col("fold") != F.col("held"))
    predictions = predict(strength, models, ["iter", "held"], F.col("fold") == F.col("held"))
    return metrics(predictions, ["iter"])


def consensus(masks: DataFrame, by: list[str], need: int) -> DataFrame:
    """Edges that at least `need` folds select, with their votes."""
    return masks.groupBy(*by, "edge_id", "sign").agg(F.count("*").alias("votes")).filter(F.col("votes") >= need)


def outcome_table(subjects: DataFrame, folds: DataFrame, permuted: DataFrame) -> DataFrame:
    """(iter, subject_row, fold, y): y comes from the permuted row, the fold from the subject's own."""
    y = subjects.select(F.col("subject_row").alias("source_row"), "y")
    return permuted.join(y, "source_row").join(folds, "subject_row").select("iter", "subject_row", "fold", "y")


def group_sizes(outcome: DataFrame, column: str = "fold") -> list[int]:
    """Training sizes that occur when each value of `column` is held out: a few numbers."""
    counts = [int(r.n) for r in outcome.filter("iter = 1").groupBy(column).agg(F.count("*").alias("n")).collect()]
    return sorted({sum(counts) - n for n in counts})
