
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import ranks, stats
from .functions.stats import exact
from .operators import engine
from .plans import plans
from .sources import readers, sinks

FOLDS, ITERATIONS, P = 10, 10, 0.01
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PAIRS = ", ".join(f"({j * 8 + i}, {i}, {j}, {i * 8 + j})" for j in range(8) for i in range(j))
#: Views of the connectome stand-in, for DuckDB.
BASE = f"""
WITH cell(edge_id, node_i, node_j, mirror) AS (VALUES {_PAIRS}),
edges AS (SELECT vec_id AS subject_row, edge_id, node_i, node_j, (CAST(embedding[edge_id + 1] AS DOUBLE) + CAST(embedding[mirror + 1] AS DOUBLE)) / 2 AS value FROM embeddings, cell),
subjects AS (SELECT vec_id AS subject_row, (CAST(embedding[9] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)) / 2 + (CAST(embedding[18] AS DOUBLE) + CAST(embedding[11] AS DOUBLE)) / 2 - (CAST(embedding[27] AS DOUBLE) + CAST(embedding[20] AS DOUBLE)) / 2 + label / 10 AS y, label,
  vec_id % 3 + 1 AS study_id, vec_id % 2 AS sex, CAST((vec_id * 7) % 15 + 20 AS DOUBLE) AS age FROM embeddings),
folds AS (SELECT subject_row, (row_number() OVER (ORDER BY md5('cv:123:' || subject_row), subject_row) - 1) % {FOLDS} AS fold FROM subjects)
"""


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "embeddings")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return readers.behavior(v).join(readers.covariates(v), "subject_row")


def _outcome(spark: SparkSession, sf_dir: str, n: int = ITERATIONS, by: tuple[str, ...] = ()) -> DataFrame:
    s = _subjects(spark, sf_dir)
    return engine.outcome_table(s, plans.folds(s, FOLDS), plans.permutations(s, n, by=by))


def _engine_sql(n: int, by: str = "", text: str = "") -> str:
    """CTEs of k-fold prediction up to metrics by iteration, with the critical value of the oracle's size (500 subjects)."""
    part = f"iter{', ' + by if by else ''}"
    key = f"i.iter, {'s.' + by + ', ' if by else ''}"
    r_crit = stats.critical_r(P, 500 - 500 // FOLDS - 2)
    return f"""{BASE},
iters AS (SELECT unnest(generate_series(1, {n})) AS iter),
ranked AS (SELECT i.iter, s.*, row_number() OVER (PARTITION BY {key.rstrip(', ')} ORDER BY s.subject_row) AS k,
  row_number() OVER (PARTITION BY {key.rstrip(', ')} ORDER BY CASE WHEN i.iter = 1 THEN '' ELSE md5('perm:7:' || i.iter || ':' || s.subject_row) END, s.subject_row) AS h FROM subjects s, iters i),
perm AS (SELECT a.iter, a.subject_row, b.subject_row AS source_row FROM ranked a JOIN ranked b ON a.iter = b.iter AND a.k = b.h {f'AND a.{by} = b.{by}' if by else ''}),
outcome AS (SELECT p.iter, p.subject_row, f.fold, s.y FROM perm p JOIN subjects s ON s.subject_row = p.source_row JOIN folds f ON f.subject_row = p.subject_row),
held AS (SELECT DISTINCT fold AS held FROM folds),
corr AS (SELECT o.iter, h.held, e.edge_id, covar_pop(e.value, o.y) / nullif(stddev_pop(e.value) * stddev_pop(o.y), 0) AS r FROM edges e JOIN outcome o USING (subject_row) JOIN held h ON o.fold <> h.held GROUP BY ALL),
masks AS (SELECT iter, held, edge_id, CAST(sign(r) AS INT) AS sign, r FROM corr WHERE abs(r) > {r_crit!r}),
summed AS (SELECT m.iter, m.held, e.subject_row, sum(CASE WHEN sign > 0 THEN value END) AS pos, sum(CASE WHEN sign < 0 THEN value END) AS neg FROM masks m JOIN edges e USING (edge_id) GROUP BY ALL),
strength AS (SELECT o.iter, h.held, o.subject_row, o.fold, o.y, coalesce(s.pos, 0) AS pos, coalesce(s.neg, 0) AS neg FROM outcome o CROSS JOIN held h LEFT JOIN summed s ON s.iter = o.iter AND s.held = h.held AND s.subject_row = o.subject_row),
m AS (SELECT iter, held, avg(pos) mp, avg(neg) mn, avg(y) my, var_pop(pos) vp, var_pop(neg) vn, covar_pop(pos, neg) cpn, covar_pop(pos, y) cpy, covar_pop(neg, y) cny FROM strength WHERE fold <> held GROUP BY ALL),
b AS (SELECT *, CASE WHEN vp > 1e-12 THEN cpy / vp ELSE 0 END bp, CASE WHEN vn > 1e-12 THEN cny / vn ELSE 0 END bn, vp * vn - cpn * cpn AS det FROM m),
c AS (SELECT *, CASE WHEN det > 1e-12 * vp * vn + 1e-24 THEN (cpy * vn - cny * cpn) / det ELSE bp END cp, CASE WHEN det > 1e-12 * vp * vn + 1e-24 THEN (cny * vp - cpy * cpn) / det WHEN vp > 1e-12 THEN 0 ELSE bn END cn FROM b),
predictions AS (SELECT iter, held, s.subject_row, s.y, my - bp * mp + bp * pos AS positive, my - bn * mn + bn * neg AS negative, my - cp * mp - cn * mn + cp * pos + cn * neg AS combined, my AS baseline FROM strength s JOIN c USING (iter, held) WHERE s.fold = s.held),
long AS (SELECT iter, y, 'positive' AS model, positive AS predicted FROM predictions UNION ALL SELECT iter, y, 'negative', negative FROM predictions UNION ALL SELECT iter, y, 'combined', combined FROM predictions),
measured AS (SELECT iter, model, covar_pop(predicted, y) / nullif(stddev_pop(predicted) * stddev_pop(y), 0) AS r, avg((y - predicted) * (y - predicted)) AS mse FROM long GROUP BY ALL),
{text}"""


_TABLE = """seen AS (SELECT *, max(CASE WHEN iter = 1 THEN r END) OVER (PARTITION BY model) AS r1, max(CASE WHEN iter = 1 THEN mse END) OVER (PARTITION BY model) AS mse1, count(*) OVER (PARTITION BY model) AS n FROM measured),
result AS (SELECT model, max(CASE WHEN iter = 1 THEN r END) AS r, sum(CASE WHEN r >= r1 THEN 1 ELSE 0 END) / max(n) AS p, max(CASE WHEN iter = 1 THEN mse END) AS mse, sum(CASE WHEN mse <= mse1 THEN 1 ELSE 0 END) / max(n) AS mse_p FROM seen GROUP BY model)
SELECT model, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p, round(mse, 6) + 0.0 AS mse, round(mse_p, 6) + 0.0 AS mse_p FROM result"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: exact(c) for c in columns})


@query("m11_kfold_cpm", _engine_sql(ITERATIONS, text=_TABLE))
def kfold_cpm(spark: SparkSession, sf_dir: str, iterations: int = ITERATIONS) -> DataFrame:
    o = _outcome(spark, sf_dir, iterations)
    _, _, measured = engine.cross_validate(readers.connectome(_vectors(spark, sf_dir)), o, P, engine.group_sizes(o))
    return _rounded(engine.permutation_table(measured, []), "r", "p", "mse", "mse_p")


@query("w09_cohort_permutation_cpm", _engine_sql(4, "study_id", _TABLE))
def cohort_cpm(spark: SparkSession, sf_dir: str, iterations: int = 4) -> DataFrame:
    o = _outcome(spark, sf_dir, iterations, ("study_id",))
    _, _, measured = engine.cross_validate(readers.connectome(_vectors(spark, sf_dir)), o, P, engine.group_sizes(o))
    return _rounded(engine.permutation_table(measured, []), "r", "p", "mse", "mse_p")


@query("a07_consensus_mask", _engine_sql(2, text="x AS (SELECT 1) SELECT iter, edge_id, sign, count(*) AS votes FROM masks GROUP BY ALL HAVING count(*) >= 8"))
def consensus_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcome(spark, sf_dir, 2)
    found = engine.fold_correlations(readers.connectome(_vectors(spark, sf_dir)), o)
    return engine.consensus(engine.select_edges(found, P, engine.group_sizes(o)), ["iter"], 8)


@query("m28_mean_fold_r", _engine_sql(2, text="x AS (SELECT 1) SELECT iter, edge_id, count(*) AS folds, round(avg(r), 6) + 0.0 AS mean_r FROM corr GROUP BY ALL"))
def mean_fold_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.fold_correlations(readers.connectome(_vectors(spark, sf_dir)), _outcome(spark, sf_dir, 2))
    return found.groupBy("iter", "edge_id").agg(F.count("*").alias("folds"), exact(F.avg("r")).alias("mean_r"))


@query("a01_network_strength", _engine_sql(1, text="x AS (SELECT 1) SELECT held, subject_row, round(pos, 6) + 0.0 AS pos, round(neg, 6) + 0.0 AS neg FROM strength"))
def network_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, edges = _outcome(spark, sf_dir, 1), readers.connectome(_vectors(spark, sf_dir))
    masks = engine.select_edges(engine.fold_correlations(edges, o), P, engine.group_sizes(o))
    return _rounded(engine.strengths(edges, masks, o).select(F.col("held").cast("long").alias("held"), "subject_row", "pos", "neg"), "pos", "neg")


@query("m08_models", _engine_sql(1, text="x AS (SELECT 1) SELECT held, round(bp, 6) + 0.0 AS bp, round(bn, 6) + 0.0 AS bn, round(cp, 6) + 0.0 AS cp, round(cn, 6) + 0.0 AS cn, round(my, 6) + 0.0 AS base FROM c"))
def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, edges = _outcome(spark, sf_dir, 1), readers.connectome(_vectors(spark, sf_dir))
    masks = engine.select_edges(engine.fold_correlations(edges, o), P, engine.group_sizes(o))
    fitted = engine.fit_models(engine.strengths(edges, masks, o), ["held"], F.col("fold") != F.col("held"))
    return _rounded(fitted.select(F.col("held").cast("long").alias("held"), "bp", "bn", "cp", "cn", "base"), "bp", "bn", "cp", "cn", "base")


@query("m14_study_held_out", BASE + f""",
corr AS (SELECT h.study_id AS held, e.edge_id, covar_pop(e.value, s.y) / nullif(stddev_pop(e.value) * stddev_pop(s.y), 0) AS r, count(*) AS n FROM edges e JOIN subjects s USING (subject_row) JOIN (SELECT DISTINCT study_id FROM subjects) h ON s.study_id <> h.study_id GROUP BY ALL)
SELECT held, edge_id, n, round(r, 6) + 0.0 AS r FROM corr""")
def study_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subjects(spark, sf_dir).select("subject_row", F.col("study_id").alias("fold"), "y", F.lit(1).alias("iter"))
    found = engine.fold_correlations(readers.connectome(_vectors(spark, sf_dir)), s)
    return found.select(F.col("fold").alias("held"), "edge_id", F.col("n").cast("long").alias("n"), exact("r").alias("r"))


@query("m06_spearman_edges", BASE + """,
x AS (SELECT edge_id, subject_row, rank() OVER (PARTITION BY edge_id ORDER BY value) + (count(*) OVER (PARTITION BY edge_id, value) - 1) / 2.0 AS rx FROM edges),
l AS (SELECT subject_row, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2.0 AS ry FROM subjects)
SELECT edge_id, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) + 0.0 AS rho, round(sum((rx - ry) * (rx - ry)), 3) + 0.0 AS distance FROM x JOIN l USING (subject_row) GROUP BY edge_id""")
def spearman_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = readers.connectome(_vectors(spark, sf_dir)).withColumn("rx", stats.average_rank("value", "edge_id"))
    label = readers.behavior(_vectors(spark, sf_dir)).withColumn("one", F.lit(1)).withColumn("ry", stats.average_rank("label", "one"))
    both = ranked.select("edge_id", "subject_row", "rx").join(label.select("subject_row", "ry"), "subject_row")
    gap = F.col("rx") - F.col("ry")
    return both.groupBy("edge_id").agg(exact(stats.correlation("rx", "ry")).alias("rho"), exact(F.sum(gap * gap), 3).alias("distance"))


@query("m03_partial_correlation", BASE + """,
d AS (SELECT edge_id, e.value - (avg(value) OVER w) AS x, y - avg(y) OVER w AS y, age - avg(age) OVER w AS z FROM edges e JOIN subjects USING (subject_row) WINDOW w AS (PARTITION BY edge_id)),
r AS (SELECT edge_id, sum(x*y)/sqrt(sum(x*x)*sum(y*y)) AS xy, sum(x*z)/sqrt(sum(x*x)*sum(z*z)) AS xz, sum(y*z)/sqrt(sum(y*y)*sum(z*z)) AS yz FROM d GROUP BY edge_id)
SELECT edge_id, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) + 0.0 AS r FROM r""")
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of edges and y on age; one covariate has a closed form, so three correlations give the partial one."""
    both = readers.connectome(_vectors(spark, sf_dir)).join(_subjects(spark, sf_dir), "subject_row")
    c = both.groupBy("edge_id").agg(stats.correlation("value", "y").alias("xy"), stats.correlation("value", "age").alias("xz"), stats.correlation("y", "age").alias("yz"))
    return c.select("edge_id", exact(F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)))).alias("r"))


@query("m02_symmetry", """SELECT pos % 8 AS node_i, pos // 8 AS node_j, count(*) AS subjects, round(max(abs(a - b)), 6) + 0.0 AS gap FROM (
  SELECT unnest(generate_series(0, 63)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS a, embedding, vec_id FROM embeddings) t, LATERAL (SELECT CAST(embedding[(pos % 8) * 8 + pos // 8 + 1] AS DOUBLE) AS b) WHERE pos % 8 < pos // 8 GROUP BY ALL""")
def symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(i).cast("long").alias("node_i"), F.lit(j).cast("long").alias("node_j"), F.abs(F.col("embedding")[j * 8 + i].cast("double") - F.col("embedding")[i * 8 + j].cast("double")).alias("gap")) for j in range(8) for i in range(j)))
    return _vectors(spark, sf_dir).select(F.explode(pairs).alias("e")).select("e.*").groupBy("node_i", "node_j").agg(F.count("*").alias("subjects"), exact(F.max("gap")).alias("gap"))


@query("m25_network_pairs", BASE + """,
n AS (SELECT unnest(generate_series(0, 7)) AS node), g AS (SELECT node % 4 AS net, count(*) AS size FROM n GROUP BY ALL),
pairs AS (SELECT a.net AS r, b.net AS c, a.net * (a.net + 1) // 2 + b.net AS pair, CASE WHEN a.net = b.net THEN a.size * (a.size - 1) // 2 ELSE a.size * b.size END AS capacity FROM g a JOIN g b ON a.net >= b.net),
e AS (SELECT DISTINCT edge_id, greatest(node_i % 4, node_j % 4) AS r, least(node_i % 4, node_j % 4) AS c FROM edges)
SELECT p.pair, p.r, p.c, p.capacity, count(e.edge_id) AS edges FROM pairs p LEFT JOIN e ON e.r = p.r AND e.c = p.c GROUP BY ALL""")
def network_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.col("id") % 4
    sizes = spark.range(8).groupBy(net.alias("net")).agg(F.count("*").alias("size"))
    a, b = sizes.select(F.col("net").alias("r"), F.col("size").alias("a")), sizes.select(F.col("net").alias("c"), F.col("size").alias("b"))
    pairs = a.join(b, F.col("r") >= F.col("c")).select(F.expr("r * (r + 1) div 2 + c").alias("pair"), "r", "c", F.when(F.col("r") == F.col("c"), F.expr("a * (a - 1) div 2")).otherwise(F.col("a") * F.col("b")).alias("capacity"))
    e = readers.connectome(_vectors(spark, sf_dir)).select("edge_id", F.greatest(F.col("node_i") % 4, F.col("node_j") % 4).cast("long").alias("r"), F.least(F.col("node_i") % 4, F.col("node_j") % 4).cast("long").alias("c")).distinct()
    return pairs.join(e, ["r", "c"], "left").groupBy("pair", "r", "c", "capacity").agg(F.count("edge_id").alias("edges"))


@query("a11_node_degree", BASE + """,
c AS (SELECT e.edge_id, node_i, node_j, abs(covar_pop(value, y) / (stddev_pop(value) * stddev_pop(y))) AS w FROM edges e JOIN subjects USING (subject_row) GROUP BY ALL),
l AS (SELECT node_i AS node, w FROM c WHERE w > 0.05 UNION ALL SELECT node_j, w FROM c WHERE w > 0.05), d AS (SELECT node, count(*) AS degree, sum(w) AS weight FROM l GROUP BY node)
SELECT node, degree, round(weight, 6) + 0.0 AS weight, round(weight / sum(weight) OVER (), 6) + 0.0 AS share, rank() OVER (ORDER BY round(weight, 6) DESC) AS place FROM d""")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = readers.connectome(_vectors(spark, sf_dir)).join(readers.behavior(_vectors(spark, sf_dir)), "subject_row")
    strong = both.groupBy("edge_id", "node_i", "node_j").agg(F.abs(stats.correlation("value", "y")).alias("w")).filter("w > 0.05")
    d = strong.select(F.explode(F.array("node_i", "node_j")).alias("node"), "w").groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("weight"))
    d = d.withColumn("share", exact(F.col("weight") / F.sum("weight").over(W.partitionBy()))).withColumn("weight", exact("weight"))
    return d.withColumn("place", F.rank().over(W.orderBy(F.desc("weight"))))


@query("w08_quotas", BASE + """,
q AS (SELECT study_id, count(*) AS n, count(*) * 100 / sum(count(*)) OVER () AS share FROM subjects GROUP BY study_id)
SELECT study_id, n, CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, study_id) <= 100 - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM q""")
def quota_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.quotas(readers.covariates(_vectors(spark, sf_dir)), 100)


@query("m24_nested_sample", BASE + """,
sizes(size) AS (VALUES (30), (60), (90)),
q AS (SELECT size, study_id, count(*) * size / sum(count(*)) OVER (PARTITION BY size) AS share FROM subjects, sizes GROUP BY size, study_id),
quota AS (SELECT size, study_id, floor(share) + CASE WHEN row_number() OVER (PARTITION BY size ORDER BY share - floor(share) DESC, study_id) <= size - sum(floor(share)) OVER (PARTITION BY size) THEN 1 ELSE 0 END AS quota FROM q),
r AS (SELECT rep, s.*, row_number() OVER (PARTITION BY rep, study_id ORDER BY md5('nest:5:' || rep || ':' || subject_row), subject_row) AS place FROM subjects s, (SELECT unnest(generate_series(1, 5)) AS rep))
SELECT rep, size, subject_row, r.study_id FROM r JOIN quota USING (study_id) WHERE place <= quota""")
def nested_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.nested_sample(readers.covariates(_vectors(spark, sf_dir)).select("subject_row", "study_id"), [30, 60, 90], 5)


@query("m22_bootstrap", BASE + """,
num AS (SELECT subject_row, row_number() OVER (ORDER BY subject_row) - 1 AS place, count(*) OVER () AS size FROM subjects),
slots AS (SELECT replicate, place AS slot, size FROM num, (SELECT unnest(generate_series(1, 20)) AS replicate)),
drawn AS (SELECT replicate, slot, CAST('0x' || substr(md5('boot:11:' || replicate || ':' || slot), 1, 12) AS BIGINT) % size AS place FROM slots),
v AS (SELECT replicate, e.edge_id, s.y, e.value FROM drawn JOIN num USING (place) JOIN subjects s USING (subject_row) JOIN edges e ON e.subject_row = s.subject_row)
SELECT replicate, edge_id, round(covar_pop(value, y) / (stddev_pop(value) * stddev_pop(y)), 6) + 0.0 AS r FROM v GROUP BY replicate, edge_id""")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of every edge over 20 draws of people."""
    s, v = _with_scores(spark, sf_dir)
    return _rounded(_drawn(plans.bootstraps(s, 20), v, ["edge_id"]), "r")


@query("w12_jackknife", BASE + """,
v AS (SELECT e.edge_id, e.subject_row, value AS x, y FROM edges e JOIN subjects USING (subject_row))
SELECT a.edge_id, a.subject_row, round(covar_pop(b.x, b.y) / (stddev_pop(b.x) * stddev_pop(b.y)), 6) + 0.0 AS r FROM v a JOIN v b ON a.edge_id = b.edge_id AND a.subject_row <> b.subject_row GROUP BY a.edge_id, a.subject_row""")
def jackknife(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every edge less a subject's own moments: no theta join."""
    return _rounded(_left_out(_with_scores(spark, sf_dir)[1], ["edge_id"]), "r")


def _drawn(draws: DataFrame, v: DataFrame, by: list[str]) -> DataFrame:
    """(by..., replicate, r): correlations of drawn people. Equal draws of a replicate are one row with its count, so an edge is read once a person drawn."""
    times = draws.groupBy("replicate", "subject_row").agg(F.count("*").cast("double").alias("times"))
    return engine.weighted_correlations(v.join(times, "subject_row"), [*by, "replicate"], "times")


def _left_out(v: DataFrame, by: list[str]) -> DataFrame:
    """(by..., subject_row, r): correlations without one person each, from totals less that person's own terms."""
    x, y = F.col("value"), F.col("y")
    own = (F.lit(1.0), x, y, x * y, x * x, y * y)
    return v.join(v.groupBy(*by).agg(*engine.moments("value", "y")), by).select(*by, "subject_row", stats.pearson(*(F.col(m) - o for m, o in zip(engine.MOMENTS, own, strict=True))).alias("r"))


def _with_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = readers.behavior(_vectors(spark, sf_dir)).select("subject_row", "y")
    return s, readers.connectome(_vectors(spark, sf_dir)).select("subject_row", "edge_id", "value").join(s, "subject_row")


@query("j09_fold_sizes", BASE + ", h AS (SELECT DISTINCT fold AS held FROM folds) SELECT held, count(*) FILTER (fold <> held) AS n_train, count(*) FILTER (fold = held) AS n_test FROM folds, h GROUP BY held")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = plans.folds(readers.behavior(_vectors(spark, sf_dir)), FOLDS).groupBy(F.col("fold").cast("long").alias("held")).agg(F.count("*").alias("n_test"))
    return own.select("held", (F.sum("n_test").over(W.partitionBy()) - F.col("n_test")).alias("n_train"), "n_test")


@query("x08_fold_listing", BASE + "SELECT fold, string_agg(subject_row::VARCHAR, ',' ORDER BY subject_row) AS rows FROM folds GROUP BY fold")
def fold_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = plans.folds(readers.behavior(_vectors(spark, sf_dir)), FOLDS)
    return f.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.array_join(F.sort_array(F.collect_list("subject_row")), ",").alias("rows"))


@query("x12_bijection", _engine_sql(5, text="x AS (SELECT 1) SELECT iter, count(*) AS n, count(DISTINCT source_row) AS sources, count(*) = count(DISTINCT source_row) AS bijective FROM perm GROUP BY iter"))
def bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plans.permutations(readers.behavior(_vectors(spark, sf_dir)), 5)
    return p.groupBy("iter").agg(F.count("*").alias("n"), F.count_distinct("source_row").alias("sources")).withColumn("bijective", F.col("n") == F.col("sources"))


@query("w03_benjamini_hochberg", """WITH p AS (SELECT l_partkey, l_returnflag AS family, round(1.0 / (1 + count(*) * 1.0 + sum(l_quantity) / 100), 9) AS p FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, l_partkey) AS k, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT family, l_partkey, round(least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS q FROM r""")
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = readers.table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("family"))  # noqa: E741
    p = l.agg(F.round(1.0 / (1 + F.count("*") + F.sum("l_quantity") / 100), 9).alias("p"))
    return ranks.benjamini_hochberg(p, "p", ["family"], ["l_partkey"]).select("family", "l_partkey", exact("q").alias("q"))


@query("w01_average_ranks", "SELECT l_returnflag, l_quantity, count(*) AS n, min(rank_) AS rank FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank_ FROM lineitem) GROUP BY ALL")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values give average ranks of any number of rows without a row-wise window."""
    counted = readers.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("l_returnflag").orderBy("l_quantity").rowsBetween(W.unboundedPreceding, -1))
    return counted.select("l_returnflag", "l_quantity", "n", (F.coalesce(before, F.lit(0)) + (F.col("n") + 1) / 2).alias("rank"))


@query("w02_tie_adjustment", "SELECT l_returnflag, sum(CAST(t AS DOUBLE) * t * t - t) / 2 AS ties FROM (SELECT l_returnflag, l_quantity, count(*) AS t FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def tie_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t").cast("double")
    return readers.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("t")).groupBy("l_returnflag").agg((F.sum(t * t * t - t) / 2).alias("ties"))


@query("a13_hazen_percentiles", """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
w AS (SELECT *, least(greatest(n * 0.025 + 0.5, 1), n) AS a, least(greatest(n * 0.5 + 0.5, 1), n) AS b, least(greatest(n * 0.975 + 0.5, 1), n) AS c FROM r)
SELECT l_returnflag, round(sum(v * greatest(0, 1 - abs(i - a))), 4) + 0.0 AS q025, round(sum(v * greatest(0, 1 - abs(i - b))), 4) + 0.0 AS q5, round(sum(v * greatest(0, 1 - abs(i - c))), 4) + 0.0 AS q975 FROM w GROUP BY l_returnflag""")
def hazen_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ranks.hazen(readers.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], [0.025, 0.5, 0.975])
    return q.select("l_returnflag", *(exact(c, 4).alias(c) for c in ("q025", "q5", "q975")))


@query("w06_top_with_ties", "SELECT * FROM (SELECT p_brand, p_partkey, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place FROM part) WHERE place <= 5")
def top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = readers.table(spark, sf_dir, "part").withColumn("place", F.rank().over(W.partitionBy("p_brand").orderBy(F.desc("p_size"))))
    return ranked.filter("place <= 5").select("p_brand", "p_partkey", "p_size", "place")


@query("o05_top_three", "SELECT c_nationkey, c_custkey, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3")
def top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return readers.table(spark, sf_dir, "customer").withColumn("place", F.row_number().over(order)).filter("place <= 3").select("c_nationkey", "c_custkey", "place")


@query("a10_group_counts_with_zeros", "SELECT n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = readers.table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nation = readers.table(spark, sf_dir, "nation")
    return nation.join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("customers"))


@query("a12_group_statistics", "SELECT l_shipdate::DATE - l_shipdate::DATE AS zero, l_linestatus, min(l_tax) AS low, max(l_tax) AS high, round(avg(l_tax), 6) + 0.0 AS mean, median(l_tax) AS middle, count(*) FILTER (l_discount < 0.05) AS small, round(avg(CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share FROM lineitem GROUP BY ALL")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.col("l_discount") < 0.05
    return readers.table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.lit(0).cast("long").alias("zero"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), exact(F.avg("l_tax")).alias("mean"), F.median("l_tax").alias("middle"), F.count_if(small).alias("small"), exact(F.avg(small.cast("double"))).alias("share"))


@query("a17_histogram", "SELECT CAST(floor(l_discount / 0.03) AS BIGINT) AS bin, CASE WHEN l_tax < 0.02 THEN 'low' WHEN l_tax < 0.05 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY ALL")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("l_tax") < 0.02, "low").when(F.col("l_tax") < 0.05, "middle").otherwise("high")
    return readers.table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_discount") / 0.03).alias("bin"), band.alias("band")).agg(F.count("*").alias("n"))


@query("a16_incomplete_groups", "SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4")
def incomplete_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last")).filter("n <> 4")


@query("a24_pooled_metrics", "SELECT l_returnflag, count(*) AS n, round(covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)), 6) + 0.0 AS r FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), exact(stats.correlation("l_quantity", "l_extendedprice")).alias("r"))


@query("j15_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = readers.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.missing(readers.table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("p10_upsert", """WITH fresh AS (SELECT user_id, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id), stored AS (SELECT user_id, min(value) AS value FROM events GROUP BY user_id)
SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE user_id NOT IN (SELECT user_id FROM fresh)""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.table(spark, sf_dir, "events")
    fresh = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("value").alias("value"))
    return sinks.upserted(e.groupBy("user_id").agg(F.min("value").alias("value")), fresh, ["user_id"])


@query("w14_last_record", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max("event_id").alias("event_id"))


@query("s05_source_fallback", """SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.value, b.value) AS value, a.value IS NULL AS fallback_used FROM
(SELECT user_id, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id) a FULL JOIN (SELECT user_id, max(value) AS value FROM events GROUP BY user_id) b USING (user_id)""")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.table(spark, sf_dir, "events")
    best = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("value"))
    return readers.with_fallback(best, e.groupBy("user_id").agg(F.max("value").alias("value")), "user_id", "value")


@query("s14_key_values", "SELECT event_id, 'k' AS key, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS number FROM events WHERE regexp_matches(props, '[0-9]')")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = readers.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k="), F.regexp_extract("props", "([0-9]+)", 1)).alias("line")).filter("line <> 'k='")
    return readers.key_values(lines, "line", "event_id").select("event_id", "key", "number")


@query("p07_label_mapping", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'BLD' WHEN 'MACHINERY' THEN 'MCH' ELSE lower(c_mktsegment) END AS segment, regexp_replace(printf('%.2f', c_acctbal / 100000), '^0\\.', '.') AS share FROM customer WHERE c_acctbal >= 0")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "BLD").when(F.col("c_mktsegment") == "MACHINERY", "MCH").otherwise(F.lower("c_mktsegment"))
    share = F.regexp_replace(stats.decimals(F.col("c_acctbal") / 100000, 2), r"^0\.", ".")
    return readers.table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select("c_custkey", segment.alias("segment"), share.alias("share"))


@query("j13_outcome_pairs", "SELECT a.r_name AS first, b.r_name AS second, a.r_regionkey * 10 + b.r_regionkey AS pair FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def outcome_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readers.table(spark, sf_dir, "region")
    a, b = (r.select(F.col("r_regionkey").alias(f"k{c}"), F.col("r_name").alias(c)) for c in ("first", "second"))
    return a.join(b, F.col("kfirst") < F.col("ksecond")).select("first", "second", (F.col("kfirst") * 10 + F.col("ksecond")).alias("pair"))


@query("j14_mask_overlap", """WITH m AS (SELECT DISTINCT l_returnflag AS mask, l_partkey AS edge FROM lineitem WHERE l_quantity > 45)
SELECT a.mask AS first, b.mask AS second, count(*) AS shared, max(ka.k) AS first_size, max(kb.k) AS second_size, round(2.0 * count(*) / (max(ka.k) + max(kb.k)), 6) + 0.0 AS dice FROM m a JOIN m b ON a.edge = b.edge AND a.mask < b.mask
JOIN (SELECT mask, count(*) AS k FROM m GROUP BY mask) ka ON ka.mask = a.mask JOIN (SELECT mask, count(*) AS k FROM m GROUP BY mask) kb ON kb.mask = b.mask GROUP BY ALL""")
def mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = readers.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_returnflag").alias("mask"), F.col("l_partkey").alias("edge")).distinct()
    sizes = m.groupBy("mask").agg(F.count("*").alias("k"))
    a, b = m.select(F.col("mask").alias("first"), "edge"), m.select(F.col("mask").alias("second"), "edge")
    shared = a.join(b, "edge").filter("first < second").groupBy("first", "second").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col("mask").alias("first"), F.col("k").alias("first_size")), "first").join(sizes.select(F.col("mask").alias("second"), F.col("k").alias("second_size")), "second")
    return both.withColumn("dice", exact(2.0 * F.col("shared") / (F.col("first_size") + F.col("second_size"))))


@query("u02_set_operations", "SELECT 'difference' AS kind, count(*) AS n FROM (SELECT DISTINCT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT 'intersection', count(*) FROM (SELECT DISTINCT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = readers.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    used = readers.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("k"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(part.subtract(used), "difference").unionByName(count(part.intersect(used), "intersection"))


@query("x15_lower_triangle", "SELECT r, coalesce(max(CASE WHEN c = 0 THEN n END), 0) AS c0, coalesce(max(CASE WHEN c = 1 THEN n END), 0) AS c1, coalesce(max(CASE WHEN c = 2 THEN n END), 0) AS c2, coalesce(max(CASE WHEN c = 3 THEN n END), 0) AS c3, coalesce(max(CASE WHEN c = 4 THEN n END), 0) AS c4 FROM (SELECT greatest(a.n_regionkey, b.n_regionkey) AS r, least(a.n_regionkey, b.n_regionkey) AS c, count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey GROUP BY ALL) GROUP BY r")
def lower_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = readers.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    other = n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("o"))
    cells = n.join(other, F.col("n_nationkey") < F.col("k")).select(F.greatest("n_regionkey", "o").alias("r"), F.concat(F.lit("c"), F.least("n_regionkey", "o")).alias("c"))
    return cells.groupBy("r").pivot("c", [f"c{k}" for k in range(5)]).count().fillna(0)


@query("x01_not_measured", "SELECT n_nationkey, p_brand FROM nation CROSS JOIN (SELECT DISTINCT p_brand FROM part) EXCEPT SELECT s_nationkey, p_brand FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49")
def not_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter grid (nations by brands, both small) less what has been measured."""
    part = readers.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    grid = readers.table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(part.select("p_brand").distinct())
    made = readers.table(spark, sf_dir, "lineitem").filter("l_quantity > 49").join(readers.table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    return sinks.missing(grid, made.select(F.col("s_nationkey").alias("n_nationkey"), "p_brand"), ["n_nationkey", "p_brand"])


@query("v03_totals_agree", "SELECT l_returnflag, sum(l_quantity) AS parts, (SELECT sum(l_quantity) FROM lineitem) AS whole, abs(sum(sum(l_quantity)) OVER () - (SELECT sum(l_quantity) FROM lineitem)) < 1e-6 AS agrees FROM lineitem GROUP BY l_returnflag")
def totals_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = readers.table(spark, sf_dir, "lineitem")  # noqa: E741
    parts = l.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("parts"))
    whole = l.agg(F.sum("l_quantity").alias("whole"))
    return parts.join(F.broadcast(whole)).withColumn("agrees", F.abs(F.sum("parts").over(W.partitionBy()) - F.col("whole")) < 1e-6)


@query("s01_matrix_cells", "SELECT vec_id AS subject_row, pos, pos % 8 AS node_i, pos // 8 AS node_j, round(CAST(v AS DOUBLE), 6) + 0.0 AS value FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS pos, unnest(embedding) AS v FROM embeddings)")
def matrix_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(readers.matrix_cells(_vectors(spark, sf_dir)), "value")


@query("m05_critical_values")
def critical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critical |r| of each fold's training part at four levels; sizes come from the table."""
    sizes = fold_sizes(spark, sf_dir).select("held", "n_train")
    found = [int(r.n_train) for r in sizes.select("n_train").distinct().collect()]  # two sizes at most
    levels = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), engine.critical(F.col("n_train"), p, found).alias("r")) for p in (0.05, 0.01, 0.005, 0.001))))
    return sizes.select("held", "n_train", levels.alias("v")).select("held", "n_train", "v.p", exact("v.r").alias("r"))


_OVERLAPS = f"""WITH o AS ({SQL["j14_mask_overlap"]}), k AS (SELECT first, second, shared, first_size AS a, second_size AS b, (SELECT count(*) FROM part) AS n FROM o),
t AS (SELECT *, unnest(generate_series(shared, least(a, b))) AS x FROM k),
l AS (SELECT first, second, shared, lgamma(a + 1) - lgamma(x + 1) - lgamma(a - x + 1) + lgamma(n - a + 1) - lgamma(b - x + 1) - lgamma(n - a - b + x + 1) - lgamma(n + 1) + lgamma(b + 1) + lgamma(n - b + 1) AS lp FROM t WHERE b - x <= n - a)
SELECT first, second, shared, round(-(max(lp) + ln(sum(exp(lp - m)))) / ln(10), 6) + 0.0 AS score FROM (SELECT *, max(lp) OVER (PARTITION BY first, second) AS m FROM l) GROUP BY first, second, shared"""


@query("m21_overlap_scores", _OVERLAPS)
def overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypergeometric scores of mask overlaps; a score is computed once for each distinct triple of counts."""
    overlaps = mask_overlap(spark, sf_dir).withColumn("total", F.lit(readers.table(spark, sf_dir, "part").count()))

    def scored(frames):
        for frame in frames:
            frame["score"] = [stats.overlap_tail(*map(int, row)) for row in zip(frame["shared"], frame["first_size"], frame["second_size"], frame["total"], strict=True)]
            yield frame

    keys = overlaps.select("shared", "first_size", "second_size", "total").distinct()
    return overlaps.join(keys.mapInPandas(scored, "shared long, first_size long, second_size long, total int, score double").withColumn("total", F.col("total")), ["shared", "first_size", "second_size", "total"]).select("first", "second", "shared", exact("score").alias("score"))


@query("m19_freedman_lane", _engine_sql(5, text="""f AS (SELECT subject_row, y, avg(y) OVER () + covar_pop(age, y) OVER () / var_pop(age) OVER () * (age - avg(age) OVER ()) AS fitted FROM subjects)
SELECT iter, a.subject_row, round(a.fitted + b.y - b.fitted, 6) + 0.0 AS y FROM perm p JOIN f a ON a.subject_row = p.subject_row JOIN f b ON b.subject_row = p.source_row"""))
def freedman_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted values of y on age plus permuted residuals, by iteration."""
    s = _subjects(spark, sf_dir).withColumn("outcome", F.lit("y"))
    return _rounded(plans.freedman_lane(s, plans.permutations(s, 5), "age", ["outcome"]).drop("outcome"), "y")
