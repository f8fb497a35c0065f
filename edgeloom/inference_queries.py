"""Further queries: transfer, rank selection, stability, enrichment, joint permutations, intervals, audits. Importing registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import stats
from .functions.stats import exact
from .operators import adjusted, audits, engine, kernel, networks, transfer
from .plans import plans
from .queries import BASE, FOLDS, ITERATIONS, P, _drawn, _engine_sql, _left_out, _outcome, _rounded, _subjects, SQL, _TABLE, _vectors, kfold_cpm, query
from .sources import readers
from .sources.shared import written

THRESHOLDS, TRANSFERS, NULLS = [0.05, 0.01], 3, 6


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(edges by condition and person, scores likewise, number of people): three rows in a row are one person's sessions; people without all three are left out."""
    v = _vectors(spark, sf_dir)
    place = (F.floor(F.col("subject_row") / 3).alias("person"), (F.col("subject_row") % 3).alias("session"))
    scores = readers.behavior(v).select(*place, "y")
    whole = scores.groupBy("person").agg(F.count_distinct("session").alias("sessions")).filter("sessions = 3").select("person")
    named = F.when(F.col("session") == 1, "first").when(F.col("session") == 2, "second").otherwise("train").alias("condition")
    edges = readers.connectome(v).select(*place, "edge_id", "value").join(whole, "person")
    return edges.select("person", named, "edge_id", "value"), scores.join(whole, "person").select("person", named, "y"), whole.count()


def _masks(spark: SparkSession, sf_dir: str, iterations: int = TRANSFERS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    edges, permuted, n = _sessions(spark, sf_dir, iterations)
    train = edges.filter("condition = 'train'").select("person", "edge_id", "value")
    outcome = permuted.filter("condition = 'train'").select("iter", "person", "y")
    return transfer.left_out_masks(train, outcome, THRESHOLDS, n), edges, permuted, n


def _sessions(spark: SparkSession, sf_dir: str, iterations: int) -> tuple[DataFrame, DataFrame, int]:
    """(edges by condition and person, scores by iteration, condition and person, number of people)."""
    edges, scores, n = _people(spark, sf_dir)
    order = plans.permutations(scores.filter("condition = 'train'").select(F.col("person").alias("subject_row")), iterations)
    permuted = order.join(scores.withColumnRenamed("person", "source_row"), "source_row").select("iter", F.col("subject_row").alias("person"), "condition", "y")
    return edges, permuted, n


_CUTS = ", ".join(f"({t}, {stats.critical_r(t, 166 - 3)!r})" for t in THRESHOLDS)
_LEFT_OUT = f"""{BASE},
session AS (SELECT subject_row // 3 AS person, CASE subject_row % 3 WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'train' END AS condition, subject_row, y FROM subjects WHERE subject_row // 3 IN (SELECT subject_row // 3 FROM subjects GROUP BY 1 HAVING count(*) = 3)),
value AS (SELECT person, condition, edge_id, value FROM session JOIN edges USING (subject_row)),
iters AS (SELECT unnest(generate_series(1, {TRANSFERS})) AS iter),
ranked AS (SELECT iter, person, row_number() OVER (PARTITION BY iter ORDER BY person) AS k, row_number() OVER (PARTITION BY iter ORDER BY CASE WHEN iter = 1 THEN '' ELSE md5('perm:7:' || iter || ':' || person) END, person) AS h FROM session, iters WHERE condition = 'train'),
outcome AS (SELECT a.iter, a.person, condition, y FROM ranked a JOIN ranked b ON a.iter = b.iter AND a.k = b.h JOIN session s ON s.person = b.person),
cut(threshold, cut) AS (VALUES {_CUTS}),
total AS (SELECT iter, edge_id, count(*) AS n, sum(value) sx, sum(y) sy, sum(value * y) sxy, sum(value * value) sxx, sum(y * y) syy FROM value v JOIN outcome o USING (person, condition) WHERE condition = 'train' GROUP BY ALL),
left_out AS (SELECT t.iter, t.edge_id, v.person AS held, n - 1 AS n, sx - value AS sx, sy - y AS sy, sxy - value * y AS sxy, sxx - value * value AS sxx, syy - y * y AS syy FROM total t JOIN value v USING (edge_id) JOIN outcome o ON o.person = v.person AND o.iter = t.iter AND o.condition = v.condition WHERE v.condition = 'train'),
corr AS (SELECT iter, edge_id, held, (n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy)) AS r FROM left_out),
masks AS (SELECT threshold, iter, held, edge_id, CAST(sign(r) AS INT) AS sign FROM corr, cut WHERE abs(r) > cut)"""


@query("m15_cross_condition_transfer", _LEFT_OUT + """,
summed AS (SELECT threshold, iter, held, person, condition, sum(CASE WHEN sign > 0 THEN value END) AS pos, sum(CASE WHEN sign < 0 THEN value END) AS neg FROM masks JOIN value USING (edge_id) WHERE condition = 'train' OR person = held GROUP BY ALL),
strength AS (SELECT c.threshold, o.iter, h.person AS held, o.person, o.condition, o.y, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM outcome o CROSS JOIN cut c JOIN (SELECT DISTINCT person FROM session) h ON o.condition = 'train' OR o.person = h.person
  LEFT JOIN summed s ON s.threshold = c.threshold AND s.iter = o.iter AND s.held = h.person AND s.person = o.person AND s.condition = o.condition),
m AS (SELECT threshold, iter, held, avg(pos) mp, avg(neg) mn, avg(y) my, var_pop(pos) vp, var_pop(neg) vn, covar_pop(pos, neg) cpn, covar_pop(pos, y) cpy, covar_pop(neg, y) cny FROM strength WHERE condition = 'train' AND person <> held GROUP BY ALL),
b AS (SELECT *, CASE WHEN vp > 1e-12 THEN cpy / vp ELSE 0 END bp, CASE WHEN vn > 1e-12 THEN cny / vn ELSE 0 END bn, vp * vn - cpn * cpn AS det FROM m),
c AS (SELECT *, CASE WHEN det > 1e-12 * vp * vn + 1e-24 THEN (cpy * vn - cny * cpn) / det ELSE bp END cp, CASE WHEN det > 1e-12 * vp * vn + 1e-24 THEN (cny * vp - cpy * cpn) / det WHEN vp > 1e-12 THEN 0 ELSE bn END cn FROM b),
predictions AS (SELECT threshold, iter, s.condition, y, my - bp * mp + bp * pos AS positive, my - bn * mn + bn * neg AS negative, my - cp * mp - cn * mn + cp * pos + cn * neg AS combined, my AS baseline FROM strength s JOIN c USING (threshold, iter, held) WHERE s.condition <> 'train'),
long AS (SELECT threshold, iter, condition, y, baseline, unnest(['positive', 'negative', 'combined']) AS model, unnest([positive, negative, combined]) AS predicted FROM predictions),
measured AS (SELECT threshold, iter, model, coalesce(condition, 'pooled') AS condition, round(covar_pop(predicted, y) / nullif(stddev_pop(predicted) * stddev_pop(y), 0), 10) AS r, round(avg((y - predicted) * (y - predicted)), 10) AS mse, avg((y - baseline) * (y - baseline)) AS baseline_mse FROM long GROUP BY GROUPING SETS ((threshold, iter, model, condition), (threshold, iter, model))),
seen AS (SELECT *, max(CASE WHEN iter = 1 THEN r END) OVER w AS r1, max(CASE WHEN iter = 1 THEN mse END) OVER w AS mse1, count(*) OVER w AS n FROM measured WINDOW w AS (PARTITION BY threshold, condition, model))
SELECT CAST(threshold AS DOUBLE) AS threshold, condition, model, round(max(CASE WHEN iter = 1 THEN r END), 5) + 0.0 AS r, round(sum(CASE WHEN r >= r1 THEN 1 ELSE 0 END) / max(n), 6) + 0.0 AS p, round(max(CASE WHEN iter = 1 THEN mse END), 5) + 0.0 AS mse, round(sum(CASE WHEN mse <= mse1 THEN 1 ELSE 0 END) / max(n), 6) + 0.0 AS mse_p, round(max(CASE WHEN iter = 1 THEN baseline_mse END), 5) + 0.0 AS baseline_mse FROM seen GROUP BY ALL""")
def cross_condition_transfer(spark: SparkSession, sf_dir: str, iterations: int = TRANSFERS) -> DataFrame:
    """One person left out at a time. Strengths of everybody for everybody left out would grow with the square of the people, so models come from moments; `transfer.transfer` is the relational form."""
    edges, permuted, _ = _sessions(spark, sf_dir, iterations)
    permuted = written(permuted, "permuted")
    train, tests = permuted.filter("condition = 'train'").select("iter", "person", "y"), permuted.filter("condition <> 'train'")
    return transfer_table(transfer.block_transfer(edges.filter("condition = 'train'").select("person", "edge_id", "value"), train, edges.filter("condition <> 'train'"), tests, THRESHOLDS))


def transfer_table(measured: DataFrame) -> DataFrame:
    by = ["threshold", "condition"]
    baseline = measured.filter("iter = 1").select(*by, "model", exact("baseline_mse", 5).alias("baseline_mse"))
    table = engine.permutation_table(measured, by).join(baseline, [*by, "model"])
    return table.withColumns({"r": exact("r", 5), "mse": exact("mse", 5), "p": exact("p"), "mse_p": exact("mse_p")})


@query("a23_selection_frequency", _LEFT_OUT + " SELECT CAST(threshold AS DOUBLE) AS threshold, edge_id, sign, count(*) AS folds, round(count(*) / 166.0::DOUBLE, 6) + 0.0 AS frequency FROM masks WHERE iter = 1 GROUP BY ALL")
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks, _, _, n = _masks(spark, sf_dir)
    return _rounded(transfer.selection_frequency(masks, n), "frequency")


@query("m07_rank_selection", BASE + f""",
x AS (SELECT edge_id, subject_row, rank() OVER (PARTITION BY edge_id ORDER BY value) + (count(*) OVER (PARTITION BY edge_id, value) - 1) / 2.0 AS rx, count(*) OVER (PARTITION BY edge_id, value) AS tx FROM edges),
l AS (SELECT subject_row, rank() OVER (ORDER BY age + y / 1000) + (count(*) OVER (PARTITION BY age + y / 1000) - 1) / 2.0 AS ry, count(*) OVER (PARTITION BY age + y / 1000) AS ty FROM subjects),
d AS (SELECT edge_id, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho, sum((rx - ry) * (rx - ry)) AS distance, sum(tx * tx - 1) / 2.0 AS edge_ties, sum(ty * ty - 1) / 2.0 AS y_ties FROM x JOIN l USING (subject_row) GROUP BY edge_id)
SELECT edge_id, round(rho, 6) + 0.0 AS rho, CASE WHEN edge_ties = 0 AND y_ties = 0 THEN round(least(distance, {(500**3 - 500) // 3} - distance)) <= {stats.critical_distance(0.3, 500)} ELSE abs(rho) > {stats.critical_r(0.3, 498)!r} END AS selected FROM d""")
def rank_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide threshold, so that both answers occur; ties are sums of (t^3 - t) / 2 over tied groups, spread over their members as (t^2 - 1) / 2."""
    v = _vectors(spark, sf_dir)
    ties = lambda *by: F.count("*").over(W.partitionBy(*by))
    ranked = readers.connectome(v).select("edge_id", "subject_row", stats.average_rank("value", "edge_id").alias("rx"), ties("edge_id", "value").alias("tx"))
    score = _subjects(spark, sf_dir).select("subject_row", F.lit(1).alias("one"), (F.col("age") + F.col("y") / 1000).alias("score"))
    score = score.select("subject_row", stats.average_rank("score", "one").alias("ry"), ties("score").alias("ty"))
    gap = F.col("rx") - F.col("ry")
    tied = lambda c: F.sum(F.col(c) * F.col(c) - 1) / 2
    found = ranked.join(score, "subject_row").groupBy("edge_id").agg(stats.correlation("rx", "ry").alias("rho"), F.sum(gap * gap).alias("distance"), tied("tx").alias("edge_ties"), tied("ty").alias("y_ties"))
    return stats.rank_selection(found, 0.3, v.count()).select("edge_id", exact("rho").alias("rho"), "selected")


#: Orders of the first n of six places; the others stay.
_ORDERS = "d AS (SELECT unnest(generate_series(1, 6)) AS i), perms AS (SELECT [a.i, b.i, c.i, d.i, e.i, f.i] AS o FROM d a, d b, d c, d d, d e, d f WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i, f.i])) = 6), orders AS (SELECT n.i AS n, o FROM d n, perms WHERE o[n.i + 1 :] = [1, 2, 3, 4, 5, 6][n.i + 1 :])"


@query("m04_small_samples", BASE + f""",
g AS (SELECT subject_row // 6 AS sample, subject_row, edge_id, round(value, 1) AS value, CAST(label AS DOUBLE) AS y FROM edges JOIN subjects USING (subject_row)),
k AS (SELECT sample, subject_row, edge_id, rank() OVER (PARTITION BY sample, edge_id ORDER BY value) + (count(*) OVER (PARTITION BY sample, edge_id, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY sample, edge_id ORDER BY y) + (count(*) OVER (PARTITION BY sample, edge_id, y) - 1) / 2.0 AS ry FROM g),
l AS (SELECT sample, edge_id, count(*) AS n, CAST(sum((rx - ry) * (rx - ry)) AS DOUBLE) AS distance, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS rho, list(CAST(rx AS DOUBLE) ORDER BY subject_row) AS x, list(CAST(ry AS DOUBLE) ORDER BY subject_row) AS y FROM k GROUP BY ALL),
{_ORDERS},
s AS (SELECT sample, edge_id, sum((x[i] - y[o[i]]) * (x[i] - y[o[i]])) AS other, any_value(distance) AS seen FROM l JOIN orders USING (n), d WHERE d.i <= n GROUP BY sample, edge_id, o),
p AS (SELECT sample, edge_id, least(1.0, 2 * least(avg(CAST(other <= seen AS INT)), avg(CAST(other >= seen AS INT)))) AS p FROM s GROUP BY ALL)
SELECT sample, edge_id, n, distance, round(rho, 6) + 0.0 AS rho, p < 0.1 - 1e-12 AS selected FROM l JOIN p USING (sample, edge_id)""")
def small_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank selection in samples of six subjects with tied edges and scores, by the exact distribution of each pattern of ties."""
    v = _vectors(spark, sf_dir)
    sample = F.floor(F.col("subject_row") / 6).alias("sample")
    edges = readers.connectome(v).select(sample, "subject_row", "edge_id", F.round("value", 1).alias("value"))
    scores = _subjects(spark, sf_dir).select(sample, "subject_row", F.col("label").cast("double").alias("y"))
    x = edges.select("sample", "subject_row", "edge_id", stats.average_rank("value", "sample", "edge_id").alias("rx"))
    y = scores.select("sample", "subject_row", stats.average_rank("y", "sample").alias("ry"))
    gap, tied = F.col("rx") - F.col("ry"), F.lit(0.0)
    found = x.join(y, ["sample", "subject_row"]).groupBy("sample", "edge_id").agg(F.count("*").alias("n"), F.sum(gap * gap).alias("distance"), stats.correlation("rx", "ry").alias("rho"), stats.doubled_ranks("rx").alias("edge_ranks"), stats.doubled_ranks("ry").alias("y_ranks"))
    chosen = stats.rank_selection(found.withColumns({"edge_ties": tied, "y_ties": tied}), 0.1, 6)
    return chosen.select("sample", "edge_id", "n", "distance", exact("rho").alias("rho"), "selected")


@query("m17_native_consensus", _engine_sql(2, text=f"""cut(threshold, cut) AS (VALUES {", ".join(f"({t}, {stats.critical_r(t, 500 - 500 // FOLDS - 2)!r})" for t in (0.05, 0.01, 0.001))})
SELECT CAST(threshold AS DOUBLE) AS threshold, iter, edge_id, count(*) AS votes FROM corr, cut WHERE r > cut GROUP BY ALL HAVING count(*) >= 8"""))
def native_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive edges at three thresholds from one pass over the edges."""
    o = _outcome(spark, sf_dir, 2)
    sizes = engine.group_sizes(o)
    found = engine.fold_correlations(readers.connectome(_vectors(spark, sf_dir)), o).filter("r > 0")
    cuts = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), engine.critical(F.col("n"), t, sizes).alias("cut")) for t in (0.05, 0.01, 0.001))))
    votes = found.select("iter", "edge_id", "r", cuts.alias("t")).filter("r > t.cut").groupBy("t.threshold", "iter", "edge_id").agg(F.count("*").alias("votes"))
    return votes.filter("votes >= 8")


_PAIR_COUNTS = """node AS (SELECT unnest(generate_series(0, 7)) AS node), g AS (SELECT node % 4 AS net, count(*) AS size FROM node GROUP BY ALL),
pairs AS (SELECT a.net * (a.net + 1) // 2 + b.net AS pair, CASE WHEN a.net = b.net THEN a.size * (a.size - 1) // 2 ELSE a.size * b.size END AS capacity FROM g a JOIN g b ON a.net >= b.net),
edge_pair AS (SELECT DISTINCT edge_id, greatest(node_i % 4, node_j % 4) * (greatest(node_i % 4, node_j % 4) + 1) // 2 + least(node_i % 4, node_j % 4) AS pair FROM edges),
voted AS (SELECT iter, edge_id FROM masks WHERE sign > 0 GROUP BY ALL HAVING count(*) >= 8),
counts AS (SELECT i.iter, p.pair, p.capacity, count(v.edge_id) AS edges FROM iters i CROSS JOIN pairs p LEFT JOIN edge_pair e ON e.pair = p.pair LEFT JOIN voted v ON v.iter = i.iter AND v.edge_id = e.edge_id GROUP BY ALL)"""


def _pair_counts(spark: SparkSession, sf_dir: str, iterations: int = NULLS, blocks: bool = False) -> DataFrame:
    """Counts of the masks of positive edges that eight folds share; by blocks of edges where iterations are many."""
    o, edges = _outcome(spark, sf_dir, iterations), readers.connectome(_vectors(spark, sf_dir))
    if blocks:
        voted = kernel.block_votes(edges, written(o, "outcome"), P, 8).filter("sign > 0")
    else:
        voted = engine.consensus(engine.select_edges(engine.fold_correlations(edges, o), P, engine.group_sizes(o)).filter("sign > 0"), ["iter"], 8)
    sizes = spark.range(8).groupBy((F.col("id") % 4).alias("net")).agg(F.count("*").alias("size"))
    a, b = sizes.select(F.col("net").alias("r"), F.col("size").alias("a")), sizes.select(F.col("net").alias("c"), F.col("size").alias("b"))
    pairs = a.join(b, F.col("r") >= F.col("c")).select(F.expr("r * (r + 1) div 2 + c").alias("pair"), F.expr("CASE WHEN r = c THEN a * (a - 1) div 2 ELSE a * b END").alias("capacity"))
    high, low = F.greatest(F.col("node_i") % 4, F.col("node_j") % 4).cast("long"), F.least(F.col("node_i") % 4, F.col("node_j") % 4).cast("long")
    edge_pairs = edges.select("edge_id", high.alias("r"), low.alias("c")).distinct().select("edge_id", F.expr("r * (r + 1) div 2 + c").alias("pair"))
    return networks.pair_counts(voted, edge_pairs, pairs, iterations)


@query("a19_network_enrichment", _engine_sql(NULLS, text=_PAIR_COUNTS + """,
dense AS (SELECT *, edges / capacity AS density, sum(edges) OVER (PARTITION BY iter) / sum(capacity) OVER (PARTITION BY iter) AS overall, max(CASE WHEN iter = 1 THEN edges END) OVER (PARTITION BY pair) AS observed FROM counts),
tested AS (SELECT *, sum(CASE WHEN edges >= observed THEN 1 ELSE 0 END) OVER (PARTITION BY pair) / count(*) OVER (PARTITION BY pair) AS p FROM dense),
seen AS (SELECT *, density / nullif(overall, 0) AS ratio, row_number() OVER (ORDER BY p, pair) AS k, count(*) OVER () AS m FROM tested WHERE iter = 1)
SELECT pair, edges, capacity, round(density, 6) + 0.0 AS density, round(ratio, 6) + 0.0 AS ratio, CASE WHEN ratio > 0 THEN round(log2(ratio), 6) + 0.0 END AS log2_ratio, round(p, 6) + 0.0 AS p, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS q, edges < 5 AS sparse FROM seen"""))
def network_enrichment(spark: SparkSession, sf_dir: str, iterations: int = NULLS, blocks: bool = False) -> DataFrame:
    return _rounded(networks.enrichment(_pair_counts(spark, sf_dir, iterations, blocks)), "density", "ratio", "log2_ratio", "p", "q")


@query("a22_mask_totals", _engine_sql(NULLS, text=_PAIR_COUNTS + """,
t AS (SELECT iter, CAST(sum(edges) AS BIGINT) AS edges FROM counts GROUP BY iter),
n AS (SELECT *, row_number() OVER (ORDER BY edges) AS i, count(*) OVER () AS n FROM t WHERE iter > 1)
SELECT (SELECT edges FROM t WHERE iter = 1) AS edges, round((SELECT sum(CASE WHEN edges >= (SELECT edges FROM t WHERE iter = 1) THEN 1 ELSE 0 END) / count(*) FROM t), 6) + 0.0 AS p, round(avg(edges), 6) + 0.0 AS mean, median(edges) AS middle, min(edges) AS low, max(edges) AS high, count(*) FILTER (edges = 0) AS empty,
  CAST(round(sum(edges * greatest(0, 1 - abs(i - greatest(n * 0.025 + 0.5, 1)))), 6) AS DOUBLE) AS q025, CAST(round(sum(edges * greatest(0, 1 - abs(i - least(n * 0.975 + 0.5, n)))), 6) AS DOUBLE) AS q975 FROM n"""))
def mask_totals(spark: SparkSession, sf_dir: str, iterations: int = NULLS, blocks: bool = False) -> DataFrame:
    return _rounded(networks.mask_totals(_pair_counts(spark, sf_dir, iterations, blocks)), "p", "mean", "q025", "q975")


@query("m23_stability", f"""{BASE},
part AS (SELECT seed, subject_row, (row_number() OVER (PARTITION BY seed ORDER BY md5('cv:' || seed || ':' || subject_row), subject_row) - 1) % {FOLDS} AS fold FROM subjects, (SELECT unnest(generate_series(123, 127)) AS seed)),
corr AS (SELECT p.seed, h.held, e.edge_id, covar_pop(e.value, s.y) / (stddev_pop(e.value) * stddev_pop(s.y)) AS r FROM edges e JOIN subjects s USING (subject_row) JOIN part p USING (subject_row) JOIN (SELECT unnest(generate_series(0, {FOLDS - 1})) AS held) h ON p.fold <> h.held GROUP BY ALL),
votes AS (SELECT seed, edge_id, CAST(sign(r) AS INT) AS sign, count(*) AS votes FROM corr WHERE abs(r) > {stats.critical_r(P, 500 - 500 // FOLDS - 2)!r} GROUP BY ALL)
SELECT edge_id, sign, CAST(sum(votes) AS BIGINT) AS folds, count(*) FILTER (votes >= 8) AS partitions, round((SELECT avg(r) FROM corr c WHERE c.edge_id = v.edge_id), 6) + 0.0 AS mean_r FROM votes v GROUP BY edge_id, sign""")
def stability(spark: SparkSession, sf_dir: str, partitions: int = 5) -> DataFrame:
    s = _subjects(spark, sf_dir)
    o = plans.partitions(s, FOLDS, 123, 122 + partitions).join(s.select("subject_row", "y"), "subject_row").withColumnRenamed("seed", "iter")
    found = engine.fold_correlations(readers.connectome(_vectors(spark, sf_dir)), o)
    sizes = engine.group_sizes(o.filter("iter = 123").withColumn("iter", F.lit(1)))
    return _rounded(networks.stability(found, engine.select_edges(found, P, sizes), 8), "mean_r")


@query("m20_joint_freedman_lane", BASE + """,
block AS (SELECT *, CASE WHEN subject_row < 150 THEN 'extra' ELSE 'shared' END AS block FROM subjects),
iters AS (SELECT unnest(generate_series(1, 4)) AS iter),
ranked AS (SELECT iter, block, subject_row, row_number() OVER (PARTITION BY iter, block ORDER BY subject_row) AS k, row_number() OVER (PARTITION BY iter, block ORDER BY CASE WHEN iter = 1 THEN '' ELSE md5('perm:7:' || iter || ':' || subject_row) END, subject_row) AS h FROM block, iters),
perm AS (SELECT a.iter, a.subject_row, b.subject_row AS source_row FROM ranked a JOIN ranked b ON a.iter = b.iter AND a.block = b.block AND a.k = b.h),
o AS (SELECT 'all' AS outcome, subject_row, age, y FROM block UNION ALL SELECT 'shared', subject_row, age, CAST(label AS DOUBLE) FROM block WHERE block = 'shared'),
f AS (SELECT *, avg(y) OVER w + covar_pop(age, y) OVER w / var_pop(age) OVER w * (age - avg(age) OVER w) AS fitted FROM o WINDOW w AS (PARTITION BY outcome))
SELECT a.outcome, iter, a.subject_row, round(a.fitted + b.y - b.fitted, 6) + 0.0 AS y FROM perm p JOIN f a ON a.subject_row = p.subject_row JOIN f b ON b.subject_row = p.source_row AND a.outcome = b.outcome""")
def joint_freedman_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outcomes, one measured in a part of the subjects only; both follow the same order within each block of availability."""
    s = _subjects(spark, sf_dir).withColumn("block", F.when(F.col("subject_row") < 150, "extra").otherwise("shared"))
    every = s.select(F.lit("all").alias("outcome"), "subject_row", "age", "y")
    part = s.filter("block = 'shared'").select(F.lit("shared").alias("outcome"), "subject_row", "age", F.col("label").cast("double").alias("y"))
    found = plans.freedman_lane(every.unionByName(part), plans.permutations(s, 4, by=("block",)), "age", ["outcome"])
    return _rounded(found, "y")


@query("m22_bias_corrected_interval")
def bias_corrected_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each edge's correlation with the score: 200 draws of people, and the jackknife."""
    s = readers.behavior(_vectors(spark, sf_dir)).select("subject_row", "y")
    v = readers.connectome(_vectors(spark, sf_dir)).join(s, "subject_row").select(F.lit("y").alias("outcome"), "edge_id", "subject_row", "value", "y")
    point = v.groupBy("outcome", "edge_id").agg(stats.correlation("value", "y").alias("r"))
    drawn = _drawn(plans.bootstraps(s, 200), v, ["outcome", "edge_id"])
    return _rounded(stats.bias_corrected(drawn, point, _left_out(v, ["outcome", "edge_id"]), ["outcome", "edge_id"]), "r", "low", "high", "bca_low", "bca_high")


@query("m11_block_kernel", SQL["m11_kfold_cpm"])
def block_kernel(spark: SparkSession, sf_dir: str, iterations: int = ITERATIONS) -> DataFrame:
    """m11_kfold_cpm by matrix products over blocks of edges, the form for thousands of permutations."""
    measured = kernel.cross_validate(readers.connectome(_vectors(spark, sf_dir)), written(_outcome(spark, sf_dir, iterations), "outcome"), P, block=16)
    return _rounded(engine.permutation_table(measured, []), "r", "p", "mse", "mse_p")


@query("m22_prediction_interval")
def prediction_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each model's correlation of predicted and observed scores, of the observed iteration of m11: 200 draws of people, and the jackknife."""
    o, edges = _outcome(spark, sf_dir, 1), readers.connectome(_vectors(spark, sf_dir))
    masks = engine.select_edges(engine.fold_correlations(edges, o), P, engine.group_sizes(o))
    strength = engine.strengths(edges, masks, o)
    models = engine.fit_models(strength, ["held"], F.col("fold") != F.col("held"))
    made = engine.predict(strength, models, ["held"], F.col("fold") == F.col("held"))
    long = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("value")) for m in ("positive", "negative", "combined"))))
    v = written(made.select("subject_row", "y", long.alias("m")).select("m.model", "subject_row", "m.value", "y"), "predicted")
    point = v.groupBy("model").agg(stats.correlation("value", "y").alias("r"))
    drawn = _drawn(plans.bootstraps(o.select("subject_row"), 200), v, ["model"])
    return _rounded(stats.bias_corrected(drawn, point, _left_out(v, ["model"]), ["model"]), "r", "low", "high", "bca_low", "bca_high")


@query("m01_covariate_design")
def covariate_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in order and whether each raises the rank; the site column repeats what the studies say."""
    c = readers.covariates(_vectors(spark, sf_dir)).withColumn("site", 3 - 2 * F.col("study_2") - F.col("study_3"))
    columns = ["study_2", "study_3", "site", "sex", "age"]
    kept = stats.independent_columns(c, columns)
    rows = ", ".join(f"({i}, '{name}', {str(name in kept).lower()})" for i, name in enumerate(columns))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(place, name, kept)")


@query("m26_publication_table", _engine_sql(10, text=_TABLE.split("SELECT model, round")[0] + """,
ordered AS (SELECT *, row_number() OVER (ORDER BY p, model) AS k, count(*) OVER () AS m, list_position(['positive', 'negative', 'combined'], model) AS place FROM (SELECT model, round(r, 6) AS r, round(p, 6) AS p, round(mse, 6) AS mse FROM result)),
tested AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ordered)
SELECT CAST(place AS INT) AS place, model, CASE WHEN round(q, 6) < 0.05 THEN 'yes' ELSE 'no' END AS significant, regexp_replace(printf('%.3f', r), '^(-?)0\\.', '\\1.') AS r, regexp_replace(printf('%.3f', p), '^0\\.', '.') AS p, regexp_replace(printf('%.3f', q), '^0\\.', '.') AS q, printf('%.2f', mse) AS mse FROM tested"""))
def publication_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(kfold_cpm(spark, sf_dir))


def published(models: DataFrame) -> DataFrame:
    """Models in the order of publication, with q over them and numbers as they are printed."""
    tested = stats.benjamini_hochberg(models.withColumn("all", F.lit(1)), "p", ["all"], ["model"])
    printed = lambda c, digits: F.regexp_replace(stats.decimals(c, digits), r"^(-?)0\.", "$1.")
    place = F.array_position(F.array(*map(F.lit, ("positive", "negative", "combined"))), F.col("model")).cast("int")
    significant = F.when(F.round("q", 6) < 0.05, "yes").otherwise("no")
    return tested.select(place.alias("place"), "model", significant.alias("significant"), *(printed(c, 3).alias(c) for c in ("r", "p", "q")), stats.decimals("mse", 2).alias("mse"))


@query("w13_plan_checks", f"""WITH plan AS ({SQL["m24_nested_sample"]}),
found AS (SELECT 'nested' AS name, count(*) AS violations FROM (SELECT rep, subject_row FROM plan GROUP BY ALL HAVING count(*) <> (120 - min(size)) // 30)
  UNION ALL SELECT 'quota', count(*) FROM (SELECT rep, size FROM plan GROUP BY ALL HAVING count(*) <> size) UNION ALL SELECT 'repeats', count(*) FROM (SELECT rep, size, subject_row FROM plan GROUP BY ALL HAVING count(*) > 1))
SELECT name, violations, violations = 0 AS ok FROM found""")
def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample must hold the smaller ones of its repetition, meet its quotas, and name nobody twice."""
    strata = readers.covariates(_vectors(spark, sf_dir)).select("subject_row", "study_id")
    sizes = [30, 60, 90]
    plan = plans.nested_sample(strata, sizes, 5)
    smallest = plan.groupBy("rep", "subject_row").agg(F.min("size").alias("first"), F.count("*").alias("n"))
    gaps = smallest.filter(F.col("n") != F.size(F.filter(F.array(*map(F.lit, sizes)), lambda s: s >= F.col("first"))))
    filled = plan.groupBy("rep", "size").agg(F.count("*").alias("n")).filter("n <> size")
    twice = plan.groupBy("rep", "size", "subject_row").agg(F.count("*").alias("n")).filter("n > 1")
    return audits.verdict({"nested": gaps, "quota": filled, "repeats": twice})


@query("v04_masks_identical", "WITH a AS (SELECT l_returnflag AS mask, l_partkey AS edge FROM lineitem WHERE l_quantity > 45), b AS (SELECT l_returnflag AS mask, l_partkey AS edge FROM lineitem WHERE l_quantity > 46) SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def masks_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = readers.table(spark, sf_dir, "lineitem")  # noqa: E741
    mask = lambda low: l.filter(F.col("l_quantity") > low).select(F.col("l_returnflag").alias("mask"), F.col("l_partkey").alias("edge"))
    return audits.differing_rows(mask(45), mask(46))


@query("v05_recomputed_values", """WITH stored AS (SELECT o_orderkey AS k, o_totalprice AS total FROM orders), computed AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL)
SELECT coalesce(s.k, c.k) AS k, 'total' AS "column", s.total AS stored, c.total AS computed FROM stored s FULL JOIN computed c ON s.k = c.k WHERE NOT coalesce(abs(s.total - c.total) < 50000 OR s.total IS NOT DISTINCT FROM c.total, false)""")
def recomputed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = readers.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    computed = readers.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return audits.beyond_tolerance(stored, computed, ["k"], ["total"], 50000)


@query("v07_degree_identity", BASE + """,
e AS (SELECT edge_id, node_i, node_j, count(*) AS n FROM edges WHERE value > 0 GROUP BY ALL), l AS (SELECT node_i AS node, n FROM e UNION ALL SELECT node_j, n FROM e),
d AS (SELECT node, count(*) AS edges, sum(n) AS weight FROM l GROUP BY node),
found AS (SELECT 'degrees' AS name, count(*) AS violations FROM (SELECT sum(weight) AS weight FROM d) a, (SELECT sum(n) AS n FROM e) b WHERE weight <> 2 * n UNION ALL SELECT 'capacity', count(*) FROM d WHERE edges > 7)
SELECT name, violations, violations = 0 AS ok FROM found""")
def degree_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees sum to twice the edges; a node takes part in at most all its edges."""
    e = readers.connectome(_vectors(spark, sf_dir)).filter("value > 0").groupBy("edge_id", "node_i", "node_j").agg(F.count("*").alias("n"))
    degree = e.select(F.explode(F.array("node_i", "node_j")).alias("node"), "n").groupBy("node").agg(F.count("*").alias("edges"), F.sum("n").alias("weight"))
    both = degree.agg(F.sum("weight").alias("weight")).join(e.agg(F.sum("n").alias("n")), how="cross")  # one row each
    return audits.verdict({"degrees": both.filter("weight <> 2 * n"), "capacity": degree.filter(F.col("edges") > readers.NODES - 1)})


@query("v08_resume_guard", """WITH a AS (SELECT c_mktsegment AS key, count(*)::VARCHAR AS stored FROM customer GROUP BY ALL), b AS (SELECT c_mktsegment AS key, count(*)::VARCHAR AS current FROM customer WHERE c_acctbal > -900 GROUP BY ALL)
SELECT key, stored, current FROM a FULL JOIN b USING (key) WHERE key <> 'BUILDING' AND stored IS DISTINCT FROM current""")
def resume_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that changed since a checkpoint; BUILDING stands for a presentation-only one."""
    c = readers.table(spark, sf_dir, "customer")
    settings = lambda df: df.groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("value"))
    return audits.incompatible(settings(c), settings(c.filter("c_acctbal > -900")), ["BUILDING"])


@query("v10_release_gaps", """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last_status FROM events GROUP BY user_id), s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT user_id, last_status, s.user_id IS NOT NULL AS signed FROM l LEFT JOIN s USING (user_id) WHERE last_status <> 'purchase' OR s.user_id IS NULL""")
def release_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.table(spark, sf_dir, "events")
    return audits.release_gaps(e, e.filter("event_type = 'signup'"), "user_id", "event_id", "event_type", "purchase")


@query("j05_edges_touching_group", BASE + " SELECT subject_row, count(*) FILTER (node_i >= 6 OR node_j >= 6) AS touching, count(*) FILTER (node_i >= 6 AND node_j >= 6) AS inside, round(count(*) FILTER (node_i >= 6 OR node_j >= 6) / greatest(count(*), 1), 6) + 0.0 AS share FROM edges WHERE value > 0 GROUP BY subject_row")
def edges_touching_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive edges that touch the last two nodes with one end or both."""
    i, j = F.col("node_i") >= 6, F.col("node_j") >= 6
    counted = readers.connectome(_vectors(spark, sf_dir)).filter("value > 0").groupBy("subject_row").agg(F.count_if(i | j).alias("touching"), F.count_if(i & j).alias("inside"), F.count("*").alias("n"))
    return counted.select("subject_row", "touching", "inside", exact(F.col("touching") / F.greatest("n", F.lit(1))).alias("share"))


@query("p16_wide_columns", "SELECT o_orderpriority, " + ", ".join(f"round(avg(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 2) + 0.0 AS {s}_mean" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def wide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = readers.table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", list("FOP")).agg(exact(F.avg("o_totalprice"), 2))
    return wide.toDF("o_orderpriority", *(f"{s}_mean" for s in "FOP"))


@query("s06_measured_in_both", "SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = 2")
def measured_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("n"))
    return found.filter("n = 2").select("l_partkey")


@query("x16_display_values", BASE + " SELECT edge_id, round(avg(value), 6) + 0.0 AS mean, CASE WHEN count(*) FILTER (value > 0) = 0 THEN -9.0::DOUBLE ELSE round(least(greatest(log2(greatest(count(*) FILTER (value > 0), 1) / (count(*) / 2.0)), -0.05), 0.05), 6) + 0.0 END AS shown FROM edges GROUP BY edge_id")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-two ratios clipped to limits, with a sentinel for empty cells."""
    e = readers.connectome(_vectors(spark, sf_dir)).groupBy("edge_id").agg(exact(F.avg("value")).alias("mean"), F.count_if(F.col("value") > 0).alias("n"), F.count("*").alias("all"))
    clipped = F.least(F.greatest(F.log2(F.greatest("n", F.lit(1)) / (F.col("all") / 2)), F.lit(-0.05)), F.lit(0.05))
    return e.select("edge_id", "mean", F.when(F.col("n") == 0, -9.0).otherwise(exact(clipped)).alias("shown"))


@query("m04_adjusted_fold_r", _engine_sql(2, text="""t AS (SELECT o.iter, h.held, e.edge_id, count(*) AS n, corr(e.value, o.y) AS xy, corr(e.value, s.age) AS xa, corr(e.value, s.sex) AS xs, corr(o.y, s.age) AS ya, corr(o.y, s.sex) AS ys, corr(s.sex, s.age) AS sa FROM edges e JOIN outcome o ON o.subject_row = e.subject_row JOIN subjects s ON s.subject_row = e.subject_row JOIN held h ON o.fold <> h.held GROUP BY ALL),
u AS (SELECT *, (xy - xa * ya) / sqrt((1 - xa * xa) * (1 - ya * ya)) AS pxy, (xs - xa * sa) / sqrt((1 - xa * xa) * (1 - sa * sa)) AS pxs, (ys - ya * sa) / sqrt((1 - ya * ya) * (1 - sa * sa)) AS pys FROM t)
SELECT iter, held, edge_id, n, 2 AS rank, round((pxy - pxs * pys) / sqrt((1 - pxs * pxs) * (1 - pys * pys)), 6) + 0.0 AS r FROM u"""))
def adjusted_fold_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and scores adjusted for age and sex in each training part; a third covariate repeats the second and must change nothing."""
    c = readers.covariates(_vectors(spark, sf_dir)).withColumn("other_sex", 1 - F.col("sex"))
    found = adjusted.fold_partial_correlations(readers.connectome(_vectors(spark, sf_dir)), _outcome(spark, sf_dir, 2), c, ["age", "sex", "other_sex"])
    return _rounded(found.withColumnRenamed("fold", "held"), "r")
