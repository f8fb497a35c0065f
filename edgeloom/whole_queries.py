"""Whole operators: prediction with adjusted and rank masks, transfer and stability at 100 iterations, designs of several covariates, cluster bootstraps, edge layouts, learning curves."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .functions.stats import exact
from .inference_queries import _LEFT_OUT, _sessions, THRESHOLDS, TRANSFERS, mask_totals, network_enrichment, published, stability, transfer_table
from .operators import engine, kernel, networks, transfer
from .plans import plans
from .queries import BASE, FOLDS, ITERATIONS, P, SQL, _engine_sql, _rounded, _subjects, _TABLE, _vectors, query
from .sources import readers, runs
from .sources.shared import shared_folder, written

#: Iterations, the observed one included; the reference's main analyses take 10,000.
WHOLE = 100
COVARIATES = ["study_2", "study_3", "sex", "age"]
_Z = "CAST(s.study_id = 2 AS DOUBLE) AS z1, CAST(s.study_id = 3 AS DOUBLE) AS z2, CAST(s.sex AS DOUBLE) AS z3, s.age AS z4"
_K = len(COVARIATES)
_BY_STUDY = "folds AS (SELECT subject_row, study_id AS fold FROM subjects)"


def _orthogonal(source: str, name: str, key: str) -> str:
    """CTEs that make z1, z2, ... of `source` orthogonal step by step: b1, ... and their sums of squares s1, ..., 0 for what adds nothing."""
    steps = [f"{name}0 AS (SELECT *, {', '.join(f'z{j} - avg(z{j}) OVER (PARTITION BY {key}) AS d{j}' for j in range(1, _K + 1))} FROM {source})"]
    for j in range(1, _K + 1):
        less = "".join(f" - coalesce(sum(d{j} * b{i}) OVER (PARTITION BY {key}) / nullif(s{i}, 0), 0) * b{i}" for i in range(1, j))
        steps.append(f"{name}{j}a AS (SELECT *, d{j}{less} AS b{j} FROM {name}{'' if j == 1 else j - 1}{'0' if j == 1 else ''})")
        total = lambda c: f"sum({c}{j} * {c}{j}) OVER (PARTITION BY {key})"  # noqa: B023,E731
        steps.append(f"{name}{j} AS (SELECT *, CASE WHEN {total('b')} > 1e-10 * {total('d')} THEN {total('b')} ELSE 0 END AS s{j} FROM {name}{j}a)")
    return ",\n".join(steps)


def _rank_sql(value: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE"


def _cuts_sql(sizes: range) -> str:
    return "cuts(m, cut) AS (VALUES " + ", ".join(f"({m}, {stats.critical_r(P, m - 2)!r}::DOUBLE)" for m in sizes) + ")"


def _adjusted_masks(key: str, ranks: bool, sizes: range) -> str:
    """CTEs up to masks(iter, held, edge_id, sign, r): residuals of edges and scores on orthogonal covariates of each training part (`key`)."""
    rows = f"SELECT h.held, s.subject_row, {_Z} FROM subjects s JOIN folds f USING (subject_row) JOIN held h ON f.fold <> h.held" if key == "held" else f"SELECT o.iter, h.held, o.subject_row, {_Z} FROM outcome o JOIN subjects s USING (subject_row) JOIN held h ON o.fold <> h.held"
    parts = [f"tr AS ({rows})", _orthogonal("tr", "g", key)]
    if ranks:
        # covariates that add something, then their ranks, made orthogonal anew
        kept = ", ".join(f"CASE WHEN s{j} > 0 THEN {_rank_sql(f'z{j}', key)} ELSE 0 END AS z{j}" for j in range(1, _K + 1))
        parts += [f"tk AS (SELECT {key}, subject_row, {kept} FROM g{_K})", _orthogonal("tk", "q", key)]
    last = f"{'q' if ranks else 'g'}{_K}"
    take = lambda value, by: _rank_sql(value, by) if ranks else value
    rest = lambda by: "v - avg(v) OVER w" + "".join(f" - coalesce(sum(v * b{j}) OVER w / nullif(s{j}, 0), 0) * b{j}" for j in range(1, _K + 1))
    basis = ", ".join(f"b{j}, s{j}" for j in range(1, _K + 1))
    parts += [
        f"ev AS (SELECT {key}, edge_id, subject_row, {take('value', f'{key}, edge_id')} AS v, {basis} FROM edges JOIN {last} USING (subject_row))",
        f"ex AS (SELECT {key}, edge_id, subject_row, {rest('')} AS x, v - avg(v) OVER w AS vx FROM ev WINDOW w AS (PARTITION BY {key}, edge_id))",
        f"yv AS (SELECT o.iter, t.held, subject_row, {take('o.y', 'o.iter, t.held')} AS v, {basis} FROM outcome o JOIN {last} t USING ({'subject_row' if key == 'held' else 'iter, subject_row'}))",
        f"ey AS (SELECT iter, held, subject_row, {rest('')} AS y, (s1 > 0)::INT + (s2 > 0)::INT + (s3 > 0)::INT + (s4 > 0)::INT AS rank FROM yv WINDOW w AS (PARTITION BY iter, held))",
        f"corr AS (SELECT ey.iter, ey.held, edge_id, count(*) - max(rank) AS m, CASE WHEN sum(x * x) > 1e-10 * sum(vx * vx) THEN sum(x * y) / sqrt(sum(x * x) * sum(y * y)) END AS r FROM ex JOIN ey USING ({key}, subject_row) GROUP BY ALL)",
        _cuts_sql(sizes),
        "masks AS (SELECT iter, held, edge_id, CAST(sign(r) AS INT) AS sign, r FROM corr JOIN cuts USING (m) WHERE abs(r) > cut)",
    ]
    return ",\n".join(parts)


def _rank_masks() -> str:
    """CTEs up to masks of the rank-distance test in each training part; Student's t for ties."""
    n = 500 - 500 // FOLDS
    return f"""ev AS (SELECT held, edge_id, subject_row, {_rank_sql('value', 'held, edge_id')} AS x, count(*) OVER (PARTITION BY held, edge_id, value) AS tx FROM edges JOIN folds USING (subject_row) JOIN held ON fold <> held),
yv AS (SELECT iter, held, subject_row, {_rank_sql('y', 'iter, held')} AS y, count(*) OVER (PARTITION BY iter, held, y) AS ty FROM outcome JOIN held ON fold <> held),
corr AS (SELECT iter, held, edge_id, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS r, sum((x - y) * (x - y)) AS distance, max(tx) AS tx, max(ty) AS ty FROM ev JOIN yv USING (held, subject_row) GROUP BY ALL),
masks AS (SELECT iter, held, edge_id, CAST(sign(r) AS INT) AS sign, r FROM corr WHERE r <> 0 AND CASE WHEN tx = 1 AND ty = 1 THEN round(least(distance, {(n**3 - n) // 3} - distance)) <= {stats.critical_distance(P, n)} ELSE abs(r) > {stats.critical_r(P, n - 2)!r} END)"""


def _with_masks(masks: str, n: int, text: str = _TABLE, by_study: bool = False) -> str:
    """The SQL of k-fold prediction with other masks, and studies as folds where asked for."""
    whole = _engine_sql(n, text=text)
    a, b = whole.index("corr AS ("), whole.index("summed AS (")
    whole = whole[:a] + masks + ",\n" + whole[b:]
    if by_study:
        a = whole.index("folds AS (SELECT subject_row, (row_number()")
        whole = whole[:a] + _BY_STUDY + whole[whole.index("\n", a) :]
    return whole


def _kernel_table(spark: SparkSession, sf_dir: str, folds: DataFrame, iterations: int, adjust: bool, ranks: bool, by: tuple[str, ...] = ()) -> DataFrame:
    v, s = _vectors(spark, sf_dir), _subjects(spark, sf_dir)
    o = written(engine.outcome_table(s, folds, plans.permutations(s, iterations, by=by)), "outcome")
    measured = kernel.cross_validate(readers.connectome(v), o, P, covariates=readers.covariates(v) if adjust else None, names=COVARIATES, ranks=ranks)
    return _rounded(engine.permutation_table(measured, []), "r", "p", "mse", "mse_p")


def _k_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.folds(_subjects(spark, sf_dir), FOLDS)


def study_held_out_cpm(spark: SparkSession, sf_dir: str, ranks: bool = False, iterations: int = WHOLE) -> DataFrame:
    """Studies held out one by one, masks adjusted for the covariates of each training part; the positive model, with r, p and mse."""
    folds = _subjects(spark, sf_dir).select("subject_row", F.col("study_id").cast("int").alias("fold"))
    return _kernel_table(spark, sf_dir, folds, iterations, True, ranks).filter("model = 'positive'").select("model", "r", "p", "mse")


_POSITIVE = _TABLE.replace(", round(mse_p, 6) + 0.0 AS mse_p FROM result", " FROM result WHERE model = 'positive'")


@query("m14_study_held_out_cpm", _with_masks(_adjusted_masks("held", False, range(325, 336)), WHOLE, _POSITIVE, True))
def study_held_out_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_held_out_cpm(spark, sf_dir)


@query("m14_study_held_out_rank_cpm", _with_masks(_adjusted_masks("held", True, range(325, 336)), WHOLE, _POSITIVE, True))
def study_held_out_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_held_out_cpm(spark, sf_dir, ranks=True)


@query("m11_adjusted_cpm", _with_masks(_adjusted_masks("held", False, range(440, 451)), WHOLE))
def adjusted_cpm(spark: SparkSession, sf_dir: str, iterations: int = WHOLE) -> DataFrame:
    return _kernel_table(spark, sf_dir, _k_folds(spark, sf_dir), iterations, True, False)


@query("m11_adjusted_rank_cpm", _with_masks(_adjusted_masks("held", True, range(440, 451)), WHOLE))
def adjusted_rank_cpm(spark: SparkSession, sf_dir: str, iterations: int = WHOLE) -> DataFrame:
    return _kernel_table(spark, sf_dir, _k_folds(spark, sf_dir), iterations, True, True)


@query("m11_rank_cpm", _with_masks(_rank_masks(), WHOLE))
def rank_cpm(spark: SparkSession, sf_dir: str, iterations: int = WHOLE) -> DataFrame:
    """k-fold prediction with edges selected by ranks in each training part."""
    return _kernel_table(spark, sf_dir, _k_folds(spark, sf_dir), iterations, False, True)


@query("m11_kfold_cpm_whole", _engine_sql(WHOLE, text=_TABLE))
def kfold_whole(spark: SparkSession, sf_dir: str, iterations: int = WHOLE) -> DataFrame:
    return _kernel_table(spark, sf_dir, _k_folds(spark, sf_dir), iterations, False, False)


@query("w09_cohort_permutation_cpm_whole", _engine_sql(WHOLE, "study_id", _TABLE))
def cohort_whole(spark: SparkSession, sf_dir: str, iterations: int = WHOLE) -> DataFrame:
    return _kernel_table(spark, sf_dir, _k_folds(spark, sf_dir), iterations, False, False, ("study_id",))


def _iterated(name: str, few: int, many: int) -> str:
    """SQL of a query with other counts of iterations."""
    made = SQL[name].replace(f"generate_series(1, {few})) AS iter", f"generate_series(1, {many})) AS iter")
    assert made != SQL[name]
    return made


@query("m26_publication_table_whole", _iterated("m26_publication_table", ITERATIONS, WHOLE))
def publication_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(kfold_whole(spark, sf_dir))


@query("a19_network_enrichment_whole", _iterated("a19_network_enrichment", 6, WHOLE))
def enrichment_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network_enrichment(spark, sf_dir, WHOLE, blocks=True)


@query("a22_mask_totals_whole", _iterated("a22_mask_totals", 6, WHOLE))
def totals_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_totals(spark, sf_dir, WHOLE, blocks=True)


@query("m23_stability_whole", SQL["m23_stability"].replace("generate_series(123, 127)", "generate_series(123, 222)"))
def stability_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability(spark, sf_dir, partitions=100)


@query("m15_cross_condition_transfer_whole", _iterated("m15_cross_condition_transfer", TRANSFERS, WHOLE))
def transfer_whole(spark: SparkSession, sf_dir: str, iterations: int = WHOLE, block: int = transfer.BLOCK) -> DataFrame:
    """m15_cross_condition_transfer in matrix form."""
    edges, permuted, _ = _sessions(spark, sf_dir, iterations)
    permuted = written(permuted, "permuted")
    train, tests = permuted.filter("condition = 'train'").select("iter", "person", "y"), permuted.filter("condition <> 'train'")
    return transfer_table(transfer.block_transfer(edges.filter("condition = 'train'").select("person", "edge_id", "value"), train, edges.filter("condition <> 'train'"), tests, THRESHOLDS, block))


_DESIGN = [*COVARIATES, "site"]
#: Orthogonal covariates of each outcome; the site column repeats what the studies say, so it changes nothing.
_FITTED = f"""{_orthogonal("tr", "g", "outcome")},
f AS (SELECT outcome, subject_row, y, avg(y) OVER w{"".join(f" + coalesce(sum(y * b{j}) OVER w / nullif(s{j}, 0), 0) * b{j}" for j in range(1, _K + 1))} AS fitted FROM g{_K} WINDOW w AS (PARTITION BY outcome))"""
_RESIDUALS = "SELECT a.outcome, iter, a.subject_row, round(a.fitted + b.y - b.fitted, 6) + 0.0 AS y FROM perm p JOIN f a ON a.subject_row = p.subject_row JOIN f b ON b.subject_row = p.source_row AND a.outcome = b.outcome"


def _designed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).withColumn("site", 3 - 2 * F.col("study_2") - F.col("study_3"))


@query("m19_freedman_lane_design", _engine_sql(5, text=f"""tr AS (SELECT 'y' AS outcome, s.subject_row, s.y, {_Z} FROM subjects s),
{_FITTED}
{_RESIDUALS}"""))
def freedman_lane_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted values of y on study, sex, age and a redundant column, plus permuted residuals, by iteration."""
    s = _designed(spark, sf_dir).withColumn("outcome", F.lit("y"))
    return _rounded(plans.freedman_lane(s, plans.permutations(s, 5), _DESIGN, ["outcome"]), "y")


@query("m20_joint_freedman_lane_design", BASE + f""",
block AS (SELECT *, CASE WHEN subject_row < 150 THEN 'extra' ELSE 'shared' END AS block FROM subjects),
iters AS (SELECT unnest(generate_series(1, 4)) AS iter),
ranked AS (SELECT iter, block, subject_row, row_number() OVER (PARTITION BY iter, block ORDER BY subject_row) AS k, row_number() OVER (PARTITION BY iter, block ORDER BY CASE WHEN iter = 1 THEN '' ELSE md5('perm:7:' || iter || ':' || subject_row) END, subject_row) AS h FROM block, iters),
perm AS (SELECT a.iter, a.subject_row, b.subject_row AS source_row FROM ranked a JOIN ranked b ON a.iter = b.iter AND a.block = b.block AND a.k = b.h),
tr AS (SELECT 'all' AS outcome, s.subject_row, s.y, {_Z} FROM block s UNION ALL SELECT 'part', s.subject_row, CAST(s.label AS DOUBLE), {_Z} FROM block s WHERE block = 'shared' UNION ALL SELECT 'square', s.subject_row, s.y * s.y, {_Z} FROM block s),
{_FITTED}
{_RESIDUALS}""")
def joint_freedman_lane_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three outcomes, one measured in a part of the subjects only: each has a fit of its own, all follow one order within each block of availability."""
    s = _designed(spark, sf_dir).withColumn("block", F.when(F.col("subject_row") < 150, "extra").otherwise("shared"))
    outcomes = {"all": (s, F.col("y")), "part": (s.filter("block = 'shared'"), F.col("label").cast("double")), "square": (s, F.col("y") * F.col("y"))}
    every = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("outcome"), "subject_row", *_DESIGN, y.alias("y")) for name, (df, y) in outcomes.items()])
    return _rounded(plans.freedman_lane(every, plans.permutations(s, 4, by=("block",)), _DESIGN, ["outcome"]), "y")


DRAWS = 50
_CLUSTERS = f"""{_LEFT_OUT},
rows AS (SELECT edge_id, person, value, y FROM value JOIN session USING (person, condition) WHERE condition <> 'train'),
people AS (SELECT person, row_number() OVER (ORDER BY person) - 1 AS place, count(*) OVER () AS size FROM (SELECT DISTINCT person FROM rows)),
drawn AS (SELECT replicate, CAST('0x' || substr(md5('boot:11:' || replicate || ':' || place), 1, 12) AS BIGINT) % size AS place FROM people, (SELECT unnest(generate_series(1, {DRAWS})) AS replicate)),
reps AS (SELECT replicate, edge_id, covar_pop(value, y) / (stddev_pop(value) * stddev_pop(y)) AS r FROM drawn JOIN people USING (place) JOIN rows USING (person) GROUP BY ALL)"""


def _repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, person, value, y): two sessions a person, as m15 tests them."""
    edges, permuted, _ = _sessions(spark, sf_dir, 1)
    return edges.filter("condition <> 'train'").join(permuted.drop("iter"), ["person", "condition"]).select("edge_id", "person", "value", "y")


def cluster_replicates(rows: DataFrame, cluster: str, by: list[str], n: int, seed: int = 11) -> DataFrame:
    """(by..., replicate, r): correlations of value and y over draws of clusters; all rows of a drawn one stay together, as often as it is drawn."""
    draws = plans.bootstraps(rows.select(F.col(cluster).alias("subject_row")).distinct(), n, seed)
    times = draws.groupBy("replicate", F.col("subject_row").alias(cluster)).agg(F.count("*").cast("double").alias("times"))
    return engine.weighted_correlations(rows.join(times, cluster), [*by, "replicate"], "times")


def cluster_left_out(rows: DataFrame, cluster: str, by: list[str]) -> DataFrame:
    """(by..., cluster, r): correlations without the rows of one cluster each."""
    own = rows.select(F.col(cluster).alias("fold"), *by, "value", "y")
    return engine.left_out_correlations(own, by).withColumnRenamed("fold", cluster)


@query("m22_cluster_replicates", _CLUSTERS + " SELECT replicate, edge_id, round(r, 6) + 0.0 AS r FROM reps")
def replicates_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cluster_replicates(_repeated_rows(spark, sf_dir), "person", ["edge_id"], DRAWS), "r")


@query("w12_cluster_jackknife", _LEFT_OUT + """,
rows AS (SELECT edge_id, person, value, y FROM value JOIN session USING (person, condition) WHERE condition <> 'train')
SELECT a.edge_id, a.person, round(covar_pop(b.value, b.y) / (stddev_pop(b.value) * stddev_pop(b.y)), 6) + 0.0 AS r FROM (SELECT DISTINCT edge_id, person FROM rows) a JOIN rows b ON a.edge_id = b.edge_id AND a.person <> b.person GROUP BY ALL""")
def people_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cluster_left_out(_repeated_rows(spark, sf_dir), "person", ["edge_id"]), "r")


@query("m22_cluster_interval", _CLUSTERS + """,
i AS (SELECT edge_id, r, row_number() OVER (PARTITION BY edge_id ORDER BY r) AS i, count(*) OVER (PARTITION BY edge_id) AS n FROM reps),
ends AS (SELECT edge_id, sum(r * greatest(0, 1 - abs(i - greatest(n * 0.025 + 0.5, 1)))) AS low, sum(r * greatest(0, 1 - abs(i - least(n * 0.975 + 0.5, n)))) AS high FROM i GROUP BY edge_id),
point AS (SELECT edge_id, covar_pop(value, y) / (stddev_pop(value) * stddev_pop(y)) AS r FROM rows GROUP BY edge_id)
SELECT edge_id, round(r, 6) + 0.0 AS r, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM point JOIN ends USING (edge_id)""")
def interval_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile ends of each edge's correlation over draws of people."""
    return _rounded(people_intervals(spark, sf_dir).select("edge_id", "r", "low", "high"), "r", "low", "high")


def people_intervals(spark: SparkSession, sf_dir: str, n: int = DRAWS) -> DataFrame:
    """(edge_id, r, low, high, bca_low, bca_high) over draws of people with all their sessions, the jackknife over people."""
    rows = written(_repeated_rows(spark, sf_dir), "sessions")
    point = rows.groupBy("edge_id").agg(stats.correlation("value", "y").alias("r"))
    return stats.bias_corrected(cluster_replicates(rows, "person", ["edge_id"], n), point, cluster_left_out(rows, "person", ["edge_id"]), ["edge_id"])


@query("m22_cluster_bca_interval")
def bca_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(people_intervals(spark, sf_dir, 200), "r", "low", "high", "bca_low", "bca_high")


#: Planted full matrices: raw cells; symmetric ones with ones on the diagonal; the same with the diagonal of the data; lower triangles bent by an increasing function.
_PLANTED = {
    "raw": "v",
    "symmetric": "CASE WHEN i = j THEN 1.0 ELSE m END",
    "diagonal": "CASE WHEN i = j THEN v ELSE m END",
    "bent": "CASE WHEN i = j THEN 1.0 WHEN i > j THEN m + m * m * m ELSE m END",
}
_UNIQUE = {("symmetric", "pearson"), ("symmetric", "spearman"), ("bent", "spearman")}


def _layout_sql() -> str:
    parts = []
    for name, value in _PLANTED.items():
        for kind in ("pearson", "spearman"):
            if (name, kind) in _UNIQUE:
                correlated = "upper" if kind == "spearman" else "(upper + lower) / 2"
                parts.append(f"""SELECT '{name}' AS matrix, '{kind}' AS corr_type, 1 AS divisor, subject_row, node_i, node_j, {correlated} AS correlated, (upper + lower) / 2 AS summed FROM (
  SELECT subject_row, least(i, j) AS node_i, greatest(i, j) AS node_j, max(CASE WHEN i < j THEN {value} END) AS upper, max(CASE WHEN i > j THEN {value} END) AS lower FROM c WHERE i <> j GROUP BY ALL)""")
            else:
                parts.append(f"SELECT '{name}', '{kind}', 2, subject_row, i, j, {value}, {value} FROM c")
    return """WITH c AS (SELECT vec_id AS subject_row, pos % 8 AS i, pos // 8 AS j, CAST(embedding[pos + 1] AS DOUBLE) AS v, (CAST(embedding[pos + 1] AS DOUBLE) + CAST(embedding[(pos % 8) * 8 + pos // 8 + 1] AS DOUBLE)) / 2 AS m FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS pos)),
every(matrix, corr_type, divisor, subject_row, node_i, node_j, correlated, summed) AS (""" + "\nUNION ALL ".join(parts) + """)
SELECT matrix, corr_type, divisor, subject_row, node_i, node_j, round(correlated, 6) + 0.0 AS correlated, round(summed, 6) + 0.0 AS summed FROM every"""


@query("m02_edge_layout", _layout_sql())
def edge_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is correlated and what is summed, of four planted kinds of matrices by both correlations."""
    cells = readers.matrix_cells(_vectors(spark, sf_dir)).select("subject_row", F.col("node_i").cast("long").alias("i"), F.col("node_j").cast("long").alias("j"), F.col("value").cast("double").alias("v"))
    mirror = cells.select("subject_row", F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    both = written(cells.join(mirror, ["subject_row", "i", "j"]).withColumn("m", (F.col("v") + F.col("w")) / 2), "cells")
    made = []
    for name, value in _PLANTED.items():
        full = both.select("subject_row", F.col("i").alias("node_i"), F.col("j").alias("node_j"), F.expr(value).alias("value"))
        for kind in ("pearson", "spearman"):
            layout, divisor = networks.edge_layout(full, kind)
            made.append(layout.select(F.lit(name).alias("matrix"), F.lit(kind).alias("corr_type"), F.lit(divisor).alias("divisor"), "*"))
    return _rounded(reduce(DataFrame.unionByName, made), "correlated", "summed")


SIZES, REPETITIONS, FITS = [30, 60, 90], 5, 3
_CURVE = _engine_sql(1, text="""seen AS (SELECT iter // 100 AS unit, iter % 100 AS iter, model, r, mse FROM measured),
first AS (SELECT unit, model, r AS r1, mse AS mse1 FROM seen WHERE iter = 1),
t AS (SELECT unit, model, max(r1) AS r, sum(CASE WHEN r >= r1 THEN 1 ELSE 0 END) / count(*) AS p, max(mse1) AS mse, sum(CASE WHEN mse <= mse1 THEN 1 ELSE 0 END) / count(*) AS mse_p FROM seen JOIN first USING (unit, model) GROUP BY unit, model)
SELECT CAST(unit // 1000 AS INT) AS rep, CAST(unit % 1000 AS INT) AS size, model, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p, round(mse, 6) + 0.0 AS mse, round(mse_p, 6) + 0.0 AS mse_p FROM t""")


def _curve_sql() -> str:
    """k-fold prediction whose iterations number (repetition, size, permutation); each sample has folds and permutations of its own."""
    a, b, c = _CURVE.index("iters AS ("), _CURVE.index("held AS ("), _CURVE.index("summed AS (")
    samples = f"""plan AS ({SQL["m24_nested_sample"]}),
cut AS (SELECT rep, size, subject_row, (row_number() OVER (PARTITION BY rep, size ORDER BY md5('cv:' || rep || ':' || subject_row), subject_row) - 1) % {FOLDS} AS fold FROM plan),
ranked AS (SELECT rep, size, i, subject_row, fold, row_number() OVER (PARTITION BY rep, size, i ORDER BY subject_row) AS k, row_number() OVER (PARTITION BY rep, size, i ORDER BY CASE WHEN i = 1 THEN '' ELSE md5('perm:7:' || i || ':' || subject_row) END, subject_row) AS h FROM cut, (SELECT unnest(generate_series(1, {FITS})) AS i)),
outcome AS (SELECT (a.rep * 1000 + a.size) * 100 + a.i AS iter, a.subject_row, a.fold, s.y FROM ranked a JOIN ranked b ON a.rep = b.rep AND a.size = b.size AND a.i = b.i AND a.k = b.h JOIN subjects s ON s.subject_row = b.subject_row),
"""
    return _CURVE[:a] + samples + _CURVE[b : _CURVE.index("corr AS (")] + _adjusted_masks("iter, held", False, range(20, 90)) + ",\n" + _CURVE[c:]


@query("m24_learning_curve", _curve_sql())
def learning_curve(spark: SparkSession, sf_dir: str, sizes: tuple[int, ...] = tuple(SIZES), repetitions: int = REPETITIONS, fits: int = FITS) -> DataFrame:
    """(rep, size, model, r, p, mse, mse_p): models of nested samples, each with folds and permutations of its own.

    Covariates are those that are independent in the full cohort; samples take their rows of them. Iterations number repetition, size and permutation, so all samples
    are one run of the block kernel.
    """
    v, s = _vectors(spark, sf_dir), _subjects(spark, sf_dir)
    names = stats.independent_columns(readers.covariates(v), COVARIATES)
    by = ["rep", "size"]
    samples = plans.sample_folds(plans.nested_sample(readers.covariates(v).select("subject_row", "study_id"), list(sizes), repetitions).drop("study_id"), FOLDS, by, "rep")
    order = plans.permutations(samples, fits, by=tuple(by))
    scored = order.join(s.select(F.col("subject_row").alias("source_row"), "y"), "source_row").join(samples, [*by, "subject_row"])
    o = written(scored.select((((F.col("rep") * 1000 + F.col("size")) * (fits + 1)) + F.col("iter")).cast("int").alias("iter"), "subject_row", "fold", "y"), "outcome")
    measured = kernel.cross_validate(readers.connectome(v), o, P, covariates=readers.covariates(v), names=names)
    unit = F.floor(F.col("iter") / (fits + 1)).cast("int")
    seen = measured.select((unit / 1000).cast("int").alias("rep"), (unit % 1000).alias("size"), (F.col("iter") % (fits + 1)).alias("iter"), "model", "r", "mse")
    return _rounded(engine.permutation_table(seen, by), "r", "p", "mse", "mse_p")


EACH = 5


def permutation_run(spark: SparkSession, sf_dir: str, path: str, iterations: int = ITERATIONS, units: int | None = None, compute=None) -> DataFrame:
    """(iter, model, r, mse, unit) of m11 as a run of units of EACH iterations at path, of which `units` at most are done now; another call does the rest."""
    edges, o = readers.connectome(_vectors(spark, sf_dir)), written(engine.outcome_table(_subjects(spark, sf_dir), _k_folds(spark, sf_dir), plans.permutations(_subjects(spark, sf_dir), iterations)), "outcome")
    signed = runs.signature({"p": P, "folds": FOLDS, "iterations": iterations}, {"embeddings": _vectors(spark, sf_dir)}, [kernel.block_strengths, kernel.Fold, engine.measure])
    every = range(-(-iterations // EACH))
    own = compute or (lambda u: kernel.cross_validate(edges, o.filter(F.col("iter").between(u * EACH + 1, (u + 1) * EACH)), P))
    return runs.resume(spark, path, signed, every if units is None else every[:units], own)


@query("j15_resumed_permutations", SQL["m11_kfold_cpm"])
def resumed_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m11 as a run that stops after its first unit and is taken up again: the rows of m11_kfold_cpm."""
    path = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    permutation_run(spark, sf_dir, path, units=1)
    measured = permutation_run(spark, sf_dir, path).drop(runs.UNIT)
    return _rounded(engine.permutation_table(measured, []), "r", "p", "mse", "mse_p")


@query("k09_release_manifest")
def release_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, size, hash and allowing pattern of the files of all tables."""
    return runs.manifest(spark, sf_dir, ["*.parquet", "*.parquet/*.parquet"])
