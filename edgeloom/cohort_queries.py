"""Queries on cohorts and atlases: designs of each outcome, edges of a structure, masks joined by OR and AND, shapes of connectomes. Importing registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.stats import exact
from .operators import audits, designs, engine, networks
from .queries import BASE, FOLDS, P, _engine_sql, _outcome, _vectors, query
from .sources import readers

OUTCOMES = 4
#: Outcomes and the subjects that have them; `both` lacks the lowest study, `men` has one sex.
_HAVE = {"all": "true", "both": "study_id > 1", "men": "sex = 1", "last": "study_id = 3 AND age < 30"}
_COLUMNS = ["study_2", "study_3", "sex", "double_sex", "age"]


def _designs_sql() -> str:
    """Each column less its projections on the columns kept before, step by step."""
    sides = ", ".join(f"('{name}')" for name in _HAVE)
    have = " OR ".join(f"(outcome = '{name}' AND {rule})" for name, rule in _HAVE.items())
    text = f"""{BASE}, o(outcome) AS (VALUES {sides}),
t AS (SELECT outcome, subject_row, study_id, CAST(study_id = 2 AS DOUBLE) AS study_2, CAST(study_id = 3 AS DOUBLE) AS study_3, CAST(sex AS DOUBLE) AS sex, 2.0 * sex + 1 AS double_sex, age, min(study_id) OVER (PARTITION BY outcome) AS reference FROM o, subjects WHERE {have})"""
    before = "t"
    for i, c in enumerate(_COLUMNS):
        centred = f"{c} - avg({c}) OVER w" if not c.startswith("study") else f"CASE WHEN reference = {c[-1]} THEN 0 ELSE {c} - avg({c}) OVER w END"
        text += f",\na{i} AS (SELECT *, {centred} AS x{i} FROM {before} WINDOW w AS (PARTITION BY outcome))"
        # the second projection takes off what rounding left of the first
        parts = lambda v: " ".join(f"- coalesce(sum({v} * z{k}) OVER w / nullif(sum(z{k} * z{k}) OVER w, 0), 0) * z{k}" for k in range(i))  # noqa: B023, E731
        text += f",\nb{i} AS (SELECT *, x{i} {parts(f'x{i}')} AS u{i} FROM a{i} WINDOW w AS (PARTITION BY outcome))"
        text += f",\nc{i} AS (SELECT *, CASE WHEN sum(u{i} * u{i}) OVER w > 1e-10 * sum(x{i} * x{i}) OVER w THEN u{i} ELSE 0 END AS z{i} FROM b{i} WINDOW w AS (PARTITION BY outcome))"
        before = f"c{i}"
    names = ", ".join(f"CASE WHEN sum(z{i} * z{i}) > 0 THEN '{c}' END" for i, c in enumerate(_COLUMNS))
    return f"{text}\nSELECT outcome, count(*) AS n, any_value(reference) AS reference_study, concat_ws(',', {names}) AS columns, 1 + {' + '.join(f'CAST(sum(z{i} * z{i}) > 0 AS INT)' for i in range(len(_COLUMNS)))} AS rank FROM {before} GROUP BY outcome"


@query("x10_outcome_designs", _designs_sql())
def outcome_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference study, columns and rank of the design of each of four outcomes that different subjects have; one column repeats another."""
    c = readers.covariates(_vectors(spark, sf_dir)).withColumn("double_sex", F.col("sex") * 2 + 1)
    held = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in _HAVE.items())))
    rows = c.select(F.explode(held).alias("outcome"), "study_id", *_COLUMNS)
    found = designs.outcome_designs(rows, {2: "study_2", 3: "study_3"}, ["sex", "double_sex", "age"])
    return found.withColumn("columns", F.array_join("columns", ","))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcome(spark, sf_dir, OUTCOMES)
    found = engine.fold_correlations(readers.connectome(_vectors(spark, sf_dir)), o)
    return engine.select_edges(found, P, engine.group_sizes(o))


@query("a21_structure_edges", _engine_sql(OUTCOMES, text=f"""s AS (SELECT n_nationkey AS node FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 8 AND lower(r_name) = 'america'),
k AS (SELECT iter AS outcome, edge_id FROM masks WHERE sign > 0 GROUP BY ALL HAVING count(*) >= {FOLDS * 8 // 10}),
g AS (SELECT outcome, edge_id, node_i IN (SELECT node FROM s) AS i, node_j IN (SELECT node FROM s) AS j FROM k JOIN cell USING (edge_id))
SELECT i.iter AS outcome, count(edge_id) AS edges, count(*) FILTER (i OR j) AS touching, round(count(*) FILTER (i OR j) / greatest(count(edge_id), 1), 6) + 0.0 AS share, count(*) FILTER (i AND j) AS within FROM iters i LEFT JOIN g ON g.outcome = i.iter GROUP BY i.iter"""))
def structure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive consensus edges of each outcome that touch the nodes of a structure of the atlas, with one end or both; permutations stand for outcomes."""
    nations = readers.table(spark, sf_dir, "nation").filter(F.col("n_nationkey") < readers.NODES)
    atlas = nations.join(readers.table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("structure"))
    agreed = engine.consensus(_masks(spark, sf_dir).filter("sign > 0"), ["iter"], FOLDS * 8 // 10).select(F.col("iter").alias("outcome"), "edge_id")
    layout = readers.connectome(_vectors(spark, sf_dir)).select("edge_id", "node_i", "node_j").distinct()
    outcomes = spark.range(1, OUTCOMES + 1).select(F.col("id").alias("outcome"))
    return networks.group_edges(agreed, layout, networks.node_group(atlas, readers.NODES, "America"), outcomes).withColumn("share", exact("share"))


@query("u07_masks_any_all", _engine_sql(OUTCOMES, text=f"z AS (SELECT 1) SELECT iter, sign, edge_id, count(DISTINCT held) AS masks, true AS in_any, count(DISTINCT held) = {FOLDS} AS in_all FROM masks GROUP BY ALL"))
def masks_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that any fold selects and those that all folds do, by sign."""
    return networks.mask_logic(_masks(spark, sf_dir), ["iter", "sign"], "fold", FOLDS)


@query("x24_connectome_shapes", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN embedding[1:63] WHEN vec_id % 50 = 9 THEN embedding[1:49] ELSE embedding END AS e, vec_id % 50 = 11 AS holed FROM embeddings),
n AS (SELECT vec_id, len(e) AS cells, holed FROM v), c AS (SELECT count(*) AS subjects FROM n),
found AS (SELECT 'any size' AS variant, 'square' AS name, count(*) FILTER (cells = 63) AS violations FROM n UNION ALL SELECT 'any size', 'one size', count(*) FILTER (cells <> 64) FROM n UNION ALL SELECT 'any size', 'subjects', 0 FROM n UNION ALL SELECT 'any size', 'finite', count(*) FILTER (holed) FROM n
UNION ALL SELECT 'fixed size', 'square', count(*) FILTER (cells = 63) FROM n UNION ALL SELECT 'fixed size', 'nodes', count(*) FILTER (cells <> 49) FROM n UNION ALL SELECT 'fixed size', 'subjects', CAST(subjects <> 67 AS INT) FROM c UNION ALL SELECT 'fixed size', 'finite', count(*) FILTER (holed) FROM n
UNION ALL SELECT 'shape alone', 'square', count(*) FILTER (cells = 63) FROM n UNION ALL SELECT 'shape alone', 'one size', count(*) FILTER (cells <> 64) FROM n UNION ALL SELECT 'shape alone', 'subjects', CAST(subjects <> 67 AS INT) FROM c)
SELECT DISTINCT variant, name, violations, violations = 0 AS ok FROM found""")
def connectome_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three validators of connectomes among which some lack cells, are of another size, or hold a null."""
    e, place = F.col("embedding"), F.col("vec_id") % 50
    holed = F.transform(e, lambda x, i: F.when(i != 5, x))
    v = _vectors(spark, sf_dir).withColumn("embedding", F.when(place == 7, F.slice(e, 1, 63)).when(place == 9, F.slice(e, 1, 49)).when(place == 11, holed).otherwise(e))
    variants = {
        "any size": audits.connectome_checks(v, subjects=v.count(), finite=True),
        "fixed size": audits.connectome_checks(v, nodes=7, subjects=67, finite=True),
        "shape alone": audits.connectome_checks(v, subjects=67),
    }
    rows = [audits.verdict(checks).select(F.lit(name).alias("variant"), "name", "violations", "ok") for name, checks in variants.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
