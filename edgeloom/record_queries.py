"""Queries on records, checks and files: readers and sinks by round trips through the shared folder, predicates, lookups, run records.

Importing registers them. Files are written to the session's shared folder and read again, so each query shows what a reader makes of what a sink wrote.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .config import Settings
from .functions.stats import exact
from .inference_queries import publication_table
from .operators import audits
from .plans import plans
from .queries import BASE, SQL, _vectors, query
from .report_queries import ranked_edges
from .sources import readers, sinks
from .sources.readers import table
from .sources.shared import shared_folder

CONFIG = Settings()


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _long(*columns: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in columns]


@query("s02_named_variable", "SELECT vec_id, 'embedding' AS name, len(embedding) AS size, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS head FROM embeddings")
def named_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, v = readers.single_variable(_vectors(spark, sf_dir).drop("label"), ["vec_id"])
    return v.select("vec_id", F.lit(name).alias("name"), F.size("value").cast("long").alias("size"), exact(F.col("value")[0].cast("double")).alias("head"))


@query("s04_behavior_loader", BASE + "SELECT subject_row, round(y, 6) + 0.0 AS y FROM subjects")
def behavior_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.finite_behavior(readers.behavior(_vectors(spark, sf_dir))).select("subject_row", exact("y").alias("y"))


@query("s07_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, path = table(spark, sf_dir, "customer"), _place(spark, "csv")
    sinks.write_csv(customers, path)
    return readers.csv(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("s08_spaced_names", 'SELECT p_brand AS "Brand name", count(*) AS "Number of parts", round(avg(p_retailprice), 4) + 0.0 AS "Mean price" FROM part GROUP BY p_brand')
def spaced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "spaced")
    sinks.write_csv(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("Brand name")).agg(F.count("*").alias("Number of parts"), exact(F.avg("p_retailprice"), 4).alias("Mean price")), path)
    return readers.csv(spark, path, "`Brand name` string, `Number of parts` long, `Mean price` double")


@query("s09_byte_order_mark", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def byte_order_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, lines = _place(spark, "bom"), table(spark, sf_dir, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("line"))
    whole = lines.agg(F.concat(F.lit("﻿n_nationkey,n_name\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("value"))  # nations are few
    whole.write.text(path)
    return readers.bom_csv(spark, path)


@query("s10_headerless_atlas", "SELECT CAST(p_partkey AS INT) AS node_id, p_brand AS network, p_size + 0.5 AS x, p_retailprice AS y, -1.0::DOUBLE * p_size AS z FROM part")
def headerless_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, size = _place(spark, "atlas"), F.col("p_size")
    gaps = F.when(F.col("p_partkey") % 2 == 0, "\t").otherwise("\t\t")
    line = F.concat(F.col("p_partkey").cast("double").cast("string"), gaps, "p_brand", F.lit("\t"), (size + 0.5).cast("string"), gaps, F.col("p_retailprice").cast("string"), F.lit("\t"), (-size).cast("string"))
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return readers.headerless_atlas(spark, path)


@query("s12_nested_bundle", "SELECT n_regionkey AS region, count(*) AS nations, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def nested_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result bundle with nested metadata as Parquet; only the fields that are asked for are read."""
    path = _place(spark, "bundle")
    meta = F.struct(F.count("*").alias("nations"), F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.max("n_nationkey").alias("last"))
    table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(meta.alias("metadata")).write.parquet(path)
    return spark.read.parquet(path).select("region", "metadata.nations", "metadata.names")


@query("s13_newest_file", "SELECT r_regionkey, r_name, 2 AS version FROM region")
def newest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, r = _place(spark, "versions"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    for version in (1, 2):
        r.withColumn("version", F.lit(version)).coalesce(1).write.parquet(f"{path}/v{version}")
    return spark.read.parquet(readers.newest(spark, f"{path}/*/*.parquet"))


@query("s14_last_value_of_a_key", "SELECT event_type AS key, arg_max(user_id, event_id)::VARCHAR AS text, arg_max(user_id, event_id)::DOUBLE AS number FROM events GROUP BY event_type")
def last_value_of_a_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" = ", "event_type", "user_id").alias("line"))
    found = readers.key_values(lines, "line", "event_id")
    return found.groupBy("key").agg(F.max_by("text", "event_id").alias("text"), F.max_by("number", "event_id").alias("number"))


@query("s16_optional_input", "SELECT r_regionkey, r_name, false AS pooled FROM region")
def optional_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = readers.checkpoint_or_empty(spark, _place(spark, "absent"), "r_regionkey int, pooled boolean")
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name").join(pooled, "r_regionkey", "left").withColumn("pooled", F.coalesce("pooled", F.lit(False)))


@query("k03_sheets", "SELECT 'nations' AS sheet, n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT 'regions', r_regionkey, r_name FROM region")
def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "workbook")
    nations, regions = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS key", "n_name AS name"), table(spark, sf_dir, "region").selectExpr("r_regionkey AS key", "r_name AS name")
    sinks.write_sheets({"nations": nations, "regions": regions}, path)
    return spark.read.csv(path, header=True, schema="key int, name string, sheet string").select("sheet", "key", "name")


@query("k05_appended_report", "SELECT 'customers: ' || count(*) AS value FROM customer UNION ALL SELECT 'parts: ' || count(*) FROM part")
def appended_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "report")
    for name, source in (("customers", "customer"), ("parts", "part")):
        sinks.append_report(table(spark, sf_dir, source).agg(F.concat(F.lit(f"{name}: "), F.count("*")).alias("value")), path)
    return spark.read.text(path)


@query("k06_conditional_report", """SELECT 'Segment ' || c_mktsegment || ': ' || count(*) || ' customers' AS value FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'Debtors in ' || c_mktsegment || ': ' || count(*) FROM customer WHERE c_acctbal < 0 GROUP BY c_mktsegment HAVING count(*) > 20""")
def conditional_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report; those of debtors stand only where there are more than twenty."""
    path, owing = _place(spark, "report"), F.count_if(F.col("c_acctbal") < 0)
    found = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), owing.alias("owing"))
    lines = F.array(F.format_string("Segment %s: %d customers", "c_mktsegment", "n"), F.when(F.col("owing") > 20, F.format_string("Debtors in %s: %d", "c_mktsegment", "owing")))
    sinks.append_report(found.select(F.explode(lines).alias("value")), path)
    return spark.read.text(path)


@query("k07_markdown_table", "SELECT '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS text FROM region")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown(table(spark, sf_dir, "region"), ["r_regionkey", "r_name"], ["r_regionkey"])


@query("k08_run_record", "SELECT 'RUNNING' AS before, 'COMPLETE' AS after, count(*) AS rows, 1 AS files FROM nation")
def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run writes its record as RUNNING, its outputs, and its record again as COMPLETE with their hash."""
    record, out, n = _place(spark, "record"), _place(spark, "outputs"), table(spark, sf_dir, "nation")
    state = lambda: F.get_json_object("value", "$.status")
    sinks.begin_run(n, record, {"rows": n.count()})
    before = spark.read.text(record).select(state().alias("before")).first().before
    n.coalesce(1).write.parquet(out)
    sinks.finish_run(spark.read.format("binaryFile").load(f"{out}/*.parquet"), record, {"rows": n.count()})
    fields = [F.get_json_object("value", f"$.{c}").cast("long").alias(c) for c in ("rows", "files")]
    return spark.read.text(record).select(F.lit(before).alias("before"), state().alias("after"), *fields)


@query("k09_release_gates", "SELECT n_name || '.csv' AS path FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a release requires and lacks."""
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(".csv")).alias("path"))
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return sinks.missing(named.select("path"), named.join(rich, "n_nationkey", "left_semi"), ["path"])


@query("p01_row_ranges", """WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, c_custkey, place FROM r WHERE n <= 48 OR place BETWEEN 20 AND 67""")
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of a short outcome's rows is taken whole, of a longer one rows 20 to 67."""
    first = CONFIG.whole_rows - CONFIG.short_rows + 1
    own = W.partitionBy("c_nationkey")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.row_number().over(own.orderBy("c_custkey")).cast("long").alias("place"), F.count("*").over(own).alias("n"))
    return rows.filter((F.col("n") <= CONFIG.short_rows) | F.col("place").between(first, CONFIG.whole_rows)).drop("n")


@query("p02_configured_outcomes", "SELECT c_mktsegment AS outcome, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment")
def configured_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["BUILDING", "MACHINERY"]
    found = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin(wanted)).groupBy(F.col("c_mktsegment").alias("outcome")).agg(F.count("*").alias("n"))
    if found.count() != len(wanted):
        raise ValueError("a configured outcome is not there")
    return found


@query("p09_specification_roles", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0.01 THEN 'main' ELSE 'edge_threshold_control' END AS specification, CASE WHEN l_discount = 0.01 THEN 'primary' ELSE 'descriptive' END AS role,
CASE WHEN l_discount = 0.01 THEN l_tax END AS p FROM lineitem WHERE l_quantity > 40""")
def specification_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls are described, not tested: their p is null."""
    main = F.col("l_discount") == F.lit(CONFIG.threshold)
    pick = lambda a, b: F.when(main, a).otherwise(b)
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select("l_orderkey", "l_linenumber", pick("main", "edge_threshold_control").alias("specification"), pick("primary", "descriptive").alias("role"), F.when(main, F.col("l_tax")).alias("p"))


@query("p11_case_insensitive", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE lower(o_orderpriority) = lower('2-High') OR lower(o_orderstatus) = 'p' GROUP BY o_orderpriority")
def case_insensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda column, text: F.lower(column) == F.lower(F.lit(text))
    return table(spark, sf_dir, "orders").filter(same("o_orderpriority", "2-High") | same("o_orderstatus", "P")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("p12_substrings", "SELECT p_type, count(*) AS n FROM part WHERE contains(p_name, 'ring') AND NOT contains(p_type, 'PROMO') GROUP BY p_type")
def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.contains("p_name", F.lit("ring")) & ~F.contains("p_type", F.lit("PROMO"))).groupBy("p_type").agg(F.count("*").alias("n"))


@query("p13_float_filters", "SELECT l_returnflag, count(*) FILTER (l_discount = 0.01) AS exact, count(*) FILTER (abs(l_discount + 0.02 - 0.03) < 2.220446049250313e-16) AS near FROM lineitem GROUP BY l_returnflag")
def float_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(d == 0.01).alias("exact"), F.count_if(F.abs(d + 0.02 - 0.03) < 2.220446049250313e-16).alias("near"))


@query("p14_hidden_names", "WITH f AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN '.' ELSE '' END || c_name AS name FROM customer) SELECT name FROM f WHERE name NOT LIKE '.%'")
def hidden_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("c_custkey") % 7 == 0, ".").otherwise(""), "c_name").alias("name")
    return table(spark, sf_dir, "customer").select(name).filter(~F.startswith("name", F.lit(".")))


@query("p15_correlation_inversion", "SELECT p_brand AS outcome, CASE WHEN min(p_size) % 2 = 0 THEN 'Spearman' ELSE 'Pearson' END AS inverted FROM part GROUP BY p_brand")
def correlation_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other type of correlation than the configured one, as sensitivity analyses take it."""
    configured = F.when(F.min("p_size") % 2 == 0, "Pearson").otherwise("Spearman")
    named = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("outcome")).agg(configured.alias("configured"))
    return named.select("outcome", F.when(F.col("configured") == "Pearson", "Spearman").otherwise("Pearson").alias("inverted"))


@query("m13_default_correlation", "SELECT p_partkey, p_brand AS behavior, CASE WHEN p_size % 10 = 0 THEN 'Spearman' WHEN contains(p_brand, '#1') OR contains(p_brand, '#3') THEN 'Pearson' ELSE 'Spearman' END AS type FROM part")
def default_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by the names of behaviours: brands, two kinds of which stand for interval scales; some rows override theirs."""
    settings = Settings(interval=("#1", "#3"))
    override = F.when(F.col("p_size") % 10 == 0, "Spearman")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("behavior"), settings.correlation_type(F.col("p_brand"), override).alias("type"))


@query("m27_deprecated_alias", SQL["m26_publication_table"])
def deprecated_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old name of the publication table."""
    warnings.warn("m27_deprecated_alias: use m26_publication_table", DeprecationWarning, stacklevel=2)
    return publication_table(spark, sf_dir)


@query("j02_held_out_matched", "SELECT o_orderkey, o_custkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey")
def held_out_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of held-out rows; the query fails unless each one is found."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    if not sinks.missing(orders, people, ["o_custkey"]).isEmpty():
        raise ValueError("a held-out row has no position")
    return orders.join(people, "o_custkey")


@query("j06_endpoint_metadata", BASE + """,
n AS (SELECT n_nationkey AS node, n_name AS label, n_regionkey AS net FROM nation)
SELECT DISTINCT edge_id, a.label AS label_i, b.label AS label_j, a.net = b.net AS within FROM edges JOIN n a ON a.node = node_i JOIN n b ON b.node = node_j""")
def endpoint_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("net"))
    end = lambda side: nodes.select(*(F.col(c).alias(f"{c}_{side}") for c in nodes.columns))
    edges = readers.connectome(_vectors(spark, sf_dir)).select("edge_id", "node_i", "node_j").distinct()
    return edges.join(end("i"), "node_i").join(end("j"), "node_j").select("edge_id", "label_i", "label_j", (F.col("net_i") == F.col("net_j")).alias("within"))


@query("j07_reconciled_labels", """WITH a AS (SELECT n_nationkey AS node, n_name AS label FROM nation), b AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END AS label FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 99, 'extra')
SELECT coalesce(a.node, b.node) AS node, a.label AS first, b.label AS second FROM a FULL JOIN b ON a.node = b.node WHERE a.label IS DISTINCT FROM b.label""")
def reconciled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that two atlases name differently, or that one of them lacks."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("first"))
    other = n.filter("node <> 3").select("node", F.when(F.col("node") % 6 == 0, F.lower("first")).otherwise(F.col("first")).alias("second"))
    other = other.unionByName(n.limit(1).select(F.lit(99).alias("node"), F.lit("extra").alias("second")))
    return n.join(other, "node", "full").filter(~F.col("first").eqNullSafe(F.col("second")))


@query("j12_parameter_grid", "SELECT r_name AS connectome, c_mktsegment AS outcome, adjusted, folds FROM region, (SELECT DISTINCT c_mktsegment FROM customer), (VALUES (false), (true)) a(adjusted), (VALUES (5), (10)) f(folds)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of a few settings."""
    grid = table(spark, sf_dir, "region").select(F.col("r_name").alias("connectome"))
    grid = grid.crossJoin(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("outcome")).distinct())
    return grid.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("adjusted")).select("*", F.explode(F.array(F.lit(5), F.lit(10))).alias("folds"))


@query("j20_exactly_one_match", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def exactly_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = readers.exactly_one(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), ["n_regionkey"])
    nations = table(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    if not sinks.missing(nations, regions, ["n_regionkey"]).isEmpty():
        raise ValueError("a nation has no region")
    return nations.join(regions, "n_regionkey").select("n_name", "r_name")


@query("w10_centred_values", "SELECT l_orderkey, l_linenumber, round(l_tax - avg(l_tax) OVER (PARTITION BY l_suppkey), 6) + 0.0 AS centred FROM lineitem")
def centred_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean for each group, joined back: a group's rows need not stand in one task."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_tax")  # noqa: E741
    return l.join(l.groupBy("l_suppkey").agg(F.avg("l_tax").alias("mean")), "l_suppkey").select("l_orderkey", "l_linenumber", exact(F.col("l_tax") - F.col("mean")).alias("centred"))


@query("o03_stable_order", "SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_size DESC, p_partkey) AS parts FROM part GROUP BY p_brand")
def stable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by falling weight; ties keep the order of their numbers."""
    rows = F.sort_array(F.collect_list(F.struct((-F.col("p_size")).alias("weight"), "p_partkey")))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.transform(rows, lambda x: x["p_partkey"]), ",").alias("parts"))


@query("u06_forbidden_columns", "SELECT column_name, lower(column_name) IN ('c_name', 'c_acctbal') AS forbidden FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) t(column_name)")
def forbidden_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table to be released, and whether they may not be shown."""
    customers, bad = table(spark, sf_dir, "customer"), ["C_NAME", "c_acctbal"]
    readers.without_forbidden(customers.drop("c_name", "c_acctbal"), bad)
    names = F.explode(F.array(*map(F.lit, customers.columns))).alias("column_name")
    return customers.limit(1).select(names).select("column_name", F.lower("column_name").isin([c.lower() for c in bad]).alias("forbidden"))


@query("v01_shape_and_alignment", """SELECT 'cells' AS name, count(*) FILTER (len(embedding) <> 64) AS violations, count(*) FILTER (len(embedding) <> 64) = 0 AS ok FROM embeddings UNION ALL
SELECT 'finite', count(*) FILTER (NOT isfinite(v)), count(*) FILTER (NOT isfinite(v)) = 0 FROM (SELECT unnest(embedding) AS v FROM embeddings) UNION ALL SELECT 'twice', count(*), count(*) = 0 FROM (SELECT vec_id FROM embeddings GROUP BY vec_id HAVING count(*) > 1)""")
def shape_and_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, x = _vectors(spark, sf_dir), F.col("value")
    cells = readers.matrix_cells(v)
    return audits.verdict({"cells": v.filter(F.size("embedding") != readers.NODES**2), "finite": cells.filter(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "twice": v.groupBy("vec_id").count().filter("count > 1")})


@query("v02_binary_coding", "SELECT 'toxic' AS name, count(*) FILTER (toxic NOT IN (0, 1) OR toxic IS NULL) AS violations, count(*) FILTER (toxic NOT IN (0, 1) OR toxic IS NULL) = 0 AS ok FROM labels UNION ALL SELECT 'quality', count(*) FILTER (quality NOT IN (0, 1) OR quality IS NULL), count(*) FILTER (quality NOT IN (0, 1) OR quality IS NULL) = 0 FROM labels UNION ALL SELECT 'studies', count(*) FILTER (vec_id % 97 = 5), count(*) FILTER (vec_id % 97 = 5) = 0 FROM embeddings")
def binary_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators are 0 or 1, and study indicators agree with the study's label; in some rows one is planted that does not."""
    labels, c = table(spark, sf_dir, "labels"), readers.covariates(_vectors(spark, sf_dir))
    c = c.withColumn("study_2", F.when(F.col("subject_row") % 97 == 5, 1 - F.col("study_2")).otherwise(F.col("study_2")))
    off = lambda name: ~F.coalesce(F.col(name).isin(0, 1), F.lit(False))
    clash = ((F.col("study_id") == 2) != (F.col("study_2") == 1)) | ((F.col("study_id") == 3) != (F.col("study_3") == 1))
    return audits.verdict({"toxic": labels.filter(off("toxic")), "quality": labels.filter(off("quality")), "studies": c.filter(clash)})


@query("v06_recomputed_ranking", f"""WITH o AS ({SQL["o02_ranked_edges"]}), stored AS (SELECT edge_id, votes, CASE WHEN edge_id = 17 THEN mean + 0.000001 ELSE mean END AS mean, CASE WHEN edge_id = 8 THEN place + 1 ELSE place END AS place FROM o),
cells AS (SELECT s.edge_id, 'mean' AS name, s.mean AS stored, o.mean AS computed FROM stored s JOIN o USING (edge_id) UNION ALL SELECT s.edge_id, 'place', s.place, o.place FROM stored s JOIN o USING (edge_id) UNION ALL SELECT s.edge_id, 'votes', s.votes, o.votes FROM stored s JOIN o USING (edge_id))
SELECT edge_id, name AS "column", round(CAST(stored AS DOUBLE), 6) + 0.0 AS stored, round(CAST(computed AS DOUBLE), 6) + 0.0 AS computed FROM cells WHERE abs(stored - computed) > 1e-7""")
def recomputed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a stored ranking that a second way does not confirm; two are planted, a mean and a place.

    The second way makes means from sums, rounds them half to even by whole and rest, and ranks by counts of the distinct values before.
    """
    path = _place(spark, "table")
    wrong = {"mean": F.when(F.col("edge_id") == 17, F.col("mean") + 1e-6).otherwise(F.col("mean")), "place": F.when(F.col("edge_id") == 8, F.col("place") + 1).otherwise(F.col("place"))}
    ranked_edges(spark, sf_dir).withColumns(wrong).write.parquet(path)
    columns = ["votes", "mean", "place"]
    found = audits.beyond_tolerance(spark.read.parquet(path), ranked_again(spark, sf_dir), ["edge_id"], columns, 1e-7)
    return found.withColumns({c: exact(c) for c in ("stored", "computed")})


def ranked_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, votes, mean, place) without a rank window and without Spark's rounding."""
    cells = readers.connectome(table(spark, sf_dir, "embeddings"))
    e = cells.groupBy("edge_id").agg(F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("positive"), (F.sum("value") / F.count("value") * 1e6).alias("scaled"))
    whole = F.floor("scaled")
    rest = F.col("scaled") - whole
    even = whole + F.when(rest > 0.5, 1).when(rest < 0.5, 0).otherwise(F.pmod(whole, F.lit(2)))
    e = e.select("edge_id", F.floor(F.col("positive") / 10).alias("votes"), (even / 1e6).alias("mean"))
    kinds = e.groupBy("votes", "mean").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("votes"), F.desc("mean")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a distinct pair
    return e.join(kinds.select("votes", "mean", (before + 1).alias("place")), ["votes", "mean"])


@query("x03_parameter_sheet", "SELECT unnest(['folds', 'iterations', 'threshold', 'subjects']) AS name, unnest(['10', '10000', '0.01', (SELECT count(*) FROM embeddings)::VARCHAR]) AS value")
def parameter_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.create_map(*(F.lit(x) for c in ("folds", "iterations", "threshold") for x in (c, str(getattr(CONFIG, c)))), F.lit("subjects"), F.count("*").cast("string"))
    return _vectors(spark, sf_dir).agg(shown.alias("all")).select(F.explode("all").alias("name", "value"))


@query("x06_checkpoint_compare", "SELECT 'subjects' AS key, '10' AS stored, CAST(count(*) AS VARCHAR) AS current FROM embeddings")
def checkpoint_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that forbid resuming from a checkpoint; presentation-only ones never do."""
    sheet = parameter_sheet(spark, sf_dir).withColumnRenamed("name", "key")
    sheet = sheet.unionByName(sheet.limit(1).select(F.lit("title").alias("key"), F.lit("new").alias("value")))
    stored = sheet.withColumn("value", F.when(F.col("key") == "subjects", "10").when(F.col("key") == "title", "old").otherwise(F.col("value")))
    return audits.incompatible(stored, sheet, list(CONFIG.presentation))


@query("x14_numbers_by_outcome", "SELECT r_name AS outcome, count(n_nationkey) AS n, max(CASE WHEN r_regionkey < 3 THEN n_nationkey END) AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey")
def numbers_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by outcome; a value that only some atlases have is null in the others."""
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"), F.max("n_nationkey").alias("last"))
    return table(spark, sf_dir, "region").join(nations, "r_regionkey", "left").select(F.col("r_name").alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("r_regionkey") < 3, F.col("last")).alias("value"))


@query("x17_derived_q", SQL["w03_benjamini_hochberg"])
def derived_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q where a summary lacks it; the second pass verifies the first."""
    counted = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_returnflag").alias("family"))
    p = counted.agg(F.round(1.0 / (1 + F.count("*") + F.sum("l_quantity") / 100), 9).alias("p"))
    once = audits.with_q(p, "p", ["family"], ["l_partkey"])
    return audits.with_q(once, "p", ["family"], ["l_partkey"]).select("family", "l_partkey", exact("q").alias("q"))


@query("x18_preferred_file", "SELECT n_name AS path, sha256(n_name) AS sha256, CASE WHEN n_nationkey < 20 THEN 'current' ELSE 'legacy' END AS source FROM nation")
def preferred_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    return audits.preferred_file(files.filter("n_nationkey < 20").drop("n_nationkey"), files.filter("n_nationkey >= 10").drop("n_nationkey"), {})


@query("x21_display_strings", "SELECT c_custkey, concat_ws(' / ', c_mktsegment, CASE WHEN c_acctbal >= 5000 THEN 'rich' END, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_name END, 'unlabeled')) AS shown FROM customer")
def display_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich, label = F.when(F.col("c_acctbal") >= 5000, "rich"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" / ", "c_mktsegment", rich, F.coalesce(label, F.lit("unlabeled"))).alias("shown"))


@query("x23_verdict", "SELECT 'customers known' AS name, 0 AS violations, true AS ok UNION ALL SELECT 'quantity over 49', count(*), count(*) = 0 FROM lineitem WHERE l_quantity > 49")
def one_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return audits.verdict({"customers known": sinks.missing(table(spark, sf_dir, "orders").select("o_custkey"), people, ["o_custkey"]), "quantity over 49": table(spark, sf_dir, "lineitem").filter("l_quantity > 49")})


@query("x26_run_fields", "SELECT strftime(max(o_orderdate), '%Y%m%dT%H%M%S') || '-' || count(*) AS run_id, strftime(min(o_orderdate), '%Y-%m-%d') AS started, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days, sha256(CAST(count(*) AS VARCHAR)) AS input_sha256 FROM orders")
def run_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a run record: an id from time and size, dates, a hash of the input."""
    first, last, n = F.min("o_orderdate"), F.max("o_orderdate"), F.count("*")
    return table(spark, sf_dir, "orders").agg(F.concat_ws("-", F.date_format(last, "yyyyMMdd'T'HHmmss"), n).alias("run_id"), F.date_format(first, "yyyy-MM-dd").alias("started"), F.datediff(last, first).cast("long").alias("days"), F.sha2(n.cast("string"), 256).alias("input_sha256"))


@query("s15_pruned_bundle", "SELECT o_orderkey, o_totalprice AS total, year(o_orderdate) AS year FROM orders")
def pruned_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of a saved bundle's nested results, and its key."""
    path = _place(spark, "results")
    results = F.struct(F.col("o_totalprice").alias("total"), F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus", "o_orderpriority")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", results.alias("results")).write.parquet(path)
    return readers.pruned(spark, path, ["o_orderkey", "results.total", "results.year"])


@query("k10_session_log", " UNION ALL ".join(f"SELECT 'INFO {t}: ' || count(*) || ' rows' AS line FROM {t}" for t in ("orders", "lineitem", "events")) + " UNION ALL SELECT 'WARNING ' || count(*) || ' customers owe' FROM customer WHERE c_acctbal < 0")
def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of a session of counts, as it is read again."""
    path = _place(spark, "log")
    with sinks.SessionLog(spark, path, "edgeloom.session") as log:
        for name in ("orders", "lineitem", "events"):
            log.info("%s: %d rows", name, table(spark, sf_dir, name).count())
        log.warning("%d customers owe", table(spark, sf_dir, "customer").filter("c_acctbal < 0").count())
        log.debug("left out")
    return spark.read.text(path).select(F.col("value").alias("line"))
