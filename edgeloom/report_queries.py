"""Further queries: alignment of tables, orders of publication, histograms, masks and file ownership. Importing registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import ranks
from .functions.stats import exact
from .operators import audits
from .queries import BASE, _rounded, _vectors, query
from .sources import readers


@query("j03_crosswalk", "SELECT a.vec_id // 2 AS person, a.vec_id AS first_row, b.vec_id AS second_row, a.label AS first_label, b.label AS second_label FROM embeddings a JOIN embeddings b ON a.vec_id // 2 = b.vec_id // 2 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1")
def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions of a person side by side, from one pass instead of a self-join."""
    v = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 2).alias("person"), (F.col("vec_id") % 2).alias("session"), "vec_id", "label")
    at = lambda c, s: F.max(F.when(F.col("session") == s, F.col(c)))
    both = v.groupBy("person").agg(at("vec_id", 0).alias("first_row"), at("vec_id", 1).alias("second_row"), at("label", 0).alias("first_label"), at("label", 1).alias("second_label"))
    return both.filter("first_row IS NOT NULL AND second_row IS NOT NULL")


@query("j08_pooled_equals_parts", """SELECT 'whole parts' AS name, 0 AS violations, true AS ok UNION ALL
SELECT 'changed part', 2 * count(*), count(*) = 0 FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 97 = 5 UNION ALL SELECT 'lost rows', count(*), count(*) = 0 FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 89 = 4""")
def pooled_equals_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled table against the parts that make it up, and against parts with planted faults: labels of some rows changed, some rows lost."""
    v = _vectors(spark, sf_dir).select("vec_id", "label", exact(F.col("embedding")[0].cast("double")).alias("v"))
    even, odd = v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1")
    changed = odd.withColumn("label", F.when(F.col("vec_id") % 97 == 5, F.col("label") + 1).otherwise(F.col("label")))
    parts = {"whole parts": even.unionByName(odd), "changed part": even.unionByName(changed), "lost rows": even.filter("vec_id % 89 <> 4").unionByName(odd)}
    return audits.verdict({name: audits.differing_rows(v, p) for name, p in parts.items()})


@query("j16_missing_requirements", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def missing_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = readers.table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    return readers.table(spark, sf_dir, "nation").join(present, "n_nationkey", "left_anti").select("n_name")


@query("o02_ranked_edges", BASE + """,
e AS (SELECT edge_id, count(*) FILTER (value > 0) // 10 AS votes, round_even(avg(value), 6) AS mean FROM edges GROUP BY edge_id)
SELECT edge_id, votes, mean + 0.0 AS mean, rank() OVER (ORDER BY votes DESC, mean DESC) AS place FROM e""")
def ranked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competition ranks over two descending keys, the second one rounded half to even."""
    e = readers.connectome(_vectors(spark, sf_dir)).groupBy("edge_id").agg(F.expr("count_if(value > 0) div 10").alias("votes"), (F.bround(F.avg("value"), 6) + F.lit(0.0)).alias("mean"))
    return e.withColumn("place", F.rank().over(W.orderBy(F.desc("votes"), F.desc("mean"))))


@query("o04_publication_order", "SELECT c_mktsegment, count(*) AS n, list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD', 'AUTOMOBILE', 'FURNITURE'], c_mktsegment) AS place FROM customer GROUP BY c_mktsegment")
def publication_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array(*map(F.lit, ("MACHINERY", "BUILDING", "HOUSEHOLD", "AUTOMOBILE", "FURNITURE")))
    counted = readers.table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.array_position(order, F.col("c_mktsegment")).cast("int")).orderBy("place")


@query("u04_stable_distinct", "SELECT event_type, min(event_id) AS first, row_number() OVER (ORDER BY min(event_id)) AS place FROM events GROUP BY event_type")
def stable_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order of their first row."""
    first = readers.table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))
    return first.withColumn("place", F.row_number().over(W.orderBy("first")))


@query("u05_subset_and_equality", """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT s_suppkey AS k FROM supplier), x AS (SELECT count(*) AS n FROM (SELECT k FROM a EXCEPT SELECT k FROM b)), y AS (SELECT count(*) AS n FROM (SELECT k FROM b EXCEPT SELECT k FROM a))
SELECT 'subset' AS name, x.n AS violations, x.n = 0 AS ok FROM x UNION ALL SELECT 'equal', x.n + y.n, x.n + y.n = 0 FROM x, y""")
def subset_and_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = readers.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).distinct()
    b = readers.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return audits.verdict({"subset": a.join(b, "k", "left_anti"), "equal": audits.differing_rows(a, b)})


@query("x09_boolean_mask", BASE + ", s AS (SELECT edge_id FROM edges GROUP BY edge_id HAVING avg(value) > 0) SELECT DISTINCT e.edge_id, s.edge_id IS NOT NULL AS selected FROM edges e LEFT JOIN s USING (edge_id)")
def boolean_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = readers.connectome(_vectors(spark, sf_dir))
    chosen = edges.groupBy("edge_id").agg(F.avg("value").alias("mean")).filter("mean > 0").select("edge_id", F.lit(True).alias("__in"))
    return edges.select("edge_id").distinct().join(chosen, "edge_id", "left").select("edge_id", F.col("__in").isNotNull().alias("selected"))


@query("x13_stability_summary", "WITH v AS (SELECT l_returnflag, l_partkey, count(*) AS votes FROM lineitem GROUP BY ALL) SELECT l_returnflag, count(*) AS edges, count(*) FILTER (votes >= 10) AS half, max(votes) AS most, round(sum(votes) / 10, 6) + 0.0 AS per_fold FROM v GROUP BY l_returnflag")
def stability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = readers.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.count("*").alias("votes"))
    return votes.groupBy("l_returnflag").agg(F.count("*").alias("edges"), F.count_if(F.col("votes") >= 10).alias("half"), F.max("votes").alias("most"), exact(F.sum("votes") / 10).alias("per_fold"))


@query("a18_log_histogram", "WITH c AS (SELECT l_suppkey, log10(count(*) + 1) AS v FROM lineitem GROUP BY l_suppkey) SELECT CAST(least(49, floor(v / 0.1)) AS BIGINT) AS bin, count(*) AS n FROM c GROUP BY bin")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty bins of a tenth; the last one is closed on the right."""
    c = readers.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.log10(F.count("*") + 1).alias("v"))
    return c.groupBy(F.least(F.lit(49), F.floor(F.col("v") / 0.1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("w04_family_q_values", """WITH p AS (SELECT p_brand AS family, p_partkey, round(p_size / 51.0, 6)::DOUBLE AS p FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, p_partkey) AS k, count(*) OVER (PARTITION BY family) AS m FROM p)
SELECT family, p_partkey, p, round(least(1.0, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS q FROM r""")
def family_q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q derived for a summary that has none, by family."""
    p = readers.table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), "p_partkey", F.round(F.col("p_size") / F.lit(51.0), 6).alias("p"))
    return _rounded(audits.with_q(p, "p", ["family"], ["p_partkey"]), "q")


@query("x19_owning_directory", """WITH s AS (SELECT DISTINCT 'runs/' || (user_id % 7) || '/' || event_type || '/out.csv' AS source FROM events), r AS (SELECT DISTINCT 'runs/' || (user_id % 7) AS directory FROM events WHERE user_id % 7 < 5 UNION SELECT DISTINCT 'runs/' || (user_id % 7) || '/' || event_type FROM events WHERE event_type = 'click')
SELECT source, arg_max(directory, length(directory)) AS directory FROM s LEFT JOIN r ON starts_with(source, directory || '/') GROUP BY source""")
def owning_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = readers.table(spark, sf_dir, "events")
    run = F.concat(F.lit("runs/"), (F.col("user_id") % 7).cast("string"))
    sources = e.select(F.concat(run, F.lit("/"), "event_type", F.lit("/out.csv")).alias("source")).distinct()
    records = e.filter("user_id % 7 < 5").select(run.alias("directory")).union(e.filter("event_type = 'click'").select(F.concat(run, F.lit("/"), "event_type"))).distinct()
    return audits.owning_directory(sources, records)


@query("x11_behavior_provenance", """WITH a AS (SELECT user_id, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id), b AS (SELECT user_id, max(value) AS value FROM events GROUP BY user_id)
SELECT user_id, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NULL THEN 'standard' ELSE 'difference' END AS source FROM b LEFT JOIN a USING (user_id)""")
def behavior_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the source that they come from; both come from one aggregate."""
    e = readers.table(spark, sf_dir, "events")
    best = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("difference"), F.max("value").alias("standard"))
    return best.select("user_id", F.coalesce("difference", "standard").alias("value"), F.when(F.col("difference").isNull(), "standard").otherwise("difference").alias("source"))


@query("a20_overlap_effects", """WITH m AS (SELECT DISTINCT l_returnflag AS mask, l_partkey AS edge FROM lineitem WHERE l_quantity > 45), k AS (SELECT mask, count(*) AS k FROM m GROUP BY mask), t AS (SELECT count(*) AS n FROM part)
SELECT a.mask AS first, b.mask AS second, (SELECT count(*) FROM m x JOIN m y USING (edge) WHERE x.mask = a.mask AND y.mask = b.mask) AS shared, round(a.k * b.k / n, 6) + 0.0 AS expected, round((SELECT count(*) FROM m x JOIN m y USING (edge) WHERE x.mask = a.mask AND y.mask = b.mask) / (a.k * b.k / n), 6) + 0.0 AS ratio FROM k a JOIN k b ON a.mask < b.mask, t""")
def overlap_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared edges of each pair of masks against their expectation. Pairs of masks come from one array an edge, whose length is the number of masks."""
    m = readers.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_returnflag").alias("mask"), F.col("l_partkey").alias("edge")).distinct()
    sizes = m.groupBy("mask").agg(F.count("*").alias("k"))
    total = readers.table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    held = m.groupBy("edge").agg(F.collect_set("mask").alias("masks")).filter("size(masks) > 1")
    shared = held.select(F.explode("masks").alias("first"), "masks").select("first", F.explode("masks").alias("second")).filter("first < second").groupBy("first", "second").agg(F.count("*").alias("shared"))
    a, b = sizes.select(F.col("mask").alias("first"), F.col("k").alias("a")), sizes.select(F.col("mask").alias("second"), F.col("k").alias("b"))
    pairs = a.join(b, F.col("first") < F.col("second")).join(shared, ["first", "second"], "left").join(total, how="cross")  # one row
    expected = F.col("a") * F.col("b") / F.col("n")
    return pairs.select("first", "second", F.coalesce("shared", F.lit(0)).alias("shared"), exact(expected).alias("expected"), exact(F.try_divide(F.coalesce("shared", F.lit(0)), expected)).alias("ratio"))


@query("o01_sorted_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders")
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all rows in a sort by several columns and directions, without a window over the whole table."""
    o = readers.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranks.sorted_rows(o, ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "place")


@query("a15_distinct_checks", """WITH r AS (SELECT 'subjects' AS name, count(*) AS n FROM (SELECT vec_id FROM embeddings GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'customers of orders', count(*) FROM (SELECT o_custkey FROM orders GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'users and types', count(*) FROM (SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) > 1)) SELECT name, n AS violations, n = 0 AS ok FROM r""")
def distinct_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one and of several columns that are not distinct."""
    t = lambda name: readers.table(spark, sf_dir, name)
    return audits.verdict({"subjects": audits.repeated(t("embeddings"), ["vec_id"]), "customers of orders": audits.repeated(t("orders"), ["o_custkey"]), "users and types": audits.repeated(t("events"), ["user_id", "event_type"])})


@query("a15_distinct_pairs", "SELECT o_orderpriority, o_orderstatus, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) AS place FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of two columns in sorted order."""
    pairs = readers.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    return ranks.sorted_rows(pairs, ["o_orderpriority", "o_orderstatus"])
