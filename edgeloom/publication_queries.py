"""Publication tables: transfer by class, models and transfer over node sets, overlaps of masks, rankings of edges and nodes. Importing registers them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .functions.stats import exact
from .inference_queries import _people
from .operators import audits, engine, kernel, publication, transfer
from .operators.publication import SPAN
from .plans import plans
from .queries import BASE, FOLDS, ITERATIONS, P, SQL, _engine_sql, _rounded, _subjects, _vectors, query
from .sources import readers
from .sources.shared import written

OUTCOMES = ["sum", "label", "square"]
_SCORE = "CASE unit WHEN 1 THEN y WHEN 2 THEN CAST(label AS DOUBLE) ELSE y * y END"
#: Node sets, from the smallest; the last two nodes of the largest are the group that the others lack in part.
ATLASES = {"six nodes": 6, "seven nodes": 7, "eight nodes": 8}
GROUP = 6
CLASSES = {"first": "first", "second": "second"}
NULLS, NEED, TOP = 10, 8, 5


def _score(unit: str = "unit") -> F.Column:
    return F.when(F.col(unit) == 1, F.col("y")).when(F.col(unit) == 2, F.col("label").cast("double")).otherwise(F.col("y") * F.col("y"))


def _units(df: DataFrame) -> DataFrame:
    """df once for each outcome, numbered by `unit`, with its score as y."""
    return df.withColumn("unit", F.explode(F.sequence(F.lit(1), F.lit(len(OUTCOMES))))).withColumn("y", _score()).drop("label")


def _replaced(text: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        if old not in text:
            raise ValueError(f"not in the SQL: {old}")
        text = text.replace(old, new)
    return text


def _nodes_below(text: str, nodes: int) -> str:
    return _replaced(text, ("FROM embeddings, cell)", f"FROM embeddings, cell WHERE node_j < {nodes})"))


def _over_atlases(text: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT '{name}' AS atlas, * FROM ({_nodes_below(text, nodes)})" for name, nodes in ATLASES.items())


def _edges_below(edges: DataFrame, nodes: int) -> DataFrame:
    """Edges both of whose nodes come before `nodes`: edge ids number the larger node first."""
    return edges.filter(F.col("edge_id") < nodes * readers.NODES)


# transfer

_TRANSFER = SQL["m15_cross_condition_transfer"]
_TRANSFER = _replaced(
    _TRANSFER[: _TRANSFER.index("seen AS (")],
    ("subject_row, y FROM subjects WHERE", "subject_row, y, label FROM subjects WHERE"),
    ("outcome AS (SELECT a.iter, a.person, condition, y FROM ranked a JOIN ranked b ON a.iter = b.iter AND a.k = b.h JOIN session s ON s.person = b.person)", f"outcome AS (SELECT CAST(unit * {SPAN} + a.iter AS INT) AS iter, a.person, condition, {_SCORE} AS y FROM ranked a JOIN ranked b ON a.iter = b.iter AND a.k = b.h JOIN session s ON s.person = b.person, (SELECT unnest([1, 2, 3]) AS unit))"),
) + f"""own AS (SELECT iter // {SPAN} AS unit, iter % {SPAN} AS iter, condition, r FROM measured WHERE model = 'positive' AND condition <> 'pooled' AND threshold = 0.01),
seen AS (SELECT *, max(CASE WHEN iter = 1 THEN r END) OVER (PARTITION BY unit, condition) AS r1 FROM own),
tested AS (SELECT ['sum', 'label', 'square'][unit] AS outcome, unit, condition, max(r1) AS r, sum(CASE WHEN r >= r1 THEN 1 ELSE 0 END) / count(*) AS p FROM seen GROUP BY unit, condition),
ordered AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY p, outcome) AS k, count(*) OVER (PARTITION BY condition) AS m FROM tested),
adjusted AS (SELECT *, least(1.0, min(p * m / k) OVER (PARTITION BY condition ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM ordered)
"""
_CLASS_CELLS = ", ".join(f"round(max(CASE WHEN condition = '{c}' THEN {v} END), {5 if v == 'r' else 6}) + 0.0 AS {n}_{v}" for c, n in CLASSES.items() for v in "rpq")


def class_results(spark: SparkSession, sf_dir: str, iterations: int = 3, nodes: int = readers.NODES) -> DataFrame:
    """(outcome, condition, r, p, sessions) of the positive models at the main threshold, one person left out at a time; all outcomes are one run in matrix form."""
    edges, scores, _ = _people(spark, sf_dir)
    place = (F.floor(F.col("subject_row") / 3).alias("person"), (F.col("subject_row") % 3).alias("session"))
    named = F.when(F.col("session") == 1, "first").when(F.col("session") == 2, "second").otherwise("train").alias("condition")
    labels = _subjects(spark, sf_dir).select(*place, "label").select("person", named, "label")
    units = _units(scores.join(labels, ["person", "condition"]))
    order = plans.permutations(scores.filter("condition = 'train'").select(F.col("person").alias("subject_row")), iterations)
    permuted = order.join(units.withColumnRenamed("person", "source_row"), "source_row")
    permuted = written(permuted.select(publication.coded("unit", "iter").alias("iter"), F.col("subject_row").alias("person"), "condition", "y"), "permuted")
    kept = _edges_below(edges, nodes)
    train, tests = permuted.filter("condition = 'train'").select("iter", "person", "y"), permuted.filter("condition <> 'train'")
    measured = transfer.block_transfer(kept.filter("condition = 'train'").select("person", "edge_id", "value"), train, kept.filter("condition <> 'train'"), tests, [P])
    own = publication.decoded(measured.filter("model = 'positive' AND condition <> 'pooled'"), OUTCOMES)
    sessions = scores.filter("condition <> 'train'").groupBy("condition").agg(F.count("*").alias("sessions"))
    return engine.permutation_table(own, ["outcome", "condition"]).join(F.broadcast(sessions), "condition").select("outcome", "condition", "r", "p", "sessions")


@query("m26_table_2", _TRANSFER + f"SELECT CAST(unit AS INT) AS place, outcome, {_CLASS_CELLS} FROM adjusted GROUP BY unit, outcome")
def table_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer of each outcome to both classes of sessions side by side, with q over the outcomes of a class."""
    table = publication.class_table(class_results(spark, sf_dir), OUTCOMES, CLASSES)
    return table.withColumns({f"{n}_{v}": exact(f"{n}_{v}", 5 if v == "r" else 6) for n in CLASSES.values() for v in "rpq"})


@query("m26_table_s13_transfer", _over_atlases(_TRANSFER + "SELECT outcome, condition, round(r, 5) + 0.0 AS r, round(p, 6) + 0.0 AS p, (SELECT count(*) FROM session s WHERE s.condition = t.condition) AS sessions FROM tested t"))
def table_s13_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer of each outcome to each class by node sets."""
    made = [class_results(spark, sf_dir, nodes=nodes).select(F.lit(name).alias("atlas"), "outcome", "condition", exact("r", 5).alias("r"), exact("p").alias("p"), "sessions") for name, nodes in ATLASES.items()]
    return reduce(DataFrame.unionByName, made)


# models over node sets

#: An outcome that a part of the subjects lacks; each outcome has folds and permutations of its own subjects.
_HAVING = "(unit <> 3 OR subject_row >= 150)"


def _internal_sql() -> str:
    text = _engine_sql(NULLS, text="")
    a, b, c, d = (text.index(k) for k in ("iters AS (", "held AS (", "corr AS (", "summed AS ("))
    cuts = ", ".join(f"({n}, {stats.critical_r(P, n - 2)!r})" for n in (315, 450))
    units = f"""scored AS (SELECT unit, subject_row, {_SCORE} AS y FROM subjects, (SELECT unnest([1, 2, 3]) AS unit) WHERE {_HAVING}),
cut AS (SELECT unit, subject_row, (row_number() OVER (PARTITION BY unit ORDER BY md5('cv:' || unit || ':' || subject_row), subject_row) - 1) % {FOLDS} AS fold FROM scored),
ranked AS (SELECT unit, i, s.subject_row, y, row_number() OVER (PARTITION BY unit, i ORDER BY s.subject_row) AS k, row_number() OVER (PARTITION BY unit, i ORDER BY CASE WHEN i = 1 THEN '' ELSE md5('perm:7:' || i || ':' || s.subject_row) END, s.subject_row) AS h FROM scored s, (SELECT unnest(generate_series(1, {NULLS})) AS i)),
outcome AS (SELECT a.unit * {SPAN} + a.i AS iter, a.subject_row, fold, b.y FROM ranked a JOIN ranked b ON a.unit = b.unit AND a.i = b.i AND a.k = b.h JOIN cut c ON c.unit = a.unit AND c.subject_row = a.subject_row),
"""
    masks = f"""critical(n, cut) AS (VALUES {cuts}),
corr AS (SELECT o.iter, h.held, e.edge_id, count(*) AS n, covar_pop(e.value, o.y) / nullif(stddev_pop(e.value) * stddev_pop(o.y), 0) AS r FROM edges e JOIN outcome o USING (subject_row) JOIN held h ON o.fold <> h.held GROUP BY ALL),
masks AS (SELECT iter, held, edge_id, CAST(sign(r) AS INT) AS sign, r FROM corr JOIN critical USING (n) WHERE abs(r) > critical.cut),
"""
    tail = f"""own AS (SELECT iter // {SPAN} AS unit, iter % {SPAN} AS iter, r, mse FROM measured WHERE model = 'positive'),
seen AS (SELECT *, max(CASE WHEN iter = 1 THEN r END) OVER (PARTITION BY unit) AS r1, max(CASE WHEN iter = 1 THEN mse END) OVER (PARTITION BY unit) AS mse1 FROM own),
tested AS (SELECT unit, max(r1) AS r, sum(CASE WHEN r >= r1 THEN 1 ELSE 0 END) / count(*) AS p, max(mse1) AS mse FROM seen GROUP BY unit),
voted AS (SELECT iter // {SPAN} AS unit, edge_id FROM masks WHERE sign > 0 AND iter % {SPAN} = 1 GROUP BY ALL HAVING count(*) >= {NEED}),
counted AS (SELECT unit, count(*) AS edges, count(*) FILTER (greatest(edge_id // 8, edge_id % 8) >= {GROUP}) AS touching, count(*) FILTER (least(edge_id // 8, edge_id % 8) >= {GROUP}) AS inside FROM voted GROUP BY unit)
SELECT ['sum', 'label', 'square'][t.unit] AS outcome, round(r, 6) + 0.0 AS r, round(p, 6) + 0.0 AS p, round(mse, 6) + 0.0 AS mse, coalesce(edges, 0) AS edges, (SELECT count(*) FROM scored s WHERE s.unit = t.unit) AS subjects,
  coalesce(touching, 0) AS touching, round(coalesce(touching, 0) / greatest(coalesce(edges, 0), 1), 6) + 0.0 AS share, coalesce(inside, 0) AS inside FROM tested t LEFT JOIN counted c USING (unit)"""
    text = text[:a] + units + text[b:c] + masks + text[d:] + tail
    last = list(ATLASES)[-1]
    columns = "atlas, outcome, r, p, mse, edges, subjects"
    return f"SELECT {columns}, CASE WHEN atlas = '{last}' THEN touching END AS touching, CASE WHEN atlas = '{last}' THEN share END AS share, CASE WHEN atlas = '{last}' THEN inside END AS inside FROM ({_over_atlases(text)})"


@query("m26_table_s13_internal", _internal_sql())
def table_s13_internal(spark: SparkSession, sf_dir: str, iterations: int = NULLS) -> DataFrame:
    """Positive models of each outcome by node sets: r, p, mse, edges of the consensus mask, subjects; for the whole set also edges that touch its group, their share, and those inside."""
    s = _units(_subjects(spark, sf_dir).select("subject_row", "y", "label")).filter("unit <> 3 OR subject_row >= 150")
    folds = plans.sample_folds(s.select("unit", "subject_row"), FOLDS, ["unit"], "unit")
    order = plans.permutations(s.select("unit", "subject_row"), iterations, by=("unit",))
    scored = order.join(s.select("unit", F.col("subject_row").alias("source_row"), "y"), ["unit", "source_row"]).join(folds, ["unit", "subject_row"])
    o = written(scored.select(publication.coded("unit", "iter").alias("iter"), "subject_row", "fold", "y"), "outcome")
    numbers = s.groupBy(F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("unit")).alias("outcome")).agg(F.count("*").alias("subjects"))
    ends = (F.floor(F.col("edge_id") / readers.NODES), F.col("edge_id") % readers.NODES)
    made = []
    for name, nodes in ATLASES.items():
        edges = _edges_below(readers.connectome(_vectors(spark, sf_dir)), nodes)
        models = publication.decoded(kernel.cross_validate(edges, o, P).filter("model = 'positive'"), OUTCOMES)
        tested = engine.permutation_table(models, ["outcome"]).select("outcome", "r", "p", "mse")
        voted = publication.decoded(kernel.block_votes(edges, o.filter(F.col("iter") % SPAN == 1), P, NEED).filter("sign > 0"), OUTCOMES)
        counted = voted.groupBy("outcome").agg(F.count("*").alias("edges"), F.count_if(F.greatest(*ends) >= GROUP).alias("touching"), F.count_if(F.least(*ends) >= GROUP).alias("inside"))
        whole = tested.join(numbers, "outcome").join(counted, "outcome", "left").fillna(0, ["edges", "touching", "inside"]).withColumn("share", F.col("touching") / F.greatest("edges", F.lit(1)))
        only = lambda c: (F.col(c) if nodes == readers.NODES else F.lit(None).cast(dict(whole.dtypes)[c])).alias(c)  # noqa: B023,E731
        made.append(whole.select(F.lit(name).alias("atlas"), "outcome", "r", "p", "mse", "edges", "subjects", *map(only, ("touching", "share", "inside"))))
    return _rounded(reduce(DataFrame.unionByName, made), "r", "p", "mse", "share")


# overlaps of masks

LEVELS = [0.01, 0.05]
_LEVELS = ", ".join(f"({p}, {stats.critical_r(p, 500 - 500 // FOLDS - 2)!r})" for p in LEVELS)
_OVERLAPS = _replaced(_engine_sql(ITERATIONS, text=f"""level(threshold, cut) AS (VALUES {_LEVELS}),
voted AS (SELECT threshold, iter // {SPAN} AS unit, iter % {SPAN} AS iter, edge_id FROM corr, level WHERE r > cut GROUP BY ALL HAVING count(*) >= {NEED}),
pair(a, b) AS (VALUES (1, 2), (1, 3), (2, 3)),
sizes AS (SELECT threshold, unit, count(v.edge_id) AS size FROM level CROSS JOIN (SELECT unnest([1, 2, 3]) AS unit) LEFT JOIN (SELECT * FROM voted WHERE iter = 1) v USING (threshold, unit) GROUP BY ALL),
common AS (SELECT l.threshold, a, b, i.iter, count(y.edge_id) AS n FROM level l CROSS JOIN pair CROSS JOIN iters i LEFT JOIN voted x ON x.threshold = l.threshold AND x.unit = a AND x.iter = i.iter LEFT JOIN voted y ON y.threshold = l.threshold AND y.unit = b AND y.iter = i.iter AND y.edge_id = x.edge_id GROUP BY ALL),
seen AS (SELECT *, max(CASE WHEN iter = 1 THEN n END) OVER (PARTITION BY threshold, a, b) AS shared FROM common),
tested AS (SELECT threshold, a, b, max(shared) AS shared, sum(CASE WHEN n >= shared THEN 1 ELSE 0 END) / count(*) AS p FROM seen GROUP BY threshold, a, b),
rated AS (SELECT t.*, x.size AS k1, y.size AS k2, x.size * y.size / 28 AS expected, row_number() OVER (PARTITION BY t.threshold ORDER BY p, a, b) AS k FROM tested t JOIN sizes x ON x.threshold = t.threshold AND x.unit = a JOIN sizes y ON y.threshold = t.threshold AND y.unit = b),
final AS (SELECT *, ['sum', 'label', 'square'][a] AS first, ['sum', 'label', 'square'][b] AS second, shared / nullif(expected, 0) AS ratio, 2 * shared / nullif(k1 + k2, 0) AS dice, CASE WHEN threshold = 0.01 THEN least(1.0, min(p * 3 / k) OVER (PARTITION BY threshold ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM rated)
"""), ("outcome AS (SELECT p.iter, p.subject_row, f.fold, s.y FROM perm p", f"outcome AS (SELECT unit * {SPAN} + p.iter AS iter, p.subject_row, f.fold, {_SCORE} AS y FROM (SELECT unnest([1, 2, 3]) AS unit), perm p"))


def mask_overlaps(spark: SparkSession, sf_dir: str, iterations: int = ITERATIONS) -> DataFrame:
    """`publication.overlaps` of the consensus masks of all outcomes, which follow one permutation in each iteration."""
    s = _subjects(spark, sf_dir).select("subject_row", "y", "label")
    plan = plans.permutations(s, iterations).join(plans.folds(s, FOLDS), "subject_row")
    o = plan.join(_units(s.withColumnRenamed("subject_row", "source_row")), "source_row").select(publication.coded("unit", "iter").alias("iter"), "subject_row", "fold", "y")
    o, edges = written(o, "outcome"), readers.connectome(_vectors(spark, sf_dir))
    voted = [publication.decoded(kernel.block_votes(edges, o, p, NEED).filter("sign > 0"), OUTCOMES).select(F.lit(p).alias("threshold"), "outcome", "iter", "edge_id") for p in LEVELS]
    whole = readers.NODES * (readers.NODES - 1) // 2
    return publication.overlaps(written(reduce(DataFrame.unionByName, voted), "masks"), OUTCOMES, LEVELS, whole, iterations, P)


@query("m26_table_s16_values", _OVERLAPS + "SELECT CAST(threshold AS DOUBLE) AS threshold, first, second, k1 AS size_first, k2 AS size_second, shared, round(expected, 6) + 0.0 AS expected, round(ratio, 6) + 0.0 AS ratio, round(dice, 6) + 0.0 AS dice, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM final")
def table_s16_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mask_overlaps(spark, sf_dir), "expected", "ratio", "dice", "p", "q")


_TEXT = lambda c, form, short=False: "coalesce(" + (f"regexp_replace(format('{{:{form}}}', {c}), '^0\\.', '.')" if short else f"format('{{:{form}}}', {c})") + ", '—')"


@query("m26_table_s16", _OVERLAPS + f"""SELECT 'p < ' || {_TEXT("CAST(threshold AS DOUBLE)", ".2f", True)} AS threshold, first || '–' || second AS pair, format('{{:,}} / {{:,}}', k1, k2) AS mask_edges, format('{{:,}}', shared) || ' (' || format('{{:.2f}}', expected) || ')' AS shared,
  {_TEXT("ratio", ".2f")} AS ratio, {_TEXT("dice", ".3f", True)} AS dice, CASE WHEN threshold = 0.01 THEN {_TEXT("p", ".4f", True)} ELSE '—' END AS p, {_TEXT("q", ".4f", True)} AS q FROM final""")
def table_s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of masks as they are printed."""
    return publication.printed_overlaps(mask_overlaps(spark, sf_dir), P)


# rankings

PARTITIONS, SEED = 5, 123
_STABLE = f"""{BASE},
scored AS (SELECT unit, subject_row, {_SCORE} AS y FROM subjects, (SELECT unnest([1, 2, 3]) AS unit)),
part AS (SELECT seed, subject_row, (row_number() OVER (PARTITION BY seed ORDER BY md5('cv:' || seed || ':' || subject_row), subject_row) - 1) % {FOLDS} AS fold FROM subjects, (SELECT unnest(generate_series({SEED}, {SEED + PARTITIONS - 1})) AS seed)),
corr AS (SELECT s.unit, p.seed, h.held, e.edge_id, covar_pop(e.value, s.y) / (stddev_pop(e.value) * stddev_pop(s.y)) AS r FROM edges e JOIN scored s USING (subject_row) JOIN part p USING (subject_row) JOIN (SELECT unnest(generate_series(0, {FOLDS - 1})) AS held) h ON p.fold <> h.held GROUP BY ALL),
votes AS (SELECT unit, seed, edge_id, count(*) AS votes FROM corr WHERE r > {stats.critical_r(P, 500 - 500 // FOLDS - 2)!r} GROUP BY ALL),
summed AS (SELECT unit, edge_id, sum(votes) FILTER (seed = {SEED}) AS fixed, count(*) FILTER (votes >= {NEED}) AS consensus, sum(votes) AS folds FROM votes GROUP BY ALL),
stable AS (SELECT unit, ['sum', 'label', 'square'][unit] AS outcome, edge_id, CAST(coalesce(fixed, 0) AS BIGINT) AS fixed, coalesce(consensus, 0) AS consensus, CAST(coalesce(folds, 0) AS BIGINT) AS folds, mean_r FROM (SELECT unit, edge_id, round_even(avg(r), 6) + 0.0 AS mean_r FROM corr GROUP BY ALL) LEFT JOIN summed USING (unit, edge_id))
"""


def _stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _subjects(spark, sf_dir).select("subject_row", "y", "label")
    parts = plans.partitions(s, FOLDS, SEED, SEED + PARTITIONS - 1)
    o = parts.join(_units(s), "subject_row").select(publication.coded("unit", "seed").alias("iter"), "subject_row", "fold", "y")
    found = engine.fold_correlations(readers.connectome(_vectors(spark, sf_dir)), o)
    sizes = engine.group_sizes(o.filter(F.col("iter") == SPAN + SEED).withColumn("iter", F.lit(1)))
    named = lambda df: publication.decoded(df, OUTCOMES)
    return written(publication.stable_edges(named(found), named(engine.select_edges(found, P, sizes).filter("sign > 0")), SEED, NEED, PARTITIONS, FOLDS), "stable")


def _ends(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(edge_id, node_i, node_j) and (node, parcel, network) of the matrix's nodes."""
    nodes = spark.range(readers.NODES).select(F.col("id").cast("int").alias("node"), F.concat(F.lit("P"), F.col("id")).alias("parcel"), F.concat(F.lit("N"), F.col("id") % 4).alias("network"))
    i, j = nodes.select(F.col("node").alias("node_i")), nodes.select(F.col("node").alias("node_j"))
    return i.join(j, F.col("node_i") < F.col("node_j")).select((F.col("node_j") * readers.NODES + F.col("node_i")).alias("edge_id"), "node_i", "node_j"), nodes


@query("m26_table_s17_edges", _STABLE + f""", placed AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY consensus DESC, folds DESC, mean_r DESC) AS place, count(*) FILTER (consensus = {PARTITIONS} AND folds = {PARTITIONS * FOLDS}) OVER (PARTITION BY unit) AS maximal FROM stable),
n AS (SELECT p.*, node_i, node_j, 'N' || node_i % 4 AS a, 'N' || node_j % 4 AS b FROM placed p JOIN cell USING (edge_id) WHERE place <= {TOP})
SELECT outcome, CAST(place AS INT) AS place, edge_id, 'P' || node_i AS roi1, 'P' || node_j AS roi2, CASE WHEN a = b THEN a ELSE least(a, b) || '–' || greatest(a, b) END AS network_pair, fixed, consensus, folds, round(100 * folds / {PARTITIONS * FOLDS}, 6) + 0.0 AS frequency, mean_r, maximal FROM n""")
def table_s17_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most stable edges of each outcome, ties at the last place included."""
    ends, nodes = _ends(spark)
    return _rounded(publication.ranked_edges(_stable(spark, sf_dir), ends, nodes, TOP), "frequency", "mean_r")


@query("m26_table_s17_nodes", _STABLE + f""", d AS (SELECT unit, outcome, unnest([node_i, node_j]) AS node, fixed, folds FROM stable JOIN cell USING (edge_id)),
w AS (SELECT unit, outcome, node, count(*) FILTER (fixed >= {NEED}) AS fixed_degree, sum(folds / {PARTITIONS * FOLDS}) AS weighted FROM d GROUP BY ALL),
p AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY round(weighted, 9) DESC) AS place, 100 * weighted / nullif(sum(weighted) OVER (PARTITION BY unit), 0) AS share FROM w)
SELECT outcome, CAST(place AS INT) AS place, node, 'P' || node AS parcel, 'N' || node % 4 AS network, fixed_degree, round(weighted, 6) + 0.0 AS weighted, round(share, 6) + 0.0 AS share FROM p WHERE place <= {TOP}""")
def table_s17_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes whose edges are selected most often, by outcome."""
    ends, nodes = _ends(spark)
    return _rounded(publication.ranked_nodes(_stable(spark, sf_dir), ends, nodes, NEED, TOP), "weighted", "share")
