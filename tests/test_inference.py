import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import stats
from edgeloom.operators import adjusted, audits, networks, transfer
from edgeloom.plans import plans


def test_design_keeps_columns_that_raise_the_rank(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=40), rng.integers(0, 2, 40)
    frame = pd.DataFrame({"a": a, "twice": 2 * a + 5, "b": b.astype(float), "sum": a - b, "constant": 1.0, "c": rng.normal(size=40)})
    columns = list(frame)
    want, rank = [], 1
    for name in columns:
        found = np.linalg.matrix_rank(np.column_stack([np.ones(40), frame[[*want, name]]]))
        if found > rank:
            want, rank = [*want, name], found
    assert stats.independent_columns(spark.createDataFrame(frame), columns) == want == ["a", "b", "c"]


def test_critical_distance_selects_what_each_p_value_does():
    for n, p in ((10, 0.05), (10, 0.001), (12, 0.01), (20, 0.01), (30, 0.001)):
        whole, last = (n**3 - n) // 3, stats.critical_distance(p, n)
        selected = [min(1.0, 2 * stats.spearman_p(whole - d, n)) < p for d in range(whole // 2 + 1)]
        assert selected == [d <= last for d in range(whole // 2 + 1)]


def test_small_samples_use_every_order():
    from itertools import permutations

    for n in (4, 6):
        d = [sum((a - b) ** 2 for a, b in enumerate(o)) for o in permutations(range(n))]
        tail, whole = stats.exact_tail(n), (n**3 - n) // 3
        assert all(tail(k) == pytest.approx(sum(x >= k for x in d) / len(d)) for k in range(whole + 2))
        best = max((k for k in range(whole // 2 + 1) if min(1.0, 2 * tail(whole - k)) < 0.1), default=-1)
        assert stats.critical_distance(0.1, n) == best
    assert stats.critical_distance(0.01, 9) >= 0 and stats.critical_distance(0.01, 3) == -1


def test_checkpoint_or_empty(spark, tmp_path):
    from edgeloom.sources import readers

    path = str(tmp_path / "done")
    assert readers.checkpoint_or_empty(spark, path, "k long, r double").count() == 0
    spark.createDataFrame([(1, 0.5)], "k long, r double").write.parquet(path)
    assert readers.checkpoint_or_empty(spark, path, "k long, r double").count() == 1
    with pytest.raises(ValueError, match="other columns"):
        readers.checkpoint_or_empty(spark, path, "k long, p double")


def test_bias_corrected_interval_equals_numpy(spark):
    rng = random.Random(5)
    reps = [rng.gauss(0.3, 0.1) for _ in range(400)]
    jack = [0.3 + rng.gauss(0, 0.01) ** 2 for _ in range(50)]
    table = lambda xs: spark.createDataFrame([("o", float(x)) for x in xs], "outcome string, r double")
    row = stats.bias_corrected(table(reps), table([0.31]), table(jack), ["outcome"]).first()
    gap = np.mean(jack) - np.array(jack)
    a, n = (gap**3).sum() / (6 * (gap**2).sum() ** 1.5), NormalDist()
    z0 = n.inv_cdf(np.mean(np.array(reps) < 0.31))
    for name, share in (("low", 0.025), ("high", 0.975)):
        z = n.inv_cdf(share)
        for column, at in ((name, share), (f"bca_{name}", n.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))))):
            assert row[column] == pytest.approx(np.quantile(reps, at, method="hazen"), abs=1e-9)
    one_side = stats.bias_corrected(table([0.1, 0.2]), table([0.5]), table(jack), ["outcome"]).first()
    assert one_side["bca_low"] == one_side["bca_high"] == 0.2


def test_transfer_equals_loops(spark):
    rng = np.random.default_rng(11)
    n, edges, cut = 14, 5, stats.critical_r(0.1, 14 - 3)
    x = {c: rng.normal(size=(n, edges)) for c in ("train", "first", "second")}
    y = {c: x[c][:, 0] - x[c][:, 1] + rng.normal(size=n) for c in x}
    long = [(c, p, e, float(x[c][p, e])) for c in x for p in range(n) for e in range(edges)]
    table = spark.createDataFrame(long, "condition string, person long, edge_id int, value double")
    scores = spark.createDataFrame([(1, c, p, float(y[c][p])) for c in y for p in range(n)], "iter int, condition string, person long, y double")
    train = table.filter("condition = 'train'").drop("condition")
    outcome = scores.filter("condition = 'train'").drop("condition")
    masks = transfer.left_out_masks(train, outcome, [0.1], n)
    got = transfer.transfer(masks, train, outcome, table.filter("condition <> 'train'"), scores.filter("condition <> 'train'"), [0.1]).collect()
    predicted = {c: np.zeros((n, 3)) for c in ("first", "second")}
    for held in range(n):
        keep = np.arange(n) != held
        r = np.array([np.corrcoef(x["train"][keep, e], y["train"][keep])[0, 1] for e in range(edges)])
        sums = lambda m: np.column_stack([m[:, r > cut].sum(1), m[:, r < -cut].sum(1)])  # noqa: E731,B023
        for k, use in enumerate(([0], [1], [0, 1])):
            design = np.column_stack([sums(x["train"])[:, use], np.ones(n)])
            b = np.linalg.pinv(design[keep]) @ y["train"][keep]
            for c in predicted:
                predicted[c][held, k] = np.r_[sums(x[c])[held, use], 1] @ b
    for row in got:
        k = ["positive", "negative", "combined"].index(row["model"])
        both = [row["condition"]] if row["condition"] != "pooled" else ["first", "second"]
        p, t = np.concatenate([predicted[c][:, k] for c in both]), np.concatenate([y[c] for c in both])
        assert row["mse"] == pytest.approx(((p - t) ** 2).mean(), abs=1e-8)
        assert row["r"] == pytest.approx(np.corrcoef(p, t)[0, 1], abs=1e-7)
    assert len(got) == 9


def test_least_norm_where_predictors_are_collinear(spark):
    rows = [(1, float(i), 2.0 * i, 3.0 * i + 1) for i in range(6)] + [(2, 4.0, 0.0, float(i)) for i in range(5)]
    strength = spark.createDataFrame(rows, "g int, pos double, neg double, y double")
    got = {r["g"]: r for r in transfer.fit_min_norm(strength, ["g"], F.lit(True)).collect()}
    for g in (1, 2):
        m = np.array([r[1:] for r in rows if r[0] == g])
        want = np.linalg.pinv(np.column_stack([m[:, :2], np.ones(len(m))])) @ m[:, 2]
        assert [got[g]["cp"], got[g]["cn"], got[g]["ac"]] == pytest.approx(list(want), abs=1e-8)
    assert got[2]["bn"] == pytest.approx(0) and got[2]["an"] == pytest.approx(2)


def test_enrichment_of_an_empty_mask(spark):
    pairs = spark.createDataFrame([(0, 3), (1, 4)], "pair long, capacity long")
    edge_pairs = spark.createDataFrame([(7, 1)], "edge_id int, pair long")
    masks = spark.createDataFrame([(2, 7)], "iter int, edge_id int")
    counts = networks.pair_counts(masks, edge_pairs, pairs, 3)
    rows = networks.enrichment(counts).orderBy("pair").collect()
    assert [(r["edges"], r["ratio"], r["p"], r["q"]) for r in rows] == [(0, None, 1.0, 1.0)] * 2
    total = networks.mask_totals(counts).first()
    assert (total["edges"], total["mean"], total["empty"], total["p"]) == (0, 0.5, 1, 1.0)


def test_blocks_keep_to_themselves(spark):
    s = spark.createDataFrame([(i, "a" if i < 4 else "b", float(i * i), float(i % 3)) for i in range(10)], "subject_row long, block string, y double, age double")
    order = plans.permutations(s, 3, by=("block",))
    block = {r["subject_row"]: r["block"] for r in s.collect()}
    assert all(block[r["subject_row"]] == block[r["source_row"]] for r in order.collect())
    first = plans.freedman_lane(s.withColumn("o", F.lit(1)), order, "age", ["o"]).filter("iter = 1").collect()
    assert {r["subject_row"]: round(r["y"], 9) for r in first} == {i: float(i * i) for i in range(10)}


def test_partition_seeds_agree_with_folds(spark):
    s = spark.range(23).withColumnRenamed("id", "subject_row")
    one = {tuple(r) for r in plans.folds(s, 5, 124).collect()}
    assert {(r["subject_row"], r["fold"]) for r in plans.partitions(s, 5, 123, 125).filter("seed = 124").collect()} == one


def test_audits(spark):
    t = lambda rows: spark.createDataFrame(rows, "k string, v double")
    a, b = t([("x", 1.0), ("y", None), ("z", 2.0), ("z", 2.0)]), t([("x", 1.0 + 1e-13), ("y", None), ("w", 3.0)])
    assert {(r["k"], r["side"]) for r in audits.differing_rows(a, t([("z", 2.0)])).collect()} == {("x", "first"), ("y", "first"), ("z", "first")}
    assert sorted(r["k"] for r in audits.beyond_tolerance(a, b, ["k"], ["v"]).collect()) == ["w", "z", "z"]
    settings = lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    changed = audits.incompatible(settings({"folds": "10", "workers": "5", "gone": "1"}), settings({"folds": "10", "workers": "8"}), ["workers"])
    assert [r["key"] for r in changed.collect()] == ["gone"]
    records = spark.createDataFrame([("a", 1, "RUNNING"), ("a", 2, "COMPLETE"), ("b", 1, "COMPLETE"), ("c", 1, None)], "run string, n int, status string")
    gaps = audits.release_gaps(records, spark.createDataFrame([("a",), ("c",)], "run string"), "run", "n", "status", "COMPLETE")
    assert sorted(r["run"] for r in gaps.collect()) == ["b", "c"]
    checks = audits.verdict({"fine": a.filter("false"), "bad": a})
    with pytest.raises(ValueError, match="bad"):
        audits.assert_ok(checks)
    audits.assert_ok(checks.filter("name = 'fine'"))


def test_exact_ends_equal_enumeration_for_all_patterns_of_ties():
    """Every pair of patterns of up to six ranks against all orders; patterns of seven and eight against the untied one and a drawn one."""
    from itertools import permutations

    def patterns(n):
        for cuts in range(2 ** (n - 1)):
            groups, start = [], 0
            for i in range(1, n + 1):
                if i == n or cuts >> (i - 1) & 1:
                    groups += [start + i + 1] * (i - start)  # twice the mean rank of places start + 1 to i
                    start = i
            yield tuple(groups)

    draw = np.random.default_rng(5)
    for n in range(2, 9):
        orders = np.array(list(permutations(range(n))))
        every = list(patterns(n))
        seconds = every if n < 7 else [every[-1], every[draw.integers(len(every))]]
        for first in every:
            for second in seconds:
                d = ((np.array(first) - np.array(second)[orders]) ** 2).sum(1) / 4
                values, counts = np.unique(d, return_counts=True)
                below = np.cumsum(counts)
                p = np.minimum(1, 2 * np.minimum(below, len(d) - below + counts) / len(d))
                for level in (0.05, 0.2):
                    near, far = stats.exact_ends(first, second, level)
                    assert ((values <= near) | (values >= far)).tolist() == (p < level - 1e-12).tolist()


def test_rank_selection_branches(spark):
    n, p = 20, 0.05
    whole = (n**3 - n) / 3
    rows = [(whole / 2, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (whole, -1.0, 0.0, 0.0), (5.0, 0.9, 3.0, 0.0), (5.0, 0.1, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "distance double, rho double, edge_ties double, y_ties double")
    assert [r["selected"] for r in stats.rank_selection(df, p, n).collect()] == [False, True, True, True, False]
    assert math.isfinite(stats.critical_r(p, n - 2))


def test_files_and_owners(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    got = audits.preferred_file(files([("a", "1"), ("b", "2")]), files([("old_a", "1"), ("old_c", "3")]), {"a": "old_a", "c": "old_c"})
    assert {tuple(r) for r in got.collect()} == {("a", "1", "current"), ("b", "2", "current"), ("c", "3", "legacy")}
    with pytest.raises(ValueError, match="differ"):
        audits.preferred_file(files([("a", "1")]), files([("old_a", "9")]), {"a": "old_a"})
    owned = audits.owning_directory(spark.createDataFrame([("x/y/z/f",), ("x/q/f",), ("f",)], "source string"), spark.createDataFrame([("x",), ("x/y",)], "directory string"))
    assert {tuple(r) for r in owned.collect()} == {("x/y/z/f", "x/y"), ("x/q/f", "x"), ("f", None)}


def test_stored_q_is_checked(spark):
    p = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04)], "family string, k int, p double")
    derived = audits.with_q(p, "p", ["family"], ["k"])
    assert {r["k"]: r["q"] for r in derived.collect()} == pytest.approx({1: 0.02, 2: 0.04})
    assert audits.with_q(derived, "p", ["family"], ["k"]).count() == 2
    with pytest.raises(ValueError, match="q differs"):
        audits.with_q(derived.withColumn("q", F.lit(0.5)), "p", ["family"], ["k"])


def test_partial_correlations_equal_residuals(spark):
    rng = np.random.default_rng(4)
    n, edges = 40, 3
    z = np.column_stack([rng.normal(40, 9, n), rng.integers(0, 2, n), np.full(n, 3.0)])
    x, y, fold = rng.normal(size=(n, edges)) + z[:, :1] / 10, rng.normal(size=n) + z[:, 0] / 20 + z[:, 1], np.arange(n) % 4
    x[:, 2] = 2 * z[:, 0] - z[:, 1]
    table = spark.createDataFrame([(i, e, float(x[i, e])) for i in range(n) for e in range(edges)], "subject_row long, edge_id int, value double")
    outcome = spark.createDataFrame([(1, i, int(fold[i]), float(y[i])) for i in range(n)], "iter int, subject_row long, fold int, y double")
    covariates = spark.createDataFrame([(i, *map(float, z[i])) for i in range(n)], "subject_row long, age double, sex double, constant double")
    got = adjusted.fold_partial_correlations(table, outcome, covariates, ["age", "sex", "constant"]).collect()
    assert len(got) == 4 * edges
    for row in got:
        keep = fold != row["fold"]
        design = np.column_stack([np.ones(keep.sum()), z[keep, :2]])
        rest = lambda v: v - design @ np.linalg.lstsq(design, v, rcond=None)[0]  # noqa: E731,B023
        assert (row["n"], row["rank"]) == (30, 2)
        if row["edge_id"] == 2:
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(np.corrcoef(rest(x[keep, row["edge_id"]]), rest(y[keep]))[0, 1], abs=1e-8)


def test_ranks_of_large_groups_equal_windows(spark):
    """Range partitions against one window a group: ties, nulls in `by`, a group that holds most rows, more partitions than values."""
    from edgeloom.functions import ranks

    draw = np.random.default_rng(4)
    rows = [(None if k % 11 == 0 else "big" if k % 7 else f"g{k % 3}", k, float(draw.integers(1, 40)) / 40) for k in range(600)]
    df = spark.createDataFrame(rows, "family string, k long, p double")
    slow = {r.k: r.q for r in stats.benjamini_hochberg(df, "p", ["family"], ["k"]).collect()}
    for partitions in (1, 7, 40):
        fast = {r.k: r.q for r in ranks.benjamini_hochberg(df, "p", ["family"], ["k"], partitions=partitions).collect()}
        assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k], abs=1e-15) for k in slow)
        numbers = ranks.numbered(df, ["family"], ["p", "k"], partitions).collect()
        for family in {r.family for r in numbers}:
            own = sorted((r for r in numbers if r.family == family), key=lambda r: (r.p, r.k))
            assert [r["__number"] for r in own] == list(range(1, len(own) + 1)) and {r["__size"] for r in own} == {len(own)}
        shares = [0.025, 0.5, 0.975]
        a = {r.family: r for r in stats.hazen_at_scale(df, "p", ["family"], shares).collect()}
        b = {r.family: r for r in ranks.hazen(df, "p", ["family"], shares, partitions).collect()}
        assert a.keys() == b.keys() and all(tuple(a[f])[1:] == pytest.approx(tuple(b[f])[1:]) for f in a)
    assert len({r["__part"] for r in ranks.numbered(df, ["family"], ["p", "k"], 40).collect() if r.family == "big"}) > 10
    assert ranks.benjamini_hochberg(df.limit(0), "p", ["family"], ["k"]).count() == 0


@pytest.mark.parametrize("block", [2_048, 5])
def test_transfer_in_matrix_form(spark, block):
    """Masks, fits and tests of left-out models by matrices equal the relational form, in one block of edges and in several."""
    draw = np.random.default_rng(9)
    n, edges, iters = 18, 14, 3
    x = {c: draw.normal(size=(n, edges)) for c in ("train", "a", "b")}
    y = {c: x[c][:, :3].sum(1) + draw.normal(size=n) for c in x}
    x["train"][:, 6] = 2.5  # never selected
    cells = spark.createDataFrame([(c, p, e, float(x[c][p, e])) for c in x for p in range(n) for e in range(edges)], "condition string, person long, edge_id long, value double")
    orders = [np.arange(n), *(draw.permutation(n) for _ in range(iters - 1))]
    scores = spark.createDataFrame([(i + 1, c, p, float(y[c][o[p]])) for i, o in enumerate(orders) for c in x for p in range(n)], "iter int, condition string, person long, y double")
    train, outcome = cells.filter("condition = 'train'").drop("condition"), scores.filter("condition = 'train'").drop("condition")
    tests, test_cells, levels = scores.filter("condition <> 'train'"), cells.filter("condition <> 'train'"), [0.2, 0.02]
    slow = transfer.transfer(transfer.left_out_masks(train, outcome, levels, n), train, outcome, test_cells, tests, levels).collect()
    fast = transfer.block_transfer(train, outcome, test_cells, tests, levels, block).collect()
    key = lambda r: (r.threshold, r.iter, r.condition, r.model)
    a, b = ({key(r): (r.r, r.mse, r.baseline_mse) for r in rows} for rows in (slow, fast))
    assert a.keys() == b.keys() and len(a) == 2 * iters * 3 * 3
    for k in a:
        assert b[k] == pytest.approx(a[k], abs=1e-9) or (a[k][0] is None and b[k][0] is None)


def test_freedman_lane_of_a_design_equals_numpy(spark):
    draw = np.random.default_rng(6)
    rows = [(o, k, float(k % 3 == 1), float(k % 3 == 2), float(3 - 2 * (k % 3 == 1) - (k % 3 == 2)), float(draw.normal()), 1.0, float(draw.normal())) for o in ("u", "v") for k in range(40) if o == "u" or k >= 10]
    names = ["s2", "s3", "site", "age", "one"]
    df = spark.createDataFrame(rows, "outcome string, subject_row long, s2 double, s3 double, site double, age double, one double, y double")
    blocks = spark.createDataFrame([(k, "extra" if k < 10 else "shared") for k in range(40)], "subject_row long, block string")
    order = plans.permutations(blocks, 4, by=("block",))
    made = {(r.outcome, r.iter, r.subject_row): r.y for r in plans.freedman_lane(df, order, names, ["outcome"]).collect()}
    assert {r["rank"] for r in plans.fitted_values(df, names, ["outcome"]).collect()} == {3}
    source = {(r.iter, r.subject_row): r.source_row for r in order.collect()}
    for o in ("u", "v"):
        own = [r for r in rows if r[0] == o]
        a, y = np.array([[1.0, *r[2:7]] for r in own]), np.array([r[7] for r in own])
        fitted = a @ np.linalg.lstsq(a, y, rcond=None)[0]
        at = {r[1]: i for i, r in enumerate(own)}
        for (i, subject), s in source.items():
            if subject in at:
                assert made[o, i, subject] == pytest.approx(fitted[at[subject]] + y[at[s]] - fitted[at[s]], abs=1e-9)
    assert all(made[r[0], 1, r[1]] == pytest.approx(r[7]) for r in rows)


def test_intervals_of_clusters(spark):
    """Draws of people keep all their rows; the jackknife leaves a person out; bias-corrected ends follow printed normal quantiles."""
    from edgeloom import whole_queries as whole

    draw = np.random.default_rng(7)
    rows = [(8, k // (1 + k % 2), float(draw.normal()), float(draw.normal())) for k in range(60)]
    df = spark.createDataFrame(rows, "edge_id long, person long, value double, y double")
    people = sorted({r[1] for r in rows})
    drawn = plans.bootstraps(df.selectExpr("person AS subject_row").distinct(), 30).collect()
    reps = {r.replicate: r.r for r in whole.cluster_replicates(df, "person", ["edge_id"], 30).collect()}
    for k in reps:
        picked = [r for d in drawn if d.replicate == k for r in rows if r[1] == d.subject_row]
        assert reps[k] == pytest.approx(np.corrcoef([r[2] for r in picked], [r[3] for r in picked])[0, 1])
    left = {r.person: r.r for r in whole.cluster_left_out(df, "person", ["edge_id"]).collect()}
    assert sorted(left) == people
    for p in people:
        kept = [r for r in rows if r[1] != p]
        assert left[p] == pytest.approx(np.corrcoef([r[2] for r in kept], [r[3] for r in kept])[0, 1])
    # replicates 0.001, 0.002, ...: 841 of 1000 below the point give z0 = 1 (printed: 0.8413), no acceleration; ends are those of 0.5160 and 0.9999
    flat = spark.createDataFrame([(1, k / 1000) for k in range(1, 1001)], "edge_id long, r double")
    point, same = spark.createDataFrame([(1, 0.8413)], "edge_id long, r double"), spark.createDataFrame([(1, 0.1), (1, 0.1)], "edge_id long, r double")
    found = stats.bias_corrected(flat, point, same, ["edge_id"]).first()
    z0 = 0.9986  # of 0.841
    printed = {0.0372: 0.5148, 3.9572: 0.99996}  # 2 z0 - 1.96 and 2 z0 + 1.96 in a table of the normal distribution
    assert [round(2 * z0 + s * 1.96, 4) for s in (-1, 1)] == list(printed)
    assert (found.bca_low, found.bca_high) == pytest.approx(tuple(v + 0.0005 for v in printed.values()), abs=1e-3)


def test_layout_of_edges_takes_each_branch(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(9, 4, 4))
    even = (base + base.transpose(0, 2, 1)) / 2
    even[:, range(4), range(4)] = 1.0

    def layout(x, kind):
        cells = spark.createDataFrame([(s, i, j, float(x[s, i, j])) for s in range(len(x)) for i in range(4) for j in range(4)], "subject_row long, node_i long, node_j long, value double")
        made, divisor = networks.edge_layout(cells, kind)
        return {(r.subject_row, r.node_i, r.node_j): (r.correlated, r.summed) for r in made.collect()}, divisor

    near = even.copy()
    near[:, 2, 1] += 1e-14
    far = even.copy()
    far[4, 2, 1] += 1e-9
    bent, uneven = even.copy(), even.copy()
    for i in range(4):
        for j in range(i):
            bent[:, i, j] = np.exp(even[:, i, j])
    uneven[3, 2, 2] = 1.5
    for x, kind, unique in ((even, "pearson", True), (near, "pearson", True), (far, "pearson", False), (bent, "pearson", False), (bent, "spearman", True), (uneven, "pearson", False), (base, "spearman", False)):
        found, divisor = layout(x, kind)
        assert (divisor, len(found)) == ((1, 9 * 6) if unique else (2, 9 * 16))
        for (s, i, j), (correlated, summed) in found.items():
            mean = (x[s, i, j] + x[s, j, i]) / 2
            assert (correlated, summed) == ((x[s, i, j] if kind == "spearman" else mean, mean) if unique else (x[s, i, j], x[s, i, j]))
