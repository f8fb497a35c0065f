"""Statistics against closed forms and plain versions; every query against its SQL in DuckDB."""

from __future__ import annotations

import math
import os

from decimal import Decimal

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from edgeloom import queries as core
from edgeloom.functions import stats
from edgeloom.plans import plans

SMALL = "/root/testdata/sf0.01"


def test_critical_r_matches_tables():
    # two-sided critical values of Student's t turned into r
    assert stats.critical_r(0.05, 10) == pytest.approx(2.228139 / math.sqrt(10 + 2.228139**2), abs=1e-6)
    assert stats.critical_r(0.01, 65) == pytest.approx(2.653604 / math.sqrt(65 + 2.653604**2), abs=1e-6)
    assert stats.critical_r(0.01, 0) == 1.0


def test_benjamini_hochberg_golden(spark):
    df = spark.createDataFrame([("f", k, p) for k, p in enumerate([0.01, 0.04, 0.03, 0.20])], "family string, k int, p double")
    q = {r.k: r.q for r in stats.benjamini_hochberg(df, "p", ["family"], ["k"]).collect()}
    assert [q[k] for k in range(4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20], abs=1e-12)


def test_hazen_matches_numpy(spark):
    values = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    r = stats.hazen_at_scale(df, "v", ["g"], [0.025, 0.5, 0.975]).first()
    assert [r.q025, r.q5, r.q975] == pytest.approx(np.quantile(values, [0.025, 0.5, 0.975], method="hazen").tolist())
    assert df.groupBy("g").agg(stats.hazen("v", 0.3).alias("q")).first().q == pytest.approx(np.quantile(values, 0.3, method="hazen"))


def test_overlap_tail_is_hypergeometric():
    exact = sum(math.comb(6, x) * math.comb(14, 5 - x) for x in range(3, 6)) / math.comb(20, 5)
    assert stats.overlap_tail(3, 6, 5, 20) == pytest.approx(-math.log10(exact))
    assert stats.overlap_tail(0, 6, 5, 20) == 0.0


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, k * 1.0) for k in range(4)], "x double, y double")
    assert df.agg(stats.correlation("x", "y").alias("r")).first().r is None


def test_permutations_are_bijections_within_cohorts(spark):
    s = spark.createDataFrame([(k, k % 3) for k in range(30)], "subject_row long, study_id long")
    p = plans.permutations(s, 4, by=("study_id",)).toPandas()
    assert (p[p.iter == 1].subject_row == p[p.iter == 1].source_row).all()
    for _, g in p.groupby("iter"):
        assert sorted(g.source_row) == list(range(30)) and (g.source_row % 3 == g.study_id).all()


def test_larger_samples_hold_smaller_ones(spark):
    s = spark.createDataFrame([(k, k % 3 + 1) for k in range(90)], "subject_row long, study_id long")
    p = plans.nested_sample(s, [9, 30, 60], 2).toPandas()
    for _, g in p.groupby("rep"):
        small, middle, large = (set(g[g["size"] == n].subject_row) for n in (9, 30, 60))
        assert small < middle < large and [len(small), len(middle), len(large)] == [9, 30, 60]


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, name):
    made = core.QUERIES[name](spark, SMALL)
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    found = db.execute(core.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(made.columns) == sorted(columns)
    # rows, not data frames of pandas, which turn whole numbers with nulls into floats
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, Decimal) else v  # noqa: E731,PLR0124
    rows = lambda every: sorted(str([plain(v) for v in r]) for r in every)
    assert rows(made.select(columns).collect()) == rows(found.fetchall())


def test_entry_is_registered(spark):
    assert entry.entry(spark).columns == ["model", "r", "p", "mse", "mse_p"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
