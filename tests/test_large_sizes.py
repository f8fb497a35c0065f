"""What only larger tables show: ranks of many subjects, values between two printed numbers."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from edgeloom import queries as core
from edgeloom.functions import stats
from edgeloom.plans import plans


def test_rank_tails_of_many_subjects():
    # far in the tail the series' term underflows; at 10,256 subjects dividing by its exponential overflowed
    n = 10_256
    whole = (n**3 - n) // 3
    assert stats.spearman_p(whole, n) == 0.0 and stats.spearman_p(0, n) == 1.0
    d = stats.critical_distance(0.01, n)
    rho = 1 - 6 * d / (n**3 - n)
    assert rho == pytest.approx(2.575829 / math.sqrt(n - 1), rel=1e-3)


def test_shares_round_as_printf(spark, tmp_path):
    # 1500 / 100000 is a double below 0.015, 2500 / 100000 above 0.025, 12500 / 100000 is 0.125 itself
    values = [1500.0, 2500.0, 3500.0, 4500.0, 500.0, 12500.0, 0.0]
    spark.createDataFrame([(k, "BUILDING", v) for k, v in enumerate(values)], "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    found = {r.c_custkey: r.share for r in core.QUERIES["p07_label_mapping"](spark, str(tmp_path)).collect()}
    assert [found[k] for k in range(len(values))] == [f"{v / 100000:.2f}".removeprefix("0") for v in values]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert found == {k: share for k, _, share in db.execute(core.SQL["p07_label_mapping"]).fetchall()}


def test_draws_come_from_many_tasks(spark):
    s = spark.range(40).select((F.col("id") * 10).alias("subject_row"))  # its size is known, so people are broadcast and draws stay where they are made
    drawn = plans.bootstraps(s, 50)
    assert drawn.select(F.spark_partition_id()).distinct().count() > 1
    at = lambda r, slot: int(hashlib.md5(f"boot:11:{r}:{slot}".encode()).hexdigest()[:12], 16) % 40  # noqa: E731,S324
    assert sorted(map(tuple, drawn.collect())) == [(r, slot, 10 * at(r, slot)) for r in range(1, 51) for slot in range(40)]
