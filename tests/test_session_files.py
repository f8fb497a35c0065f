"""Session logs, pruned bundles, sorts of whole tables, distinct keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from edgeloom.functions import ranks
from edgeloom.operators import audits
from edgeloom.sources import readers, sinks


def test_session_log_keeps_lines_of_failed_sessions(spark, tmp_path):
    path = str(tmp_path / "log")
    with sinks.SessionLog(spark, path, "edgeloom.test") as log:
        log.info("first\nsecond")
        log.debug("too fine")
    with pytest.raises(ZeroDivisionError), sinks.SessionLog(spark, path, "edgeloom.test") as log:
        log.warning("third %d", 3)
        raise ZeroDivisionError("by hand")
    log.info("after")
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["ERROR ZeroDivisionError: by hand", "INFO first", "INFO second", "WARNING third 3"]
    with sinks.SessionLog(spark, str(tmp_path / "none"), "edgeloom.test"):
        pass
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_pruned_bundles_read_the_fields_alone(spark, tmp_path):
    path = str(tmp_path / "bundle")
    spark.range(3).selectExpr("id", "id AS other", "named_struct('r', id * 2, 'p', id, 'deep', named_struct('x', id)) AS results").write.parquet(path)
    made = readers.pruned(spark, path, ["id", "results.r", "results.deep.x"])
    assert sorted(tuple(r) for r in made.collect()) == [(0, 0, 0), (1, 2, 1), (2, 4, 2)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,results:struct<r:bigint,deep:struct<x:bigint>>>" in plan
    with pytest.raises(ValueError, match="lacks results.q, id.x, none"):
        readers.pruned(spark, path, ["id", "results.q", "id.x", "none"])


@pytest.mark.parametrize("partitions", [1, 7])
def test_sorted_rows(spark, partitions):
    rows = [(k % 4 if k % 9 else None, float(k * 7 % 31), k) for k in range(100)]
    df = spark.createDataFrame(rows, "a int, b double, k int")
    found = ranks.sorted_rows(df, ["a", F.desc("b"), "k"], partitions=partitions)
    assert found.columns == ["a", "b", "k", "place"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(found.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in found.collect()) == list(range(1, 101))
    assert ranks.sorted_rows(df.limit(0), ["a", "k"]).count() == 0


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "a"), (None, "a"), (2, None)], "x int, y string")
    found = lambda *keys: {tuple(r) for r in audits.repeated(df, list(keys)).collect()}
    assert found("x") == {(1, 3), (None, 2)} and found("x", "y") == {(1, "b", 2), (None, "a", 2)}
    assert audits.repeated(df.limit(0), ["x"]).count() == 0
