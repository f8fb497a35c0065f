"""Runs that resume and releases made from files."""

from __future__ import annotations

import hashlib
import os

import pytest

from edgeloom import queries as core
from edgeloom import whole_queries as whole
from edgeloom.operators import engine
from edgeloom.sources import runs

SMALL = "/root/testdata/sf0.001"


def test_a_stopped_run_computes_only_the_rest(spark, tmp_path):
    path, asked = str(tmp_path / "run"), []
    rows = lambda df: sorted((r.k, r.unit) for r in df.collect())

    def compute(unit):
        asked.append(unit)
        if unit == 2 and asked.count(2) == 1:
            # rows of an attempt that never ended
            spark.createDataFrame([(99,)], "k int").write.parquet(f"{path}/rows/unit=2")
            raise RuntimeError("stopped")
        return spark.createDataFrame([(10 * unit,), (10 * unit + 1,)], "k int")

    signed = runs.signature({"p": 0.01, "title": "a"}, {"t": spark.range(5)}, [engine.measure])
    with pytest.raises(RuntimeError, match="stopped"):
        runs.resume(spark, path, signed, range(4), compute)
    assert runs.finished(spark, path) == {0, 1}
    found = runs.resume(spark, path, signed, range(4), compute)
    assert asked == [0, 1, 2, 2, 3]
    assert rows(found) == [(10 * u + k, u) for u in range(4) for k in (0, 1)]
    assert rows(runs.resume(spark, path, signed, range(4), compute)) == rows(found) and len(asked) == 5
    with pytest.raises(ValueError, match="other input:t, setting:p$"):
        runs.resume(spark, path, runs.signature({"p": 0.05, "title": "a"}, {"t": spark.range(6)}, [engine.measure]), range(4), compute)
    with pytest.raises(ValueError, match="code:"):
        runs.resume(spark, path, runs.signature({"p": 0.01, "title": "a"}, {"t": spark.range(5)}, [engine.metrics]), range(4), compute)
    other = runs.signature({"p": 0.01, "title": "b"}, {"t": spark.range(5).repartition(3)}, [engine.measure])
    assert rows(runs.resume(spark, path, other, range(4), compute, ("setting:title",))) == rows(found)


def test_permutations_taken_up_again(spark, tmp_path):
    """m11 stopped after one unit gives the rows of m11 in one go; the finished unit is read, not made."""
    path = str(tmp_path / "m11")
    first = whole.permutation_run(spark, SMALL, path, units=1)
    assert {r.iter for r in first.select("iter").distinct().collect()} == set(range(1, 6))
    made = engine.permutation_table(whole.permutation_run(spark, SMALL, path).drop("unit"), [])
    a, b = ({r.model: (r.r, r.p, r.mse, r.mse_p) for r in df.collect()} for df in (made, core.kfold_cpm(spark, SMALL)))
    assert a.keys() == b.keys() and all(a[m] == pytest.approx(b[m], abs=2e-6) for m in a)
    with pytest.raises(ValueError, match="setting:iterations"):
        whole.permutation_run(spark, SMALL, path, iterations=15)


def test_a_release_waits_for_its_gates(spark, tmp_path):
    files = {"tables/a.csv": b"x,y\n1,2\n", "tables/b.csv": b"z\n", "masks/deep/m.bin": bytes(range(256)) * 50, "run record.txt": b"COMPLETE"}
    folder = tmp_path / "out"
    for name, content in files.items():
        os.makedirs(os.path.dirname(folder / name), exist_ok=True)
        (folder / name).write_bytes(content)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    patterns, target = ["tables/*.csv", "masks/**", "run record.txt"], str(tmp_path / "release")
    required = spark.createDataFrame([(n, sha(c)) for n, c in files.items()] + [("run record.txt", None)], "path string, sha256 string")
    found = {r.path: (r.bytes, r.sha256, r.pattern) for r in runs.manifest(spark, str(folder), patterns).collect()}
    assert found == {n: (len(c), sha(c), patterns[0] if n.startswith("t") else patterns[1] if n.startswith("m") else patterns[2]) for n, c in files.items()}

    def problems():
        return {(r.path, r.problem) for r in runs.release_problems(runs.manifest(spark, str(folder), patterns), required).collect()}

    assert problems() == set()
    (folder / "tables/deep").mkdir()
    (folder / "tables/deep/c.csv").write_bytes(b"not allowed: one level only")
    (folder / "tables/a.csv").write_bytes(b"x,y\n1,3\n")
    (folder / "tables/b.csv").rename(tmp_path / "kept.csv")
    assert problems() == {("tables/deep/c.csv", "unlisted"), ("tables/a.csv", "changed"), ("tables/b.csv", "missing")}
    with pytest.raises(ValueError, match="changed: tables/a.csv; missing: tables/b.csv; unlisted: tables/deep/c.csv"):
        runs.assemble(spark, str(folder), target, patterns, required)
    assert not os.path.exists(target)
    (folder / "tables/a.csv").write_bytes(files["tables/a.csv"])
    (tmp_path / "kept.csv").rename(folder / "tables/b.csv")
    (folder / "tables/deep/c.csv").rename(tmp_path / "c.csv")
    made = runs.assemble(spark, str(folder), target, patterns, required)
    assert {(r.path, r.bytes, r.sha256) for r in made.collect()} == {(n, len(c), sha(c)) for n, c in files.items()}
    assert spark.read.option("header", True).csv(f"{target}/MANIFEST").count() == 4
    assert {r.path: bytes(r.content) for r in spark.read.parquet(f"{target}/files").collect()} == files
