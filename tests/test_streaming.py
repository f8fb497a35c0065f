from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.streaming.upsert import current, latest, upsert_stream, versions


def _stream(spark, tmp_path, table):
    for k in range(4):
        table.filter(f"seq % 4 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_stream_keeps_the_last_record(spark, tmp_path):
    table = spark.createDataFrame([(k % 5, k, f"v{k}") for k in range(40)], "unit long, seq long, value string")
    target = str(tmp_path / "out")
    upsert_stream(_stream(spark, tmp_path, table), target, str(tmp_path / "check"), "unit", "seq", 4).awaitTermination(120)
    found = current(spark, target, table.schema).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, latest(table, "unit", "seq").collect()))
    assert all(len(v) <= 2 for v in versions(spark, target).values())


def test_batches_write_their_own_buckets_and_run_twice(spark, tmp_path):
    """Keys of one batch touch one bucket; all batches again, by a checkpoint that is lost, change nothing."""
    table = spark.createDataFrame([(k % 4 if k < 20 else 100 + k, k, f"v{k}") for k in range(40)], "unit long, seq long, value string")
    target = str(tmp_path / "out")
    stream = _stream(spark, tmp_path, table)
    upsert_stream(stream, target, str(tmp_path / "check"), "unit", "seq", 16).awaitTermination(120)
    wanted = sorted(map(tuple, latest(table, "unit", "seq").collect()))
    assert sorted(map(tuple, current(spark, target, table.schema).collect())) == wanted
    for version in (tmp_path / "out").iterdir():
        held = {int(p.name.split("=")[1]) for p in version.iterdir() if p.name.startswith("__bucket=")}
        own = {r.b for r in table.filter(F.col("seq") % 4 >= 0).select(F.pmod(F.xxhash64("unit"), F.lit(16)).cast("int").alias("b")).distinct().collect()}
        assert held <= own
    upsert_stream(stream, target, str(tmp_path / "again"), "unit", "seq", 16).awaitTermination(120)
    assert sorted(map(tuple, current(spark, target, table.schema).collect())) == wanted
    empty = str(tmp_path / "none")
    assert current(spark, empty, table.schema).count() == 0
