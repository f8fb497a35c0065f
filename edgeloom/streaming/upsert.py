"""Idempotent upserts of streamed batches: a unit's latest record replaces its earlier ones, and a batch that runs twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BUCKETS = 64


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the record with the largest order."""
    rest = F.struct(*(c for c in records.columns if c != key))
    return records.groupBy(key).agg(F.max_by(rest, order).alias("r")).select(key, "r.*")


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, of whatever kind its address names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _children(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, p = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Versions that hold a bucket, in ascending order, by bucket; those that were written to their end only."""
    found: dict[int, list[int]] = {}
    for v in _children(spark, target, "version="):
        fs, done = _folder(spark, f"{target}/version={v}/_SUCCESS")
        if fs.exists(done):
            for b in _children(spark, f"{target}/version={v}", "__bucket="):
                found.setdefault(b, []).append(v)
    return found


def current(spark: SparkSession, target: str, schema) -> DataFrame:
    """The table: the last version of each bucket."""
    paths = [f"{target}/version={v[-1]}/__bucket={b}" for b, v in versions(spark, target).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str, order: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts the stream; `target`/version=n holds the buckets of keys that batch n touches, made of their last version before n and the batch.

    A batch rewrites those buckets alone; the rest of the table is neither read nor written. A batch that is tried again reads versions before its own only and overwrites
    its own, so each unit counts once. What a bucket had before its last two versions is removed: a retry needs the one before, nothing older. The number of buckets must
    stay the same for a target.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, kept = batch.sparkSession, batch.schema
        fresh = latest(batch, key, order).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = {r[0] for r in fresh.select("__bucket").distinct().collect()}  # `buckets` numbers at most
            if not touched:
                return
            before = {b: [n for n in v if n < number] for b, v in versions(spark, target).items() if b in touched}
            paths = [f"{target}/version={v[-1]}/__bucket={b}" for b, v in before.items() if v]
            rows = fresh.drop("__bucket")
            if paths:
                rows = latest(spark.read.schema(kept).parquet(*paths).unionByName(rows), key, order)
            placed = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            placed.write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/version={number}")
        finally:
            fresh.unpersist()
        for b, v in before.items():
            for old in v[:-1]:
                fs, p = _folder(spark, f"{target}/version={old}/__bucket={b}")
                fs.delete(p, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
