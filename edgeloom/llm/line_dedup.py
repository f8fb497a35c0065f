"""Line deduplication: documents probe sharded minimal perfect hashes of repeated lines.

A line's key is the line without spaces at its ends and with A-Z lower-cased. Keys of at least `least` code points that at
least two documents hold lose all their lines but those in the smallest doc_id that holds them.

1. A map hashes the distinct keys of each document to 128 bits; an aggregate with map-side combine keeps each key's smallest
   and largest doc_id and count. Keys of one document need no entry: a probe that finds no fingerprint keeps its line.
2. Keys are dealt by hash into shards, each built into a minimal perfect hash (cascaded bit vectors) with arrays of fingerprints,
   counts and keepers. There are as many shards as keep both a shard's keys and the probes of a shard of average load few.
3. Probes (16 bytes of hash and a doc_id, never lines) stream past their shard's arrays, one shard in memory at a time. A shard
   that draws far more probes than others, as one with a line of every third document, has its small arrays copied to several
   tasks, among which doc_ids are dealt; at most HOT shards can stand above that load, and only their numbers reach the driver.
4. Hits return to their documents, which drop these lines.

Rows of one doc_id count as one document. A null doc_id is not compared and keeps all lines. A null text stays null and counts as one empty line.
Input columns n_lines and n_dropped are replaced, all others pass; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written
from .textops import mix

#: Shards that may be copied, at most; keys and probes of a shard (about); shards dealt to a task.
HOT, KEYS, PROBES, EACH = 10_000, 100_000, 1_000_000, 4
_U = np.uint64


def line_digests(text: str, least: int) -> list[bytes | None]:
    """Of each line: the 16-byte digest of its key, None where the key is too short."""
    found: list[bytes | None] = []
    for line in text.encode().lower().split(b"\n"):  # bytes.lower() changes A-Z alone
        key = line.strip()  # of bytes: \x20 and \x09-\x0D
        size = len(key)
        long = size >= least and (size >= 4 * least or len(key.decode()) >= least)
        found.append(xxhash.xxh3_128_digest(key) if long else None)
    return found


class PerfectHash:
    """Bits of cascaded levels: a key's place is the rank of its bit. Distinct keys get 0..n-1; others get any place or -1."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.rank = np.r_[0, np.cumsum(np.unpackbits(bits, bitorder="little"))]

    @staticmethod
    def _at(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h1 ^ mix(h2 + _U(level))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        found, sizes = [], []
        while len(h1):
            size = -(-2 * len(h1) // 64) * 64
            at = cls._at(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            found.append(alone)
            sizes.append(size)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(np.packbits(np.concatenate(found) if found else np.zeros(0, bool), bitorder="little"), np.array(sizes, np.int64))

    def place(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        place = np.full(len(h1), -1, np.int64)
        open_, base = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + self._at(h1[open_], h2[open_], level, size)
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            place[open_[hit]] = self.rank[at[hit]]
            open_, base = open_[~hit], base + size
        return place


def _shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Grouped mapper: a shard's keys to its arrays."""
    h1, h2 = (frame[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    table = PerfectHash.build(h1, h2)
    order = np.empty(len(h1), np.int64)
    order[table.place(h1, h2)] = np.arange(len(h1))
    arrays = [table.bits, table.sizes, h2[order], frame["lo"].to_numpy(np.int64)[order], frame["n"].to_numpy(np.int64)[order]]
    return pd.DataFrame({"shard": [frame["shard"].iloc[0]], **{f"a{k}": [a.tobytes()] for k, a in enumerate(arrays)}})


def _holdings(least: int):
    """Mapper: (doc_id, h1, h2) of each document's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        counts: list[int] = []
        keys: list[bytes] = []

        def full() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), counts)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["doc_id", "h1", "h2"])
            ids.clear(), counts.clear(), keys.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if doc is None or not text.is_valid:
                    continue
                mine = set(line_digests(text.as_py(), least))
                mine.discard(None)
                if mine:
                    ids.append(doc), counts.append(len(mine)), keys.extend(mine)
                    if len(keys) > 100_000:
                        yield full()
        if keys:
            yield full()

    return run


def _probe(holders: int):
    """Mapper over rows sorted by shard and copy, its arrays first: the (doc_id, h1, h2) that their documents lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table, arrays = None, None, []
        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "copy")], 1)
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)]) if len(cell) else np.zeros(0, np.int64)
            for a, b in zip(cuts, np.r_[cuts[1:], len(cell)], strict=True):
                part, own = batch.slice(a, b - a), tuple(cell[a])
                if part.column("a0")[0].is_valid:
                    raw = [part.column(f"a{k}")[0].as_py() for k in range(5)]
                    table = PerfectHash(np.frombuffer(raw[0], np.uint8), np.frombuffer(raw[1], np.int64))
                    arrays = [np.frombuffer(raw[2], np.uint64), np.frombuffer(raw[3], np.int64), np.frombuffer(raw[4], np.int64)]
                    held, part = own, part.slice(1)
                if held != own or not len(part):
                    continue  # a shard without arrays has no repeated line
                doc, h1, h2 = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "h1", "h2"))
                place = table.place(h1.view(np.uint64), h2.view(np.uint64))
                fingerprint, keeper, count = (x[place] for x in arrays)
                lost = (place >= 0) & (fingerprint == h2.view(np.uint64)) & (count >= holders) & (keeper != doc)
                if lost.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[lost]) for x in (doc, h1, h2)], names=["doc_id", "h1", "h2"])

    return run


def _rewrite(least: int, names: list[str]):
    """Mapper: documents without the lines they lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, lost in zip(batch.column("text"), batch.column("__lost"), strict=True):
                raw = text.as_py()
                if raw is None:
                    kept.append(None), lines.append(1), dropped.append(0)
                    continue
                gone = set(lost.as_py() or ())
                n = raw.count("\n") + 1
                lines.append(n)
                if gone:
                    rows = [r for r, d in zip(raw.split("\n"), line_digests(raw, least), strict=True) if d not in gone]
                    raw, n = "\n".join(rows), n - len(rows)
                kept.append(raw), dropped.append(n if gone else 0)
            own = {"text": pa.array(kept, pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c) for c in names], names=names)

    return run


def _lost(slim: DataFrame, least: int, holders: int) -> DataFrame:
    """(doc_id, h1, h2): the keys whose lines a document loses."""
    spark = slim.sparkSession
    held = slim.mapInArrow(_holdings(least), "doc_id long, h1 long, h2 long")
    counted = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    # n counts rows: a key held twice by rows of one doc_id alone is not repeated, so lo < hi decides
    counted = written(counted.select("h1", "h2", "lo", "n", (F.col("lo") < F.col("hi")).alias("repeated")), "lines")
    totals = counted.agg(F.sum(F.col("repeated").cast("long")).alias("keys"), F.sum("n").alias("probes")).first()
    keys, probes = totals.keys or 0, totals.probes or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-probes // PROBES))
    shards = max(EACH * tasks, -(-keys // KEYS))
    counted = counted.withColumn("shard", F.pmod("h1", F.lit(shards)))
    # a shard above the second mean is copied; above a HOT-th of all probes stand HOT shards at most, whatever the input
    least_load = max(2 * probes / shards, probes / HOT)
    loads = counted.groupBy("shard").agg(F.sum("n").alias("n")).filter(F.col("n") > least_load).collect()
    copies = {int(r.shard): -(-int(r.n) * shards // probes) for r in loads}
    many = F.lit(1).cast("long")
    if copies:
        pairs = spark.createDataFrame(sorted(copies.items()), "shard long, copies long")

    def copied(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(pairs), "shard", "left").fillna(1, "copies") if copies else df.withColumn("copies", many)

    arrays = [f"a{k}" for k in range(5)]
    index = counted.filter("repeated").groupBy("shard").applyInPandas(_shard, "shard long, " + ", ".join(f"{a} binary" for a in arrays))
    index = copied(written(index, "index")).select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), *arrays)
    asked = copied(held.withColumn("shard", F.pmod("h1", F.lit(shards)))).withColumn("copy", F.pmod(F.xxhash64("doc_id"), "copies")).drop("copies")
    both = asked.unionByName(index, allowMissingColumns=True)
    return both.repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("a0").isNull()).mapInArrow(_probe(holders), "doc_id long, h1 long, h2 long")


def dedup_lines(docs: DataFrame, least: int = 10, holders: int = 2) -> DataFrame:
    """docs with the kept lines as text, and n_lines and n_dropped, which replace input columns of these names.

    least: code points of a key that is compared; holders: rows that must hold a key before its lines are dropped.
    """
    docs = small_batches(docs).drop("n_lines", "n_dropped", "__lost")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("h1", "h2"))))
    by_doc = _lost(slim, least, holders).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(digest).alias("__lost")).withColumn("__zero", F.lit(0).cast("long"))
    names = [*docs.columns, "n_lines", "n_dropped"]
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField(c, T.LongType()) for c in names[-2:]]
    # rows without a doc_id lose nothing; a hash of their text deals them out
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    joined = docs.join(by_doc, (F.col("doc_id").cast("long") == F.col("__doc")) & (spread == F.col("__zero")), "left")
    return joined.select(*docs.columns, "__lost").mapInArrow(_rewrite(least, names), T.StructType(fields))
