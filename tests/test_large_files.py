"""Manifests of files that do not fit into a row of Spark's binary reader; small limits stand for its 2 GB."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from edgeloom.functions import resumable
from edgeloom.sources import runs


@pytest.fixture
def limits(spark, monkeypatch):
    """Ranges of 16 KB at most; the binary reader refuses files over 64 KB."""
    monkeypatch.setattr(runs, "RANGE", 32 << 10, raising=False)
    held = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.sources.binaryFile.maxLength": str(64 << 10), "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k in held:
        spark.conf.unset(k)


def found(spark, folder):
    return {r.path: (r.bytes, r.sha256) for r in runs.manifest(spark, str(folder), []).collect()}


def test_files_larger_than_a_row(limits, tmp_path):
    noise = random.Random(3).randbytes(100_000)  # noqa: S311
    files = {
        "noise.bin": noise, "ended.bin": noise + b"\n", "ended twice.bin": noise + b"\n\n", "marked.csv": b"\xef\xbb\xbf" + noise.replace(b"\n", b"\r\n"), "marked, ended.csv": b"\xef\xbb\xbf" + noise + b"\n",
        "a=1/[x]{y} 50%41.bin": b"\n" + noise, "lines.txt": b"\n" * 70_000, "one line.bin": bytes(60_000), "a=1/long line.bin": noise[:30_000] + bytes(25_000) + noise[30_000:], "small.bin": noise[:1000], "a x.bin": noise[:40_000],
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert found(limits, tmp_path) == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}


def test_names_that_say_compressed_are_read_as_they_lie(limits, tmp_path):
    limits.conf.set("spark.sql.sources.binaryFile.maxLength", str(1 << 20))
    noise = random.Random(4).randbytes(100_000)  # noqa: S311
    files = {"t.csv.gz": gzip.compress(noise), "not packed.bz2": noise, "u.bin": noise}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    assert found(limits, tmp_path) == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}


def test_lines_longer_than_a_range_of_rows_are_read_whole(limits, tmp_path):
    limits.conf.set("spark.sql.sources.binaryFile.maxLength", str(1 << 20))
    noise = random.Random(6).randbytes(100_000)  # noqa: S311
    files = {f"{at}.bin": noise[:at] + bytes(60_000) + noise[at:] for at in (0, 20_000, 50_000, 99_990, 100_000)} | {"ended.bin": noise + bytes(60_000) + b"\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    assert found(limits, tmp_path) == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
    assert all(runs._by_ranges(limits, f"file:{tmp_path / n}", len(c)) is None for n, c in files.items())


def test_no_task_reads_a_whole_file(limits, tmp_path):
    """A file of 20 ranges or more takes as many jobs, each of the next range alone."""
    lines = b"".join(b"%07d\n" % k for k in range(40_000))
    (tmp_path / "t.csv").write_bytes(lines)
    assert len(lines) == 320_000
    read, plain = [], limits.sparkContext.runJob
    assert limits.read.text(str(tmp_path / "t.csv"), lineSep="\n").rdd.getNumPartitions() >= 20

    def counted(rdd, function, partitions):
        read.append(partitions)
        return plain(rdd, function, partitions)

    limits.sparkContext.runJob = counted
    try:
        assert found(limits, tmp_path) == {"t.csv": (320_000, hashlib.sha256(lines).hexdigest())}
    finally:
        del limits.sparkContext.runJob
    assert len(read) >= 20 and all(len(p) == 1 for p in read) and [p[0] for p in read] == list(range(len(read)))


def test_a_state_taken_up_again():
    noise = random.Random(5).randbytes(1000)  # noqa: S311
    for cut in (0, 1, 55, 63, 64, 65, 999, 1000):
        first = resumable.Sha256().update(noise[:cut])
        again = resumable.Sha256(first.state).update(noise[cut:])
        assert first.hexdigest() == hashlib.sha256(noise[:cut]).hexdigest() and again.hexdigest() == hashlib.sha256(noise).hexdigest()


def test_without_openssl_files_are_read_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "RANGE", 10)
    monkeypatch.setattr(resumable, "library", lambda: None)
    (tmp_path / "t.csv").write_bytes(b"a\nb\n" * 100)
    assert found(spark, tmp_path) == {"t.csv": (400, hashlib.sha256(b"a\nb\n" * 100).hexdigest())}
