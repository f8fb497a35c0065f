"""Runs that resume: units of work are written one by one beside a signature, finished ones are skipped, other settings are refused; and releases made from files."""

from __future__ import annotations

import hashlib
import inspect
import re
import warnings
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import resumable
from .readers import checkpoint_or_empty

UNIT = "unit"
#: Bytes above which a file is hashed range by range.
RANGE = 64 << 20
#: Names of files that Spark's readers of text decompress.
_PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".passthrough")
_MARK = b"\xef\xbb\xbf"  # a byte-order mark, which they drop at the beginning of a file


def signature(settings: dict[str, object], inputs: dict[str, DataFrame], code: Iterable[Callable]) -> dict[str, str]:
    """What a run depends on: each setting, a hash of each input's rows (their order aside) and of each function's source."""
    found = {f"setting:{k}": repr(v) for k, v in settings.items()}
    for name, df in inputs.items():
        columns = sorted(df.columns)
        row = F.xxhash64(*(F.to_json(F.struct(F.col(c).alias("v"))) for c in columns))
        # two sums over one pass: equal tables agree whatever their order
        sums = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("a"), F.bit_xor(row).alias("b")).first()
        found[f"input:{name}"] = f"{','.join(columns)} {sums['n']} {sums['a']} {sums['b']}"
    for f in code:
        found[f"code:{f.__module__}.{f.__qualname__}"] = hashlib.sha256(inspect.getsource(f).encode()).hexdigest()
    return found


def finished(spark: SparkSession, path: str) -> set[int]:
    """Units whose rows are complete: a unit is entered only after its rows are committed."""
    return {r[UNIT] for r in checkpoint_or_empty(spark, f"{path}/done", f"{UNIT} int").distinct().collect()}  # one number a unit


def resume(spark: SparkSession, path: str, signed: dict[str, str], units: Iterable[int], compute: Callable[[int], DataFrame], presentation: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all units, those of unfinished ones computed now and written to path/rows/unit=...

    A unit's rows replace whatever an interrupted attempt left of it (overwrite of its own partition alone), then its number is entered in path/done. A run under
    another signature is refused with the keys that differ; keys in `presentation` may differ. Units are the driver's loop; each is a distributed job.
    """
    held = {r["key"]: r["value"] for r in checkpoint_or_empty(spark, f"{path}/signature", "key string, value string").collect()}
    differ = sorted(k for k in {*held, *signed} if held.get(k) != signed.get(k) and k not in presentation)
    if held and differ:
        raise ValueError(f"the run at {path} was made with other {', '.join(differ)}")
    if not held:
        spark.createDataFrame(sorted(signed.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/signature")
    done, schema = finished(spark, path), None
    for unit in units:
        if unit not in done:
            made = compute(unit)
            schema = made.schema
            made.write.mode("overwrite").parquet(f"{path}/rows/{UNIT}={unit}")
            spark.createDataFrame([(unit,)], f"{UNIT} int").write.mode("append").parquet(f"{path}/done")
    complete = finished(spark, path)
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/{UNIT}={u}" for u in sorted(complete & set(units))))
    return rows if schema is None else rows.select(*schema.names, UNIT)


def _relative(folder: str):
    return F.substring_index(F.col("path"), urlparse(folder).path.rstrip("/") + "/", -1)


def _literal(path: str) -> str:
    """A path as a glob of itself."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _continued(state: bytes, size: int, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What hashes one range: rows (line with the newline before it, end of its range) become one row (state, size, at) of the file as far as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n, last = resumable.Sha256(state), size, at
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = batch.column(1).to_numpy()
            if ends[0] < last or (np.diff(ends) < 0).any():
                raise ValueError("ranges of a file came out of order")
            last = int(ends[-1])
            lines = batch.column(0).cast(pa.large_binary())  # its offsets have 8 bytes whatever the session sets
            _, offsets, data = lines.buffers()
            low, high = np.frombuffer(offsets, np.int64)[[lines.offset, lines.offset + len(lines)]].tolist()
            made.update(data[low + (n < 0) : high])  # the first line of a file has no newline before it
            n += high - low
        yield pa.RecordBatch.from_pydict({"state": pa.array([made.state], pa.binary()), "size": pa.array([n], pa.int64()), "at": pa.array([last], pa.int64())})

    return run


def _by_ranges(spark: SparkSession, path: str, length: int, head: bytes = b"") -> str | None:
    """SHA-256 of a file, or None if Spark's reader changes what it holds or a line has RANGE bytes. Each range is a job of one task, which begins with the state that the one before it gave back (some 150 bytes).

    Ranges are those of Spark's reader of text: at most spark.sql.files.maxPartitionBytes, and up to the next newline. The order of bytes makes the jobs of a file follow each other.
    """
    rows = spark.read.option("mapreduce.input.linerecordreader.line.maxlength", str(RANGE)).text(_literal(path), lineSep="\n")  # the reader passes over longer lines
    end = F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")
    lines = rows.select(F.concat(F.lit(b"\n"), F.col("value").cast("binary")).alias("line"), end.alias("end"))
    state, size, at, each = resumable.Sha256().update(head).state, -1, 0, 0
    for k in range(lines.rdd.getNumPartitions()):
        hashed = lines.mapInArrow(_continued(state, size, at), "state binary, size long, at long").rdd
        ((state, size, at),) = spark.sparkContext.runJob(hashed, list, [k])
        state, each = bytes(state), each or at
        if size < 0 or size + len(_MARK) + 1 < min((k + 1) * each, length):
            return None  # lines so far end before the range does: one was passed over, or the file is unpacked to less
    rest = length - size - len(head)
    if not head and rest in (len(_MARK), len(_MARK) + 1):
        return _by_ranges(spark, path, length, _MARK)
    # a newline at the very end begins no line
    return resumable.Sha256(state).update(b"\n" * rest).hexdigest() if rest in (0, 1) else None


def _hashed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of all files below folder. Those over RANGE are hashed now, several at a time, each in a chain of jobs; the others when the table is read, whole.

    A large file is read whole, too, where its name says that it is compressed, where Spark's reader of text changes it (a line of RANGE bytes), and without OpenSSL: it must fit into a row (2 GB).
    """
    reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", "true").load(folder)
    whole = lambda df: df.select("path", "length", F.sha2("content", 256).alias("sha256"))
    if resumable.library() is None:
        return whole(files)
    large = [(r.path, r.length) for r in files.filter(F.col("length") > RANGE).select("path", "length").collect()]  # names of large files alone
    made = whole(files.filter(F.col("length") <= RANGE))
    if not large:
        return made
    with warnings.catch_warnings():  # that tags of the session are not handed on
        warnings.simplefilter("ignore", UserWarning)
        one = inheritable_thread_target(lambda file: None if file[0].lower().endswith(_PACKED) else _by_ranges(spark, *file))
    with ThreadPoolExecutor(min(len(large), spark.sparkContext.defaultParallelism)) as pool:
        found = [(*file, sha) for file, sha in zip(large, pool.map(one, large), strict=True)]
    made = made.union(spark.createDataFrame([r for r in found if r[2]], "path string, length long, sha256 string"))
    rest = [_literal(path) for path, _, sha in found if not sha]
    return made.union(whole(reader.load(rest))) if rest else made


def manifest(spark: SparkSession, folder: str, patterns: list[str]) -> DataFrame:
    """(path, bytes, sha256, pattern) of all files below folder; path is relative, pattern the first of the globs that allows it, null if none does.

    Files are read and hashed by the executors, large ones range by range; Spark's reader passes over empty files and names that begin with _ or a dot, so a required one counts as missing.
    In a pattern * stands for any characters but /, ** for any at all.
    """
    listed = _hashed(spark, folder).select(_relative(folder).alias("path"), F.col("length").alias("bytes"), "sha256")
    allowed = None
    for p in patterns:
        regex = "".join(".*" if part == "**" else "[^/]*" if part == "*" else "\\Q" + part + "\\E" for part in _parts(p))
        allowed = F.when(F.col("path").rlike(f"^{regex}$"), p) if allowed is None else allowed.when(F.col("path").rlike(f"^{regex}$"), p)
    return listed.withColumn("pattern", F.lit(None).cast("string") if allowed is None else allowed)


def _parts(glob: str) -> list[str]:
    found, at = [], 0
    while at < len(glob):
        star = "**" if glob.startswith("**", at) else "*" if glob[at] == "*" else None
        if star is None:
            end = glob.find("*", at)
            found.append(glob[at:] if end < 0 else glob[at:end])
        else:
            found.append(star)
        at += len(found[-1])
    return found


def release_problems(files: DataFrame, required: DataFrame) -> DataFrame:
    """(path, problem): files that a release must not be made with. files: as `manifest` gives them; required: (path, sha256), sha256 null if any content will do.

    missing: required and not there; changed: another content than required; unlisted: no pattern allows it.
    """
    found, wanted = files.alias("f"), required.select(F.col("path").alias("want"), F.col("sha256").alias("hash")).distinct()
    both = found.join(wanted, F.col("path") == F.col("want"), "full")
    problem = F.when(F.col("path").isNull(), "missing").when(F.col("hash").isNotNull() & (F.col("hash") != F.col("sha256")), "changed").when(F.col("pattern").isNull(), "unlisted")
    return both.select(F.coalesce("path", "want").alias("path"), problem.alias("problem")).filter("problem IS NOT NULL")


def assemble(spark: SparkSession, folder: str, target: str, patterns: list[str], required: DataFrame) -> DataFrame:
    """Copies allowed files below folder into the bundle target/files (path, content) by the executors, then writes target/MANIFEST (path, bytes, sha256) and returns it.

    Nothing is copied while a problem is left; the manifest comes last, so a release without one is not complete. Copies are compared with their hashes. A file must
    fit into a row (2 GB).
    """
    files = manifest(spark, folder, patterns)
    problems = release_problems(files, required).orderBy("path").limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{r.problem}: {r.path}" for r in problems))
    blocks = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    blocks.select(_relative(folder).alias("path"), "content").write.mode("overwrite").parquet(f"{target}/files")
    listed = files.select("path", "bytes", "sha256")
    stored = spark.read.schema("path string, content binary").parquet(f"{target}/files").select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    if not stored.exceptAll(listed).isEmpty() or not listed.exceptAll(stored).isEmpty():
        raise ValueError("files changed while they were copied")
    stored.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{target}/MANIFEST")
    return stored
