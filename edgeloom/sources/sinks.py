"""Sinks: CSV, idempotent upserts, run manifests, Markdown tables, release gates."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose keys fresh rows do not replace, and all fresh rows."""
    return stored.join(fresh.select(keys).distinct(), keys, "left_anti").unionByName(fresh)


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(present.select(keys).distinct(), keys, "left_anti")


def manifest(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of a binaryFile table."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def markdown(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One text row: a Markdown table of a small result."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("__line"))))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return df.agg(F.concat_ws("\n", F.lit(head), F.transform(rows, lambda x: x["__line"])).alias("text"))


def write_record(df: DataFrame, path: str, fields: dict[str, object]) -> None:
    """A one-row run record, which Spark's commit makes visible as a whole."""
    df.sparkSession.sql("SELECT '" + json.dumps(fields, sort_keys=True).replace("\\", "\\\\").replace("'", "\\'") + "' AS value").coalesce(1).write.mode("overwrite").text(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook as one folder of CSV files a sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/sheet={name}")


def append_report(lines: DataFrame, path: str) -> None:
    """Adds text lines (value) to a report; lines that are null are left out, earlier ones stay."""
    lines.filter("value IS NOT NULL").select("value").coalesce(1).write.mode("append").text(path)


def begin_run(df: DataFrame, path: str, fields: dict[str, object]) -> None:
    """The run record as RUNNING; df is the session's any table."""
    write_record(df, path, fields | {"status": "RUNNING"})


def finish_run(outputs: DataFrame, path: str, fields: dict[str, object]) -> None:
    """The run record as COMPLETE, with the number of output files and one hash over their names and contents (outputs: a binaryFile table)."""
    hashed = manifest(outputs).select(F.concat_ws(":", F.element_at(F.split("path", "/"), -1), "sha256").alias("line"))
    total = hashed.agg(F.count("*").alias("files"), F.sha2(F.array_join(F.sort_array(F.collect_list("line")), ","), 256).alias("sha256")).first()  # as many names as output files
    write_record(outputs, path, fields | {"status": "COMPLETE", "files": total.files, "outputs_sha256": total.sha256})


class SessionLog(logging.Handler):
    """Messages of a logger while the block runs, added as text lines to a log in a shared folder; written when the block ends, by an error too (which is its last line).

    These are the driver's messages, a few for each step of a run; earlier sessions' lines stay.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, level: int = logging.INFO):
        super().__init__(level)
        self.spark, self.path, self.logger, self.lines = spark, path, logging.getLogger(name), []

    def emit(self, record: logging.LogRecord) -> None:
        self.lines += [f"{record.levelname} {line}" for line in record.getMessage().splitlines()]

    def __enter__(self) -> logging.Logger:
        self.before = self.logger.level
        self.logger.setLevel(self.level)
        self.logger.addHandler(self)
        return self.logger

    def __exit__(self, kind, error, trace) -> None:
        self.logger.removeHandler(self)
        self.logger.setLevel(self.before)
        if error is not None:
            self.lines.append(f"ERROR {kind.__name__}: {error}")
        append_report(self.spark.createDataFrame([(line,) for line in self.lines], "value string"), self.path)
