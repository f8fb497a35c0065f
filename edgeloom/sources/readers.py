"""Readers: connectomes, behaviour and covariates as long tables; CSV, headerless atlases, key=value records, directory listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix_cells(vectors: DataFrame, nodes: int = NODES) -> DataFrame:
    """(subject_row, pos, node_i, node_j, value): the cells of flattened square matrices (vec_id, embedding)."""
    cells = vectors.select(F.col("vec_id").alias("subject_row"), F.posexplode("embedding").alias("pos", "v"))
    return cells.select("subject_row", "pos", (F.col("pos") % nodes).alias("node_i"), F.expr(f"int(pos div {nodes})").alias("node_j"), F.col("v").cast("double").alias("value"))


def connectome(vectors: DataFrame, nodes: int = NODES) -> DataFrame:
    """(subject_row, edge_id, node_i, node_j, value): upper edges as means of mirrored cells; no join, both cells come from one row."""
    pairs = F.array(*(F.struct(F.lit(j * nodes + i).alias("edge_id"), F.lit(i).alias("node_i"), F.lit(j).alias("node_j"), ((F.col("embedding")[j * nodes + i].cast("double") + F.col("embedding")[i * nodes + j].cast("double")) / 2).alias("value")) for j in range(nodes) for i in range(j)))
    return vectors.select(F.col("vec_id").alias("subject_row"), F.explode(pairs).alias("e")).select("subject_row", "e.*")


def mirrored(i: int, j: int, nodes: int = NODES) -> Column:
    return (F.col("embedding")[j * nodes + i].cast("double") + F.col("embedding")[i * nodes + j].cast("double")) / 2


def behavior(vectors: DataFrame) -> DataFrame:
    """(subject_row, y, label): a continuous score built of three edges and the label."""
    y = mirrored(0, 1) + mirrored(1, 2) - mirrored(2, 3) + F.col("label") / 10
    return vectors.select(F.col("vec_id").alias("subject_row"), y.alias("y"), "label")


def covariates(vectors: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    return vectors.select(v.alias("subject_row"), (v % 3 + 1).alias("study_id"), (v % 3 == 1).cast("int").alias("study_2"), (v % 3 == 2).cast("int").alias("study_3"), (v % 2).alias("sex"), ((v * 7) % 15 + 20).cast("double").alias("age"))


def require(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, unless a row is bad."""
    n = df.filter(bad).limit(1).count()
    if n:
        raise ValueError(message)
    return df


def finite_behavior(df: DataFrame, column: str = "y") -> DataFrame:
    """df, if the column is finite everywhere and not constant."""
    require(df, F.col(column).isNull() | F.isnan(column) | (F.abs(column) == float("inf")), f"{column} is not finite")
    if not (df.agg(F.stddev_samp(column)).first()[0] or 0) > 0:
        raise ValueError(f"{column} is constant")
    return df


def with_fallback(preferred: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, fallback_used): the preferred source where it has the key."""
    a, b = preferred.select(key, F.col(value).alias("__a")), other.select(key, F.col(value).alias("__b"))
    return a.join(b, key, "full").select(key, F.coalesce("__a", "__b").alias(value), F.col("__a").isNull().alias("fallback_used"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; names with spaces stay as they are."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True)


def headerless_atlas(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, network, x, y, z) of a tab-separated list with irregular tabs and ids written as decimals."""
    parts = F.split(F.trim("value"), r"[\t ]+")
    return spark.read.text(path).filter(F.trim("value") != "").select(parts[0].cast("double").cast("int").alias("node_id"), parts[1].alias("network"), *(parts[k].cast("double").alias(c) for k, c in ((2, "x"), (3, "y"), (4, "z"))))


def key_values(lines: DataFrame, value: str, *keep: str) -> DataFrame:
    """(keep..., key, text, number) of `key=value` lines; the caller picks the last of a key."""
    key, text = F.trim(F.substring_index(value, "=", 1)), F.trim(F.expr(f"substring({value}, instr({value}, '=') + 1)"))
    return lines.filter(F.contains(value, F.lit("="))).select(*keep, key.alias("key"), text.alias("text"), F.try_to_number(text, F.lit("9999999999D99")).cast("double").alias("number"))


def newest(spark: SparkSession, glob: str) -> str | None:
    """Path of the newest file of a glob; its content is not read."""
    return spark.read.format("binaryFile").load(glob).agg(F.max_by("path", "modificationTime")).first()[0]


def checkpoint_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet rows that an earlier run left under `path`, or an empty table of the schema; raises if their columns differ from it."""
    from pyspark.errors import AnalysisException

    want = spark.createDataFrame([], schema)
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return want
    if [(f.name, f.dataType) for f in found.schema] != [(f.name, f.dataType) for f in want.schema]:
        raise ValueError(f"{path} has other columns: {found.schema.simpleString()}")
    return found


def single_variable(df: DataFrame, keys: list[str]) -> tuple[str, DataFrame]:
    """(name, keys and `value`) of a table that holds exactly one variable besides its keys."""
    names = [c for c in df.columns if c not in keys]
    if len(names) != 1:
        raise ValueError(f"one variable expected, found {', '.join(names) or 'none'}")
    return names[0], df.select(*keys, F.col(names[0]).alias("value"))


def bom_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header that may begin with a byte-order mark; all columns are strings."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def exactly_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, unless a key has several rows."""
    if not df.groupBy(*keys).count().filter("count <> 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} must name one row each")
    return df


def without_forbidden(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """df, unless it has one of the columns that a release must not show (compared without case)."""
    bad = [c for c in df.columns if c.lower() in {f.lower() for f in forbidden}]
    if bad:
        raise ValueError(f"forbidden columns: {', '.join(bad)}")
    return df


def pruned(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Fields of a saved Parquet bundle, nested ones as `column.field`; nothing else is read. A field that the bundle lacks is refused by name."""
    from pyspark.sql import types as T

    found = spark.read.parquet(path)

    def known(field: str) -> bool:
        kind: T.DataType = found.schema
        for name in field.split("."):
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return False
            kind = kind[name].dataType
        return True

    lacking = [f for f in fields if not known(f)]
    if lacking:
        raise ValueError(f"the bundle lacks {', '.join(lacking)}")
    return found.select(*fields)
