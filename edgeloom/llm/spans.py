"""Offsets of regular-expression matches as SQL expressions alone: code points, end exclusive.

Matches and the pieces between them tile a text, so running sums of their lengths are the offsets. Sums run in blocks of BLOCK
matches and then over blocks, so a text with m matches costs about m * BLOCK steps and not m * m.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
SPANS = "array<struct<start:bigint,end:bigint,hit:string>>"


def locate(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with one column of SPANS for each name in patterns: name -> (regex without empty matches, condition under which the text is searched).

    Matches are the leftmost non-overlapping ones. The text column must not be null.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__hit_{k}": F.when(when, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, (p, when) in patterns.items()})
    gaps = {k: F.when(F.size(f"__hit_{k}") > 0, F.split(text, p, -1)).otherwise(none) for k, (p, _) in patterns.items()}
    df = df.withColumns({f"__gap_{k}": g for k, g in gaps.items()})

    def sized(gap: Column, hit: Column) -> Column:
        return F.struct(F.length(gap).cast("long").alias("g"), F.length(hit).cast("long").alias("m"), hit.alias("hit"))

    df = df.withColumns({f"__part_{k}": F.slice(F.zip_with(f"__gap_{k}", f"__hit_{k}", sized), F.lit(1), F.size(f"__hit_{k}")) for k in patterns})

    def summed(block: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["g"]
            end = start + x["m"]
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

        return F.aggregate(block, first, step)

    def blocks(k: str) -> Column:
        part = F.col(f"__part_{k}")
        last = F.expr(f"greatest(0, size(__part_{k}) - 1) div {BLOCK}")
        return F.transform(F.sequence(F.lit(0), last), lambda b: summed(F.slice(part, b * BLOCK + 1, F.lit(BLOCK))))

    df = df.withColumns({f"__run_{k}": blocks(k) for k in patterns})

    def shifted(k: str) -> Column:
        run = F.col(f"__run_{k}")
        starts = F.aggregate(run, F.array(F.lit(0).cast("long")), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        moved = F.zip_with(run, F.slice(starts, F.lit(1), F.size(run)), lambda r, at: F.transform(r["out"], lambda x: F.struct((x["start"] + at).alias("start"), (x["end"] + at).alias("end"), x["hit"].alias("hit"))))
        return F.flatten(moved)

    df = df.withColumns({k: shifted(k) for k in patterns})
    return df.drop(*(f"__{part}_{k}" for part in ("hit", "gap", "part", "run") for k in patterns))


def labelled(column: str, kind: str, rank: int) -> Column:
    """Spans as structs (rank, start, end, kind), which sort by kind and start."""
    return F.transform(column, lambda x: F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
