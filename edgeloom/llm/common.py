"""Tables in the shared checkpoint folder, and readers of the input tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written  # noqa: F401  the operators take them from here

#: Spaces of the contracts: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that a task exchanges with Python at most (about; a longer row is a batch of its own).
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session exchanges batches of at most BATCH bytes with Python from now on, unless it is set to less: Spark's bounds, 10,000 rows and 64 MB, fill an executor with copies of long texts."""
    conf = df.sparkSession.conf
    found = re.fullmatch(r"([0-9]+)([kmgtp]?)b?", conf.get(_BATCH).strip().lower())
    if found is None or not 0 < int(found[1]) * 1024 ** " kmgtp".index(found[2] or " ") <= BATCH:
        conf.set(_BATCH, str(BATCH))
    return df


def text_of(df: DataFrame):
    """The text column, null as the empty string."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


#: Bits of a bitmap: BITS_EACH a key, at most 2**MOST_BITS (16 MB).
BITS_EACH, MOST_BITS = 16, 27
_PAGE = 1 << 15  # bits of one bitmap of Spark's bitmap functions


def marked(df: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """Rows of df whose key may be one of `chosen` (a column of the same name): all that are, and of the others at most a sixteenth or so.

    A bitmap of hashed keys goes to every task, whose size is bounded whatever `chosen` holds; beyond 2**MOST_BITS / BITS_EACH keys it only drops less.
    """
    bits = min(1 << MOST_BITS, max(_PAGE, 1 << (BITS_EACH * chosen.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    within = place.bitwiseAND(F.lit(_PAGE - 1))
    pages = chosen.groupBy(F.shiftright(place, 15).alias("__page")).agg(F.bitmap_construct_agg(within).alias("__bits"))
    at = df.withColumns({"__page": F.shiftright(place, 15), "__at": within}).join(F.broadcast(pages), "__page")  # at most bits / 8 bytes
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return at.filter(F.getbit(byte, F.col("__at").bitwiseAND(F.lit(7)).cast("int")) == 1).drop("__page", "__at", "__bits")
