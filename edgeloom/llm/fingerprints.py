"""Consistent weighted sampling fingerprints, in SQL expressions alone.

A text's terms are its words, A-Z and other letters lower-cased, weighted by their counts. Sample k draws, from hashes of (term, k)
alone, r and c from Gamma(2, 1) and b uniformly; with t = floor(ln w / r + b), the term with the least ln c - r (t - b + 1)
is sampled, and (term, t) is the signature. Two texts agree in a sample with the probability sum(min) / sum(max) of
their weights, the generalised Jaccard similarity.

Words of one text are counted inside its row; sampling is an aggregate of minima that keeps SAMPLES longs a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of

SAMPLES = 32
_BITS = 28
#: Buckets of neighbours for each shuffle partition.
BUCKETS = 4


def term_counts(df: DataFrame, text: str, terms: str) -> DataFrame:
    """df with the array `terms` of (t, w): hashes and counts of the words of `text`, which must not be null."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    df = df.withColumn("__sorted", F.sort_array(F.transform(words, lambda x: F.xxhash64(x))))
    h = F.col("__sorted")
    fresh = F.filter(F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1))), lambda i: (F.size(h) > 0) & ((i == 1) | (F.element_at(h, i) != F.element_at(h, F.greatest(i - 1, F.lit(1))))))
    df = df.withColumn("__fresh", fresh)
    pairs = F.zip_with("__fresh", F.slice("__fresh", F.lit(2), F.greatest(F.size("__fresh"), F.lit(1))), lambda i, j: F.struct(F.element_at(h, i).alias("t"), (F.coalesce(j, F.size(h) + 1) - i).alias("w")))
    return df.withColumn(terms, pairs).drop("__sorted", "__fresh")


def _drawn(t: Column, log_w: Column, k: int) -> Column:
    """A long that orders terms by sample k: the quantised logarithm above, _BITS bits of the signature below."""
    x, y = F.xxhash64(t, F.lit(2 * k)), F.xxhash64(t, F.lit(2 * k + 1))

    def uniform(bits: Column, n: int) -> Column:
        return (bits + 0.5) / float(2**n)

    half, third = F.lit(2**32 - 1), F.lit(2**21 - 1)
    r = -F.ln(uniform(F.shiftrightunsigned(x, 32), 32) * uniform(x.bitwiseAND(half), 32))
    c = -F.ln(uniform(y.bitwiseAND(third), 21) * uniform(F.shiftrightunsigned(y, 21).bitwiseAND(third), 21))
    b = uniform(F.shiftrightunsigned(y, 42).bitwiseAND(third), 21)
    level = F.floor(log_w / r + b)
    log_a = F.ln(c) - r * (level - b + 1)
    order = F.greatest(F.lit(0), F.least(F.lit(2**35 - 1), ((log_a + 200) * float(2**26)).cast("long")))
    return F.shiftleft(order, _BITS).bitwiseOR(F.xxhash64(t, level).bitwiseAND(F.lit(2**_BITS - 1)))


def signatures(df: DataFrame, keys: list[str], terms: str, samples: int = SAMPLES) -> DataFrame:
    """One row for each distinct `keys`: them and `signature`, an array of `samples` integers; null without terms."""
    long = df.select(*keys, F.explode_outer(terms).alias("x")).select(*keys, F.col("x.t").alias("t"), F.ln(F.col("x.w").cast("double")).alias("log_w"))
    least = [F.min(_drawn(F.col("t"), F.col("log_w"), k)).alias(f"s{k}") for k in range(samples)]
    mask = F.lit(2**_BITS - 1)
    signed = F.when(F.col("s0").isNotNull(), F.array(*(F.col(f"s{k}").bitwiseAND(mask) for k in range(samples))))
    return long.groupBy(*keys).agg(*least).select(*keys, signed.alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without terms, 0 for one of them."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def as_text(signature: Column) -> Column:
    """Hexadecimal; empty for a text without terms."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 7, "0")), ""), F.lit(""))


def _bucketed(docs: DataFrame) -> DataFrame:
    """Rows in buckets of neighbouring doc_ids, each with a copy (`ghost`) of the row that follows its last one in descending order.

    Bounds are quantiles of doc_id, as many as BUCKETS times the session's shuffle partitions; two levels of about the root of their number find a row's bucket.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    n = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.select(key.alias("key")).agg(F.percentile_approx("key", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] or []))
    step = max(1, int(len(bounds) ** 0.5))

    def longs(xs: list[int]) -> Column:
        return F.array(*(F.lit(x).cast("long") for x in xs)).cast("array<bigint>")

    below = lambda column: F.size(F.filter(column, lambda b: b <= F.col("key")))
    placed = docs.withColumn("key", key).withColumn("__coarse", below(longs(bounds[step::step])))
    placed = placed.withColumn("__fine", F.element_at(F.array(*(longs(bounds[k : k + step]) for k in range(0, max(1, len(bounds)), step))), F.col("__coarse") + 1))
    placed = placed.withColumn("bucket", F.col("__coarse") * step + below(F.col("__fine"))).drop("__coarse", "__fine")
    heads = placed.groupBy("bucket").agg(F.max("key").alias("key"))
    # the head of a bucket follows the last row of the next higher bucket, the highest head the lowest row of all
    around = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    into = heads.select("key", F.coalesce(F.lead("bucket").over(W.orderBy("bucket")), F.first("bucket").over(around)).alias("into"))
    placed = placed.join(F.broadcast(into), "key", "left")  # at most n rows
    twice = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("bucket"), F.lit(True).alias("ghost")))))
    return placed.withColumn("at", F.explode(twice)).withColumns({"bucket": F.col("at.bucket"), "ghost": F.col("at.ghost")}).drop("at", "into")


def compare_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is the start of the next document's text.

    Next is the next smaller doc_id, after the smallest the largest. Null texts count as empty; rows of one doc_id follow each other by text,
    a null doc_id comes last. Two texts without words are alike (1), a text with words and one without are not (0).
    """
    slim = docs.select("doc_id", text_of(docs).alias("text"))
    order = W.partitionBy("bucket").orderBy("ghost", F.desc("key"), "text")
    rows = _bucketed(slim).withColumns({"place": F.row_number().over(order), "next": F.coalesce(F.lead("text").over(order), F.lit("")), "n_chars": F.length("text").cast("long")})
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next", F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("x")).select(*keys, "x.*")
    signed = signatures(term_counts(both, "text", "terms"), [*keys, "which"], "terms", samples)
    pairs = signed.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("signature"))).alias("own"), F.max(F.when(F.col("which") == 1, F.col("signature"))).alias("other"))
    following = F.lead("own").over(W.partitionBy("bucket").orderBy("place"))
    pairs = pairs.withColumn("following", following).filter("NOT ghost")
    return pairs.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
