"""Memory of Python workers: batches are bounded by bytes, and the toxicity trainer holds each word once."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import common, jaccard_join, line_dedup, packing, toxicity, warc

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest(spark) -> int:
    """Bytes of the largest batch that Python gets of 2,000 rows of 10,000 characters."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    return spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(run, "n long").agg(F.max("n")).first()[0]


OPERATORS = {
    "toxicity": lambda d: toxicity.score_toxicity(d, d.sparkSession.createDataFrame([(1, 0)], "doc_id long, toxic int")),
    "line_dedup": line_dedup.dedup_lines,
    "ngram_jaccard": jaccard_join.jaccard_components,
    "packing": lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "warc": lambda d: warc.derive(warc.responses(d.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html"))),
    "warc_records": lambda d: warc.derive(d.selectExpr("doc_id AS page_id", "CAST(text AS BINARY) AS warc")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_batches_are_bounded_by_bytes(spark, name):
    spark.conf.unset(_KEY)
    assert _largest(spark) > 2 * common.BATCH
    OPERATORS[name](spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert _largest(spark) <= common.BATCH + 20_000


def test_a_smaller_bound_stays(spark):
    for given, kept in (("1m", "1m"), ("2000b", "2000b"), ("64m", str(common.BATCH)), ("1g", str(common.BATCH))):
        spark.conf.set(_KEY, given)
        common.small_batches(spark.range(1))
        assert spark.conf.get(_KEY) == kept
    spark.conf.unset(_KEY)


def test_the_trainer_holds_each_word_once():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(3_000)]
    texts = [" ".join(draw.choices(vocabulary, k=4_000)) for _ in range(300)]
    labels = np.arange(300) % 2
    tracemalloc.start()
    toxicity.fit(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
