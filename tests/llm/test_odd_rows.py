"""Nulls, repeated rows, ties and clashing column names where the larger tests have none; sparse means and trigram queries against plain forms."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import fingerprints, packing, toxicity, trigrams, warc


def test_edits_of_null_and_repeated_doc_ids(spark):
    """Rows of one doc_id follow each other by text, a null doc_id comes last, after it the first row."""
    made = [(None, "last words of nobody at all"), (3, "some text of three parts, the first"), (3, "some text of three parts, the first"), (3, "another text of three"), (None, None), (7, "seven is the first of all rows"), (1, "")]
    docs = spark.createDataFrame([(d, t, 1, "k", 2.0, 3, "e", "o") for d, t in made], "doc_id long, text string, bucket int, key string, place double, ghost int, edited string, own string")
    ordered = sorted([(d, t or "") for d, t in made], key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = Counter()
    for k, (d, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        cut = len(t) // 3
        wanted[(d, len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest())] += 1
    found = fingerprints.compare_edits(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == wanted
    assert len({r.fingerprint for r in found if r.doc_id == 3}) == 2


def test_toxicity_with_columns_of_its_results(spark):
    docs = spark.createDataFrame([(k, "grumble" if k % 2 else "fine words", "x", "y", "z") for k in range(60)] + [(None, None, "x", "y", "z")], "doc_id long, text string, score string, predicted string, toxic string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 2 + [(None, 1), (5, None)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(docs, labels)
    assert dict(scored.dtypes)["score"] == "double" and dict(scored.dtypes)["predicted"] == "int" and sorted(scored.columns) == sorted(docs.columns)
    rows = scored.collect()
    assert len(rows) == 61 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("power", [1, 2])
def test_sparse_means_against_loops(power):
    """What a model's gradient is made of: means of rows, and their transpose, with a column that counts as zero."""
    draw = np.random.default_rng(3)
    row, column = draw.integers(0, 6, 40), draw.integers(-1, 9, 40)
    mean = toxicity._Mean(row, column, 7, 9)
    x, g = draw.normal(size=(9, 3)), draw.normal(size=(7, 3))
    size = [max(1, int((row == r).sum())) for r in range(7)]
    forward, backward = np.zeros((7, 3)), np.zeros((9, 3))
    for r, c in zip(row, column, strict=True):
        if c >= 0:
            forward[r] += x[c] / size[r]
            backward[c] += g[r] / size[r] ** power
    assert np.allclose(mean.forward(x), forward) and np.allclose(mean.backward(g, power), backward)
    if power == 1:
        assert (mean.forward(x) * g).sum() == pytest.approx((x * mean.backward(g)).sum())


def test_windows_of_equal_fill(spark):
    """Documents of one length, far more than open windows, rows alike, and null doc_ids: every token once, gapless windows."""
    import public_tokenizers

    text = " ".join(f"word{k}" for k in range(120))
    docs = spark.createDataFrame([(k if k % 7 else None, text, "s", 5) for k in range(150)] + [(9, text, "s", 5), (9, None, "s", 5)], "doc_id long, text string, part string, length int").repartition(3)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).toPandas()
    size = pieces.doc_tokens.max()
    assert pieces.length.sum() == 151 * size + 1
    own = pieces[pieces.doc_id == 8].sort_values("start")
    assert own.length.sum() == size and own.start.tolist() == np.r_[0, own.length.cumsum()[:-1]].tolist()
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset.to_numpy() == np.r_[0, g.length.cumsum()[:-1]]).all()


def test_pages_without_or_with_one_page_id(spark):
    pages = spark.createDataFrame([(None, "http://a/", "<p>one</p>", 1), (4, "http://b/", "<p>two</p>", 2), (4, "http://b/", "<p>two</p>", 2), (4, "http://c/", "<p>three</p>", 3)], "page_id long, url string, html string, warc int")
    answered = warc.responses(pages)
    source = Counter(warc.parse(bytes(r.warc))[0]["warc-record-id"] for r in answered.collect())
    assert sum(source.values()) == 4
    made = warc.derive(answered).collect()
    for kind in ("metadata", "conversion"):
        own = [r for r in made if r.record_type == kind]
        assert Counter(warc.parse(bytes(r.record))[0]["warc-refers-to"] for r in own) == source
        assert Counter(r.page_id for r in own) == {None: 1, 4: 3}
    assert sorted(bytes(r.block).decode() for r in made if r.record_type == "conversion") == ["one", "three", "two", "two"]


#: One pattern for each kind of node that a parsed regex may have, with the trigrams that every match must hold.
NODES = {
    "abcd": [{"abc", "bcd"}],
    "ABc": [{"abc"}],
    "abc|xyz": [{"abc"}, {"xyz"}],
    "ab[cd]": [{"abc"}, {"abd"}],
    "ab[c-e]": [{"abc"}, {"abd"}, {"abe"}],
    "ab[^c]de": [],
    "abc.": [{"abc"}],
    "abcd?": [{"abc"}],
    "a{3}b": [{"aaa", "aab"}],
    "abc(?:de)*": [{"abc"}],
    "abc+?d": [],
    "(abc)\\1": [{"abc"}],
    "^abc$": [{"abc"}],
    "(?=x)abc": [{"abc"}],
    "(?<!x)abc": [{"abc"}],
    "\\babc\\b": [{"abc"}],
    "(?P<n>ab)c": [{"abc"}],
    "\\d\\d\\d": [],
    "abc\\s+defg": [{"def", "efg"}],
    "(?>abc)": [],
    "a?b?": [],
    "": [],
}


@pytest.mark.parametrize("regex", NODES)
def test_trigrams_of_each_kind_of_node(regex):
    """The parser that the standard library keeps to itself: a version that names its nodes otherwise fails here, not in a scan that loses matches."""
    found = trigrams.query(regex)
    assert {frozenset(s) for s in found} == {frozenset(s) for s in NODES[regex]}
    for text in ("abcd", "ABc", "xyz", "abd", "abe", "ab-de", "abcx", "aaab", "abcdede", "abccd", "abcabc", "xabc", "123", "abc  defg"):
        if re.search(regex, text):
            held = {text.lower()[i : i + 3] for i in range(len(text) - 2)}
            assert not found or any(s <= held for s in found)
