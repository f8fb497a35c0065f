"""Quality classifier: runs, neighbour sums and pooling against plain loops, gradients against differences, held-out accuracy, odd rows."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from edgeloom.llm import quality, queries, textops
from edgeloom.llm.common import table

SMALL = "/root/testdata/sf0.01"
TEXTS = ["The cat sat.\nThe CAT sat!!", "", "one", "ab12 - ÄÖ ß### x", "word " * 40, "a.b,c  d\t\x0be"]


def arrow(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    return [(at, to, quality.runs(data, offsets)) for at, to, data, offsets in textops.chunks(batch, "text", 64)]


def plain_runs(text):
    """Runs of letters and digits (bytes over 127 count as letters) or of other marks."""
    return re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", text.encode())


def place(run):
    return int(arrow([run.decode("latin-1")])[0][2].word[0]) if max(run) < 128 else None


def test_runs():
    for at, to, found in arrow(TEXTS):
        for k, text in enumerate(TEXTS[at:to]):
            own = plain_runs(text)
            words = found.word[found.row == k].tolist()
            assert len(words) == len(own)
            for run, word in zip(own, words):
                assert place(run.lower()) in (None, word)
    shapes = dict(zip(plain_runs("a The CAT cAt 12 # ## #### wordswordswordsw"), arrow(["a The CAT cAt 12 # ## #### wordswordswordsw"])[0][2].shape.tolist()))
    assert shapes == {b"a": 0, b"The": 6, b"CAT": 11, b"cAt": 16, b"12": 21, b"#": 25, b"##": 26, b"####": 27, b"wordswordswordsw": 4}


def test_word_vectors_are_sums_over_neighbours(spark, monkeypatch):
    index = quality.index_vectors().astype(int)
    assert (np.abs(index).sum(1) <= quality.SIGNS).all() and (np.abs(index).sum(1) % 2 == 0).all()
    sums, counts = np.zeros((quality.WORDS, quality.SIZE)), np.zeros(quality.WORDS)
    for _, to, found in arrow(TEXTS):
        for i, w in enumerate(found.word):
            counts[w] += 1
            for j in range(max(0, i - quality.NEAR), min(len(found.word), i + quality.NEAR + 1)):
                if j != i and found.row[j] == found.row[i]:
                    sums[w] += index[found.word[j]]
    some = counts > 0
    centred = sums[some] / counts[some, None] - sums.sum(0) / counts.sum()
    wanted = np.rint(centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9) * quality.SCALE)
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate([*TEXTS, None])], "doc_id long, text string, place string").repartition(3)
    for block in (quality.RUNS, 5):
        monkeypatch.setattr(quality, "RUNS", block)
        made = quality.word_vectors(docs)
        assert np.abs(made[some] - wanted).max() <= 1 and not made[~some].any()


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_pooling(monkeypatch, block):
    monkeypatch.setattr(quality, "RUNS", block)
    vectors = np.random.default_rng(1).integers(-600, 600, (quality.WORDS, quality.SIZE)).astype(np.int16)
    for at, to, found in arrow(TEXTS):
        x = quality.pooled(found, to - at, vectors)
        for k in range(to - at):
            words, shapes = found.word[found.row == k], found.shape[found.row == k]
            n = len(words)
            if n == 0:
                assert not x[k].any()
                continue
            each = vectors[words] / quality.SCALE
            likeness = [float(a @ b) for a, b in zip(each, each[1:])]
            other = [np.linalg.norm(each.mean(0)), sum(likeness) / max(1, n - 1), sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1), len(set(words.tolist())) / n, math.log(n + 1)]
            assert x[k] == pytest.approx(np.concatenate([each.mean(0), np.bincount(shapes, minlength=28) / n, other]))


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(3)
    x, y, weight = draw.normal(size=(20, 6)), draw.integers(0, 2, 20), draw.random(20)
    weight /= weight.sum()
    parameters = [draw.normal(size=s) for s in ((6, 5), (5,), (5, 2), (2,))]
    _, found = quality.gradients(parameters, x, y, weight)
    for k, p in enumerate(parameters):
        for at in np.ndindex(p.shape):
            ends = []
            for step in (1e-6, -1e-6):
                moved = [q.copy() for q in parameters]
                moved[k][at] += step
                ends.append(quality.gradients(moved, x, y, weight)[0])
            assert found[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_temperature_is_the_best_of_many():
    draw = np.random.default_rng(4)
    margin = draw.normal(0, 6, 3000)
    y = (draw.random(3000) < 1 / (1 + np.exp(-margin / 3))).astype(int)  # logits three times too sure
    logits, weight = np.stack([-margin / 2, margin / 2], 1), draw.random(3000)
    found, loss = quality.temperature(logits, y, weight)
    tried = [(weight * np.logaddexp(0, -margin * np.where(y == 1, 1, -1) / t)).sum() / weight.sum() for t in np.geomspace(0.3, 15, 200)]
    assert loss <= min(tried) + 1e-9 and 2.5 < found < 3.5


def test_held_out_accuracy(spark):
    scored = queries.op11_quality(spark, SMALL).toPandas()
    both = scored.merge(table(spark, SMALL, "labels").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(scored) == 1000 and scored.score.between(0, 1).all() and len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.95 and ((scored.score >= 0.3) == (scored.predicted == 1)).all()


def test_odd_rows(spark):
    good, bad = "Plain words of a calm text, number {}. They go on.", "junk### of%%% noise&&& {}*** and$$$ marks###"
    rows = [(k, (good, bad)[k % 2].format(k), "mine", 7, "p", "x") for k in range(120)] + [(500, None, None, 8, "p", None), (501, "", "mine", 9, "p", ""), (502, " \n", "mine", 9, "p", ""), (503, bad * 3000, "m", 1, "p", ""), (1, bad.format(1), "m", 1, "p", ""), (None, good, "m", 1, "p", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int, place string, label string")
    labels = spark.createDataFrame([(k, 1 - k % 2, "t") for k in range(100)] + [(3, 0, "t"), (9999, 1, "t"), (4, None, "t"), (None, 1, "t"), (6, 7, "t")], "doc_id long, quality int, text string")
    found = quality.score_quality(docs, labels).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "text", "score", "predicted", "place", "label"}
    share = {r.score for r in found if r.doc_id in (500, 501, 502)}
    assert len(share) == 1 and 0.3 < share.pop() < 0.7
    assert all(r.predicted == int("junk" not in r.text) for r in found if r.text and r.text.strip())
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    one = quality.score_quality(docs, labels.filter("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0
