"""Toxicity by subword bags: averaged embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams, so unseen misspellings share most of it; a text's vector is the
mean over its distinct words, and a linear softmax over two labels reads it. Training sees at most SAMPLE rows of each label, chosen by a hash
of doc_id, in one task. The trained model is linear in words, so it is kept as one logit for each n-gram bucket and a bias,
which is moved from the sample's share of toxic rows to that of all labelled rows. Scoring is one map over whole texts.

A text without words scores the share of toxic rows. Without rows of both labels every score is that share (0 without any label). A null text
counts as empty; labels of doc_ids that no document has are ignored; rows of one doc_id are scored one by one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of
from .textops import mix

SAMPLE = 3_000
BUCKETS, DIMENSIONS, EPOCHS, RATES, DOUBT, LEAST = 1 << 17, 4, 30, (20.0, 0.1, 0.1), 3.0, 5
GRAMS = (3, 6)
MEMO = 500_000
#: Entries of a sparse sum that are taken at a time.
PART = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str | object = "doc_id"):
    """Whether crc32 of doc_id as text leaves no remainder by five."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def grams(listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, bucket) of all character n-grams of the words, each with marks at its ends."""
    marked = [f"<{w}>" for w in listed]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner, end = np.repeat(np.arange(len(marked), dtype=np.int32), sizes), np.repeat(np.cumsum(sizes), sizes)
    value, owners, found = np.zeros(len(code), np.uint64), [], []
    for n in range(1, min(GRAMS[1], len(code)) + 1):
        value = value[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n >= GRAMS[0]:
            inside = np.arange(len(value)) + n <= end[: len(value)]
            owners.append(owner[: len(value)][inside])
            found.append((mix(value[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
    return (np.concatenate(owners), np.concatenate(found)) if owners else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, place in the vocabulary) of the distinct words of each text, both ascending, and the sorted vocabulary; a word of many texts is held once."""
    met: dict[str, int] = {}
    bags = [np.fromiter((met.setdefault(w, len(met)) for w in words(t)), np.int32) for t in texts]
    vocabulary = sorted(met)
    rank = np.empty(len(met), np.int32)
    rank[np.fromiter(map(met.__getitem__, vocabulary), np.int64, len(met))] = np.arange(len(met))
    owner = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
    return owner, np.concatenate([np.sort(rank[b]) for b in bags]) if bags else np.zeros(0, np.int32), vocabulary


def _summed(row: np.ndarray, column: np.ndarray, each: np.ndarray, value: np.ndarray, size: int, by_row: bool) -> np.ndarray:
    """Sums over entries of each[row] times the value of the other side, added up in the order of entries, PART of them at a time."""
    total = np.zeros(size)
    for at in range(0, len(row), PART):
        r, c = row[at : at + PART], column[at : at + PART]
        np.add.at(total, r if by_row else c, each[r] * value[c if by_row else r])
    return total


class _Mean:
    """A sparse matrix of row means, applied forwards and backwards; negative columns count in a mean as zeros."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, columns: int):
        self.each = 1.0 / np.maximum(1, np.bincount(row, minlength=rows))
        known = column >= 0
        self.row, self.column = row[known].astype(np.int32), column[known].astype(np.int32)
        self.shape = (rows, columns)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_summed(self.row, self.column, self.each, x[:, d], self.shape[0], True) for d in range(x.shape[1])], 1)

    def backward(self, g: np.ndarray, power: int = 1) -> np.ndarray:
        each = self.each**power
        return np.stack([_summed(self.row, self.column, each, g[:, d], self.shape[1], False) for d in range(g.shape[1])], 1)


def fit(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(bucket ids, their logits, bias) of the jointly trained model.

    An n-gram's step is its gradient in units of the deviation that chance would give it, less DOUBT of them: what only names a few texts stays at zero.
    A fifth of the texts is left out: the step with its least loss counts, and a logistic fit of one slope and bias calibrates the logits on it.
    """
    text_of_word, word, vocabulary = _words_of(texts)
    owner, bucket = grams(vocabulary)
    # in how many words of texts an n-gram stands
    used = np.flatnonzero(_summed(owner, bucket, np.bincount(word, minlength=len(vocabulary)), np.ones(len(vocabulary)), BUCKETS, False) >= LEAST)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    spelled = _Mean(owner, place[bucket], len(vocabulary), len(used))
    del owner, bucket
    left = np.array([zlib.crc32(t.encode()) % 5 == 0 for t in texts])
    kept = [np.flatnonzero(~left), np.flatnonzero(left)]
    if len(set(labels[kept[0]].tolist())) < 2 or len(set(labels[kept[1]].tolist())) < 2:
        kept = [np.arange(len(texts))] * 2
    held = []
    for part in kept:
        at = np.full(len(texts), -1)
        at[part] = np.arange(len(part))
        own = at[text_of_word] >= 0
        held.append(_Mean(at[text_of_word[own]], word[own], len(part), len(vocabulary)))
    y, y_left = (labels[part] for part in kept)
    draw = np.random.default_rng(7)
    parameters = [draw.normal(0, 0.001, (len(used), DIMENSIONS)), draw.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)]
    moments = [np.zeros_like(p) for p in parameters]
    weight = (0.5 / np.bincount(y, minlength=2))[y]
    # the deviation of each n-gram's gradient if labels had nothing to do with it
    noise = np.sqrt(spelled.backward(held[0].backward(weight[:, None] ** 2 / 4, 2), 2)[:, 0]) + 1e-12
    best = (math.inf, np.zeros(len(used)), np.zeros(len(y_left)))
    for _ in range(EPOCHS):
        table, softmax, bias = parameters
        text = held[0].forward(spelled.forward(table))
        logits = text @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        gradients = [spelled.backward(held[0].backward(p @ softmax.T)), text.T @ p, p.sum(0)]
        for k, g in enumerate(gradients):
            if k == 0:
                g = g / (noise[:, None] * (np.linalg.norm(softmax[:, 1] - softmax[:, 0]) + 1e-12))
                g = g * np.maximum(0, 1 - DOUBT / (np.linalg.norm(g, axis=1, keepdims=True) + 1e-12))
            moments[k] = 0.8 * moments[k] + 0.2 * g
            size = np.abs(moments[k]).max()
            if size > 0:
                parameters[k] = parameters[k] - RATES[k] * moments[k] / size * min(1.0, math.sqrt(np.abs(p).sum()))
        table, softmax, bias = parameters
        direction = softmax[:, 1] - softmax[:, 0]
        margin = held[1].forward(spelled.forward(table @ direction[:, None]))[:, 0]
        slope, start, loss = calibrate(margin, y_left)
        if loss < best[0]:
            best = (loss, table @ direction * slope, start)
    return used, best[1], float(best[2])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(slope, bias, mean loss) of a logistic fit with slightly smoothed labels, both labels weighing alike, by Newton steps."""
    n = np.bincount(y, minlength=2)
    weight = (0.5 / n)[y]
    goal = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    spread = margin.std() or 1.0
    x = np.stack([margin / spread, np.ones(len(y))], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - goal)) + np.array([1e-3, 0]) * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, gradient), -2, 2)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w[0] / spread, w[1], float(-(weight * (goal * np.log(p) + (1 - goal) * np.log(1 - p))).sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """(logit of each bucket, bias, share of toxic rows) from labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").filter(~held_out())
    counts = {int(r.toxic): int(r.n) for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = n1 / max(1, n0 + n1)
    logits = np.zeros(BUCKETS)
    if not n0 or not n1:
        return logits, 0.0, share
    picked = known.filter("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).union(known.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * sample rows at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(frames), ignore_index=True)
        every = every.sort_values(["doc_id", "text"])
        if every["toxic"].nunique() < 2:
            return
        ids, values, bias = fit(every["text"].tolist(), every["toxic"].to_numpy())
        yield pd.DataFrame({"ids": [ids.astype("<i4").tobytes()], "values": [values.astype("<f4").tobytes()], "bias": [bias]})

    found = rows.repartition(1).mapInPandas(run, "ids binary, values binary, bias double").first()
    if found is None:
        return logits, 0.0, share
    logits[np.frombuffer(found["ids"], "<i4")] = np.frombuffer(found["values"], "<f4")
    return logits, found["bias"], share


def score(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on), which replace input columns of these names."""
    logits, bias, share = model
    prior = math.log(share / (1 - share)) if 0 < share < 1 else (-30.0 if share == 0 else 30.0)
    # training weighs both labels alike; the bias moves half of the way to their true shares, so a text must show more than a prior
    start = bias + prior / 2
    sent = docs.sparkSession.sparkContext.broadcast(logits.astype(np.float32))  # BUCKETS numbers
    trained = bool(np.any(logits))
    docs = docs.drop("score", "predicted", "__text").withColumn("__text", text_of(docs))
    names = [c for c in docs.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.astype(np.float64)
        memo: dict[str, float] = {}

        def scored(texts: list[str]) -> list[float]:
            bags = [words(t) if trained else set() for t in texts]
            if len(memo) > MEMO:
                memo.clear()
            new = list(set().union(*bags).difference(memo))
            if new:
                owner, bucket = grams(new)
                n = np.bincount(owner, minlength=len(new))
                memo.update(zip(new, (np.bincount(owner, table[bucket], len(new)) / np.maximum(1, n)).tolist(), strict=True))
            logits = [start + math.fsum(map(memo.__getitem__, b)) / len(b) if b else prior for b in bags]
            return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in logits]

        for batch in batches:
            scores: list[float] = []
            for at in range(0, batch.num_rows, 100):
                scores += scored(batch.column("__text").slice(at, 100).to_pylist())
            columns = [batch.column(c) for c in names] + [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    schema = T.StructType([*docs.select(names).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    docs = small_batches(docs)
    return score(docs, train(docs, labels, sample))
